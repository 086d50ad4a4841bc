"""Sequence packing by minimum bin slack.

Every document becomes its token ids and one end id. Documents are cut freely: whole windows of ``capacity`` ids
first, then the remainders are packed. For the multiset of remaining lengths a bitset subset-sum dynamic programme
finds the sub-multiset that fills a window closest to its capacity (a Python integer is the bitset: bit s is set if
some sub-multiset sums to s); its counts are read back from the bitsets kept after each length. A pattern found is
used as often as its counts allow, so the work depends on the distinct lengths, not on the documents. Slack that is
left is filled with the head of a further remainder, whose tail is a remaining length again. What is left at the end
is under one window and is cut into sequences whose lengths are powers of two, so no id of padding is needed.

Remainders are planned together for a run of documents of one task (``group_tokens`` ids): no shuffle, bounded memory,
no hot key, and the same result if the task is run again.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are packed one by one;
an empty table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import read_table
from tidewater.llm.tokens import encoder, with_end

CAPACITY = 2048
#: Ids whose remainders are planned together.
GROUP_TOKENS = 2_000_000
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def fullest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """Counts by length of the sub-multiset of ``counts`` that holds ``first`` and sums closest to ``capacity``
    from below."""
    mask = (1 << (capacity + 1)) - 1
    reach, kept = 1 << first, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), (capacity - first) // length)
        if left <= 0:
            continue
        kept.append((length, left, reach))
        step = 1
        while left > 0:  # counts in powers of two: every number up to the count is a sum of them
            step = min(step, left)
            reach |= reach << (length * step) & mask
            left -= step
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    used = defaultdict(int, {first: 1})
    for length, left, before in reversed(kept):
        n = next(n for n in range(left + 1) if total >= n * length and before >> (total - n * length) & 1)
        used[length] += n
        total -= n * length
    return {k: n for k, n in used.items() if n}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Where the remainders go. ``counts``: how many there are of each length below ``capacity``.

    Returns the intervals of ranks ``(length, from_rank, take, per_window, sequence, offset, next_length, next_rank)``:
    of the remainders of that length, from that rank on, each gives its first ``take`` ids to a window (``per_window``
    of them to one, at ``offset`` and on, windows counted from ``sequence``); if ``next_length`` is not 0, its other
    ids are the remainder of that length with ranks from ``next_rank``. And ``(sequence, windows, length)``."""
    left, low, high = dict(counts), defaultdict(int), defaultdict(int, counts)
    rows, windows, sequence = [], [], 0

    def used_up(length: int, n: int) -> None:
        low[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def cut(length: int, take: int, at: int, offset: int, times: int) -> None:
        rest = length - take
        rows.append((length, low[length], take, 1, at, offset, rest, high[rest]))
        used_up(length, times)
        if rest:
            left[rest] = left.get(rest, 0) + times
            high[rest] += times

    while left and sum(k * n for k, n in left.items()) >= capacity:
        used = fullest(left, max(left), capacity)
        slack = capacity - sum(k * n for k, n in used.items())
        times = min(left[k] // n for k, n in used.items())
        if slack:
            over = {k: left[k] - used.get(k, 0) for k in left}
            head = max(k for k in over if over[k] > 0)  # longer than the slack, or it would have been taken
            times = min([left[k] // (n + (k == head)) for k, n in used.items()] + [left[head] // (used.get(head, 0) + 1)])
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, low[length], length, used[length], sequence, offset, 0, 0))
            offset += length * used[length]
            used_up(length, times * used[length])
        if slack:
            cut(head, slack, sequence, offset, times)
        windows.append((sequence, times, capacity))
        sequence += times
    rest = sum(k * n for k, n in left.items())
    while rest:
        size, offset = 1 << (rest.bit_length() - 1), 0
        while offset < size:
            length = max(left)
            take = min(length, size - offset)
            cut(length, take, sequence, offset, 1)
            offset += take
        windows.append((sequence, 1, size))
        sequence, rest = sequence + 1, rest - size
    return rows, windows


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Pieces of documents with these ids each, as rows (document, start, length, sequence, offset, sequence length)."""
    whole, rest = lengths // capacity, lengths % capacity
    docs = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)
    n_whole = len(docs)
    out = [np.column_stack([docs, nth * capacity, np.full(n_whole, capacity), np.arange(n_whole), np.zeros(n_whole, np.int64), np.full(n_whole, capacity)])]
    item = np.flatnonzero(rest)
    length, start = rest[item], (whole * capacity)[item]
    by_length = np.argsort(length, kind="stable")
    first = np.searchsorted(length[by_length], length[by_length])
    rank = np.empty(len(item), np.int64)
    rank[by_length] = np.arange(len(item)) - first
    sizes, n_each = np.unique(length, return_counts=True)
    rows, windows = plan(dict(zip(sizes.tolist(), n_each.tolist(), strict=True)), capacity)
    if not rows:
        return out[0].astype(np.int64)
    table = np.array(sorted(rows), np.int64)
    wide = np.int64(1) << np.int64(40)
    keys = table[:, 0] * wide + table[:, 1]
    seq_from, seq_size = np.array([w[0] for w in windows]), np.array([w[2] for w in windows])
    while len(item):
        at = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
        nth, take = rank - at[:, 1], at[:, 2]
        seq = at[:, 4] + nth // at[:, 3]
        out.append(np.column_stack([item, start, take, n_whole + seq, at[:, 5] + nth % at[:, 3] * take, seq_size[np.searchsorted(seq_from, seq, side="right") - 1]]))
        more = at[:, 6] > 0
        item, start, length, rank = item[more], (start + take)[more], at[more, 6], (at[:, 7] + nth)[more]
    return np.concatenate(out).astype(np.int64)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack ``doc_id, text`` into sequences of at most ``capacity`` ids; one row for each piece.

    ``path``: tokenizer file of the tokenizers library (the 50k byte-level vocabulary if None)."""
    def run(batches):
        encode = encoder("byte_bpe_50k.json" if path is None else path)
        base = np.int64(TaskContext.get().partitionId()) << np.int64(40)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal base
            doc_id = pa.concat_arrays([d for d, _, _ in held])
            ids = np.concatenate([i for _, i, _ in held])
            lengths = np.concatenate([np.diff(b) for _, _, b in held])
            held.clear()
            begin = np.cumsum(lengths) - lengths
            p = pack_group(lengths, capacity)
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            at = begin[p[:, 0]] + p[:, 1]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + p[:, 2]).tolist(), strict=True)]
            out = [doc_id.take(pa.array(p[:, 0])), *map(pa.array, (p[:, 1], p[:, 2], np.array(crc, np.int64), lengths[p[:, 0]], base + p[:, 3], p[:, 4], p[:, 5]))]
            base += p[:, 3].max() + 1
            return pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for a, b, ids, begin in encode.slices(batch.column("text")):
                held.append((batch.column("doc_id").slice(a, b - a), *with_end(ids, begin, end_id)))
                if sum(len(i) for _, i, _ in held) >= group_tokens:
                    yield flush()
        if held:
            yield flush()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
