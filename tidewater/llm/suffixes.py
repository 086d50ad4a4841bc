"""Removal of passages that an earlier document has, by column-wise construction of collection suffix arrays.

Every string of ``LENGTH`` bytes is assigned to a shard by its minimizer (the least hash of its ``GRAM``-byte grams), so
equal strings meet in one shard. Strings that follow each other and have the same minimizer form a segment of at most
LENGTH + WINDOWS - 1 bytes. Equal segments of the texts that a task cuts at a time become one, with the least and the
greatest doc_id that have it, before they are shipped, packed with others of their task and shard and compressed; so a
shard gets a passage once for each ``PACK_BYTES`` of text at most, not once for each document. Which segments lie where
in a pack's documents stays in a directory of the pack (about a byte for each different segment); a shard answers each
pack with the places in its blob of the segments that lose bytes and the earliest document of each of their strings, so
occurrences are never shuffled.

A shard builds the Burrows-Wheeler transform and the longest common prefixes of its segments column by column: round j
inserts, for each segment, the suffix of j bytes; the place follows from the symbols before it in the transform (a
stable sort of the last round's transform), and the common prefixes with both neighbours from the least prefixes
between occurrences of its first symbol. The transform and the prefixes stream through two mapped files each, read and
written in order once a round, in a folder of the task that goes with it. Rounds are bounded by the longest segment, whatever
the documents' lengths. Segments that come to a shard several times are inserted once, and those that share no gram of
``PROOF`` bytes chosen by its hash with another segment or document can't hold a repeated string and are left out.

In the finished order, strings of LENGTH bytes are equal where all prefixes between them are at least LENGTH; the
smallest doc_id of each such run decides. Covered bytes are joined to spans for each document.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes lose none; rows that
repeat a doc_id are one document to the others, and none of them removes from the other, but each loses the bytes of its
own text only (rows are told apart by doc_id and a hash of the text); an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import shutil
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_rows, mix64, read_table, saved, utf8_of

LENGTH, GRAM, PROOF = 50, 12, 44
WINDOWS = LENGTH - GRAM + 1
#: Bytes of segments in a shard, and the bytes of segments for each byte of text (from the lengths above).
SHARD_BYTES, BLOW_UP = 8 << 20, 3.5
#: Bytes of text that a task cuts into segments at a time.
PACK_BYTES = 10 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on (size: a multiple of 4, 8 at least)."""
    n = len(data) - size + 1
    wide = lambda at, n: np.array(np.ndarray((n,), "<u8", data, at, (1,)))
    if size < 16:
        h = mix64(wide(0, n))
        return mix64(h * np.uint64(0x9E3779B97F4A7C15) + wide(size - 8, n)) if size % 8 else h
    h, done = mix64(wide(0, len(data) - 7)), 8
    while done < size:  # from two hashes of ``done`` bytes, which may overlap
        step = min(done, size - done)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * done) + h[step:]
        done += step
    return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def least_hashes(data: np.ndarray, size: int, width: int) -> np.ndarray:
    """The least hash of ``width`` grams of ``size`` bytes from each place on; block by block, as blocks stay in the
    processor's cache."""
    n = len(data) - size - width + 2
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        out[at:to] = sliding_min(gram_hashes(data[at:to + size + width - 2], size), width)
    return out


def runs(values: np.ndarray, most: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values, cut at ``breaks`` (true: starts anew) and after ``most``."""
    new = np.empty(len(values), bool)
    new[:1] = True
    new[1:] = values[1:] != values[:-1]
    new |= breaks
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(values)))
    pieces = -(-length // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(start, pieces) + nth * most
    return starts, np.minimum(most, np.repeat(start + length, pieces) - starts)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and for each segment: text number, start in the bytes, number of strings, minimizer. Texts begin at
    the running sum of the lengths."""
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    size = np.array(list(map(len, texts)), np.int64)
    begin = np.cumsum(size) - size
    total = int(size.sum())
    if total < LENGTH:
        return data, *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64)
    least = least_hashes(data[:total], GRAM, WINDOWS)
    breaks = np.zeros(len(least), bool)
    breaks[begin[begin < len(least)]] = True
    inside = np.maximum(0, begin + size - LENGTH + 1)  # strings from here on would cross the text's end
    inside = np.maximum(inside, begin)
    breaks[inside[inside < len(least)]] = True
    start, count = runs(least, WINDOWS, breaks)
    text = np.searchsorted(begin, start, side="right") - 1
    fits = start + LENGTH <= begin[text] + size[text]
    return data, text[fits], start[fits], count[fits], least[start[fits]]


def segment_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each segment, of its first and its last 48 bytes, which cover a segment of up to 2 * 48 bytes whole."""
    wide = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))  # the 8 bytes from each place on, without a copy

    def part(at: np.ndarray) -> np.ndarray:
        h = mix64(wide[at])
        for k in range(8, 48, 8):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + wide[at + k])
        return h
    return part(start), part(start + length - 48)


def distinct(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key occurs first, and the number of each entry's key. (Keys of one mixed hash, if there ever
    are, may come apart; equal segments that do only cost a second entry.)"""
    mixed = mix64(a * np.uint64(0x9E3779B97F4A7C15) + b) + length.astype(np.uint64)
    order = np.argsort(mixed)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(x[order]) != 0 for x in (a, b, length)])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return (np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order), which


def bounds_of(which: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``low`` and the greatest of ``high`` for each of ``n`` keys."""
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, which, low)
    np.maximum.at(most, which, high)
    return least, most


def cut(docs: DataFrame, flush: Callable[[list, list, list], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``flush`` makes of the ids, text hashes and texts of about ``PACK_BYTES``, for texts that can lose a byte."""
    def run(batches):
        ids, hashes, texts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), utf8_of(batch), strict=True):
                if doc_id is not None and len(text) >= LENGTH:
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    texts.append(text)
                    held += len(text)
                if held >= PACK_BYTES:
                    if (out := flush(ids, hashes, texts)) is not None:
                        yield out
                    ids, hashes, texts, held = [], [], [], 0
        if texts and (out := flush(ids, hashes, texts)) is not None:
            yield out
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def packed(docs: DataFrame, n_shards: int) -> DataFrame:
    """For each pack of many texts and shard a row with a blob of the different segments there: least and greatest doc_id,
    strings of each; their bytes. And a row for each pack, with a negative shard, that holds its directory: ids, text
    hashes and numbers of segments of its texts; shard and strings of each different segment, by first place, and the
    step of these numbers from each segment in the texts to the next."""
    def flush(ids: list, hashes: list, texts: list) -> pa.RecordBatch | None:
        press = zstandard.ZstdCompressor(level=1).compress
        data, text, start, count, least = segments(texts)
        if not len(start):
            return None
        pick, which = distinct(*segment_keys(data, start, count + LENGTH - 1), count)
        by_place = np.argsort(pick)
        number = np.empty(len(pick), np.int64)
        number[by_place] = np.arange(len(pick))
        pick, which = pick[by_place], number[which]
        doc = np.array(ids, np.int64)[text]
        low, high = bounds_of(which, len(pick), doc, doc)
        shard = (mix64(least[pick]) % np.uint64(n_shards)).astype(np.int32)
        known = np.array([ids, hashes], np.int64).tobytes()
        # told by its contents too: answers to another cut of the texts, by a lost task, would meet no directory
        task = TaskContext.get()
        nth[0] += 1
        pack = int.from_bytes(hashlib.blake2b(known + f"{task.partitionId() if task else 0} {nth[0]}".encode(), digest_size=8).digest(), "little", signed=True)
        directory = known + np.bincount(text, minlength=len(ids)).astype(np.int32).tobytes()
        inside = shard.tobytes() + count[pick].astype(np.uint8).tobytes() + np.diff(which, prepend=np.int64(0)).astype(np.int32).tobytes()
        dense = zstandard.ZstdCompressor(level=3).compress
        rows = [(pack, -1 - pack % n_shards, len(pick), dense(directory), dense(inside))]
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for k in range(n_shards):
            i = order[bounds[k]:bounds[k + 1]]
            if len(i):
                head = np.concatenate([np.diff(low[i], prepend=np.int64(0)).view(np.uint8), (high[i] - low[i]).view(np.uint8), count[pick[i]].astype(np.uint8)])
                rows.append((pack, k, len(i), press(head.tobytes()), press(gather(data, start[pick[i]], count[pick[i]] + LENGTH - 1).tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["pack", "shard", "n", "head", "data"])
    nth = [0]  # of a task's packs
    return cut(docs, flush, "pack long, shard int, n int, head binary, data binary")


class Columns:
    """The transform and the common prefixes of the rounds, in mapped files that are read and written in order."""

    def __init__(self, folder: str, most: int, dtype):
        self.pairs = [[np.memmap(os.path.join(folder, f"{x}{i}"), t, "w+", shape=(most,)) for x, t in (("symbols", dtype), ("prefixes", np.uint8))] for i in range(2)]
        self.n = 0

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.asarray(x[:self.n]) for x in self.pairs[0])

    def fresh(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The other pair of files, for ``n`` entries, which is the one to read from then on."""
        self.pairs.reverse()
        self.n = n
        return self.read()


def places(symbols: np.ndarray, n_strings: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the symbols, and for each entry the place of the suffix that its symbol extends its suffix
    to (entries of 0, the end of a string, have none)."""
    order = np.argsort(symbols, kind="stable")
    to = np.empty(len(symbols), np.int64)
    to[order] = np.arange(len(symbols)) + (n_strings - int((symbols == 0).sum()))
    return order, to


def numbers_of(symbols: np.ndarray, counts: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers in the stable order of the entries ``at``, which are grouped by symbol and ascend in each group, as the
    order's entries do. ``counts``: of each symbol."""
    ends = np.cumsum(counts)
    mine = symbols[at]
    bounds = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(at)]
    out = np.empty(len(at), np.int64)
    for i, k in itertools.pairwise(bounds):
        symbol = int(mine[i])
        begin = int(ends[symbol - 1]) if symbol else 0
        out[i:k] = np.searchsorted(order[begin:int(ends[symbol])], at[i:k]) + begin
    return out


def range_min(x: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The least of x from start to before end, for each valid range. Ranges go by descending start, so that the
    stretch between two ranges costs nothing."""
    some = np.flatnonzero(valid)
    some = some[np.argsort(-start[some])]
    out = np.zeros(len(start), np.int64)
    if len(some):
        out[some] = np.minimum.reduceat(np.append(x, np.uint8(0)), np.column_stack([start[some], end[some]]).ravel())[::2]
    return out


def collection(data: np.ndarray, length: np.ndarray, folder: str, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes (up to ``depth``, with the suffix before) of all suffixes of the strings that lie
    one after the other in ``data``; the empty suffixes come first, by string."""
    m = len(length)
    begin = np.cumsum(length) - length
    dtype = np.uint8 if not (data == 0).any() else np.uint16
    text = data.astype(dtype) + (1 if dtype == np.uint16 else 0)  # 0 is the end of a string
    symbol = lambda i, j: np.where(j < length[i], text[np.minimum(begin[i] + length[i] - 1 - j, len(text) - 1)], 0).astype(dtype)
    files = Columns(folder, m + len(data), dtype)
    who = np.arange(m)
    symbols, prefixes = files.fresh(m)
    symbols[:], prefixes[:] = symbol(who, 0), 0
    tally = lambda column: np.bincount(column, minlength=257)
    counts = tally(symbols)
    at = who.copy()  # place of each string's longest suffix so far
    for j in range(1, int(length.max()) + 1):
        old, prefix = files.read()
        active = length[who] >= j
        who, at = who[active], at[active]  # ascending places, so that the columns are read in order
        group = np.argsort(old[at], kind="stable")
        who, at = who[group], at[group]
        order = np.argsort(old, kind="stable")
        t = numbers_of(old, counts, order, at)
        new = t + m - int(counts[0])  # the place of the longer suffix
        # the least prefix between an entry and the entries before and after it with the same symbol
        first, last = order[np.maximum(t - 1, 0)], order[np.minimum(t + 1, len(order) - 1)]
        has_first = (t > 0) & (old[first] == old[at])
        has_last = (t + 1 < len(order)) & (old[last] == old[at])
        before = np.where(has_first, np.minimum(range_min(prefix, first + 1, at + 1, has_first) + 1, depth), 0)
        after = np.where(has_last, np.minimum(range_min(prefix, at + 1, last + 1, has_last) + 1, depth), 0)
        n = len(old) + len(new)
        added = np.zeros(n, bool)
        added[new] = True
        symbols, prefixes = files.fresh(n)
        more = symbol(who, np.int64(j))
        counts += tally(more)
        symbols[new] = more
        symbols[~added] = old
        prefixes[~added] = prefix
        behind = new + 1 < n
        prefixes[(new + 1)[behind]] = after[behind]
        prefixes[new] = before
        at = new
    return files.read()


def string_classes(data: np.ndarray, length: np.ndarray, folder: str) -> np.ndarray:
    """For each string of LENGTH bytes in the segments, in their order: a number that equal strings share."""
    m = len(length)
    symbols, prefixes = collection(data, length, folder)
    _, to = places(symbols, m)
    run = np.cumsum(prefixes < LENGTH)
    strings = length - LENGTH + 1
    first = np.cumsum(strings) - strings
    out = np.empty(int(strings.sum()), np.int64)
    who, at = np.arange(m), np.arange(m)
    for j in range(1, int(length.max()) + 1):  # from each empty suffix to the longer ones
        active = length[who] >= j
        who, at = who[active], to[at[active]]
        if j >= LENGTH:
            out[first[who] + length[who] - j] = run[at]
    return out


def candidates(data: np.ndarray, start: np.ndarray, length: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which segments can hold a string that another has: each string's least hash of PROOF-byte grams is compared.
    ``several``: segments that more than one document has."""
    least = least_hashes(data, PROOF, LENGTH - PROOF + 1)
    strings = length - LENGTH + 1
    value = gather(least, start, strings)
    owner = np.repeat(np.arange(len(start)), strings)
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    value, owner = value[new], owner[new]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    same = np.append(value[1:] == value[:-1], False) & np.append(owner[1:] != owner[:-1], False)
    found = several.copy()
    group = np.cumsum(np.append(True, value[1:] != value[:-1])) - 1
    shared = np.zeros(group[-1] + 1, bool)
    shared[group[same]] = True
    found[owner[shared[group]]] = True
    return found


def shard_earliest(heads: list[tuple[int, bytes]], blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each blob of one shard: the places there of the segments that a document of its pack can lose bytes of, and the
    least doc_id of each of their strings."""
    grow = zstandard.ZstdDecompressor().decompress
    lows, highs, counts = [], [], []
    for n, head in heads:
        head = np.frombuffer(grow(head), np.uint8)
        lows.append(np.cumsum(head[:8 * n].view(np.int64)))
        highs.append(lows[-1] + head[8 * n:16 * n].view(np.int64))
        counts.append(head[16 * n:].astype(np.int64))
    low, high, count = map(np.concatenate, (lows, highs, counts))
    data = np.frombuffer(b"".join(map(grow, blobs)), np.uint8)
    length = count + LENGTH - 1
    begin = np.cumsum(length) - length
    pick, which = distinct(*segment_keys(data, begin, length), count)
    first_doc, last_doc = bounds_of(which, len(pick), low, high)
    use = np.flatnonzero(candidates(data, begin[pick], length[pick], first_doc < last_doc))
    none = np.zeros(0, np.int64)
    if not len(use):
        return [(none, none)] * len(heads)
    folder = tempfile.mkdtemp(prefix="columns-")
    try:
        classes = string_classes(gather(data, begin[pick[use]], length[pick[use]]), length[pick[use]], folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    strings = count[pick[use]]
    earliest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, classes, np.repeat(first_doc[use], strings))
    earliest = earliest[classes]
    first = np.cumsum(strings) - strings
    least = np.full(len(pick), np.iinfo(np.int64).max)
    least[use] = np.minimum.reduceat(earliest, first)
    place = np.zeros(len(pick), np.int64)
    place[use] = first
    out, end = [], 0
    for n, _ in heads:
        mine, end = slice(end, end + n), end + n
        lose = np.flatnonzero(least[which[mine]] < high[mine])
        out.append((lose, gather(earliest, place[which[mine][lose]], count[mine][lose])))
    return out


def answers(group: pa.Table) -> pa.Table:
    """What a shard finds for each pack (places in its blob, earliest documents); directories pass."""
    columns = [group.column(c).to_pylist() for c in ("pack", "shard", "n", "head", "data")]
    if columns[1][0] < 0:
        return group.select(["pack", "shard", "head", "data"])
    pack, shard, n, head, data = columns
    press = zstandard.ZstdCompressor(level=3).compress
    rows = [(p, k, press(np.diff(lose, prepend=np.int64(0)).astype(np.int32).tobytes()), press(earliest.tobytes()))
            for p, k, (lose, earliest) in zip(pack, shard, shard_earliest(list(zip(n, head, strict=True)), data), strict=True) if len(lose)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["pack", "shard", "head", "data"])


def covered(doc: np.ndarray, text_hash: np.ndarray, at: np.ndarray, n: np.ndarray, earliest: np.ndarray) -> list[np.ndarray]:
    """doc_id, text_hash, start, length of the bytes to remove of occurrences, by the earliest document of each of their strings."""
    owner = np.repeat(np.arange(len(n)), n)
    gone = earliest < doc[owner]
    place = np.arange(len(gone)) - np.repeat(np.cumsum(n) - n, n)
    new = gone & ~(np.append(False, gone[:-1]) & np.append(False, owner[1:] == owner[:-1]))
    from_ = np.flatnonzero(new)
    size = np.add.reduceat(gone.astype(np.int64), from_) if len(from_) else from_
    who = owner[from_]
    return [doc[who], text_hash[who], (at[who] + place[from_]).astype(np.int32), (size + LENGTH - 1).astype(np.int32)]


def spans_of(group: pa.Table) -> pa.Table:
    """The bytes to remove of the documents of one pack, from its directory and the answers of the shards."""
    grow = zstandard.ZstdDecompressor().decompress
    shards, heads, blobs = (group.column(c).to_pylist() for c in ("shard", "head", "data"))
    d = next((i for i, k in enumerate(shards) if k < 0), None)
    if d is None:
        raise RuntimeError("answers to a pack that is not there: the documents were cut anew in between")
    head, inside = grow(heads[d]), grow(blobs[d])
    n_docs = len(head) // 20
    ids, hashes = np.frombuffer(head, np.int64, 2 * n_docs).reshape(2, n_docs)
    per_doc = np.frombuffer(head, np.int32, n_docs, 16 * n_docs)
    total = int(per_doc.sum())
    n = (len(inside) - 4 * total) // 5
    shard = np.frombuffer(inside, np.int32, n)
    strings = np.frombuffer(inside, np.uint8, n, 4 * n).astype(np.int64)
    which = np.cumsum(np.frombuffer(inside, np.int32, total, 5 * n), dtype=np.int64)
    order = np.argsort(shard, kind="stable")  # the segments as they lie in the shards' blobs
    begin = np.searchsorted(shard[order], np.array(shards))
    place = np.full(n, -1)
    answer, held = [], 0
    for i, k in enumerate(shards):
        if k >= 0:
            lose = order[begin[i] + np.cumsum(np.frombuffer(grow(heads[i]), np.int32), dtype=np.int64)]
            place[lose] = held + np.cumsum(strings[lose]) - strings[lose]
            answer.append(np.frombuffer(grow(blobs[i]), np.int64))
            held += len(answer[-1])
    earliest = np.concatenate([np.zeros(0, np.int64), *answer])
    text = np.repeat(np.arange(n_docs), per_doc)
    size = strings[which]
    at = np.cumsum(size) - size  # segments lie side by side from each text's start
    at -= np.repeat(at[(np.cumsum(per_doc) - per_doc).clip(max=max(0, total - 1))], per_doc)
    lost = np.flatnonzero(place[which] >= 0)
    parts = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]]
    for i in range(0, len(lost), 1 << 15):
        o = lost[i:i + (1 << 15)]
        parts.append(covered(ids[text[o]], hashes[text[o]], at[o], size[o], gather(earliest, place[which[o]], size[o])))
    return pa.table(list(map(np.concatenate, zip(*parts, strict=True))), names=["doc_id", "text_hash", "start", "length"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, length of covered bytes; spans of one text may touch or overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, int(total * BLOW_UP / SHARD_BYTES) + 1)
    found = saved(packed(docs, n_shards).groupBy("shard").applyInArrow(answers, "pack long, shard int, head binary, data binary"), "repeated")
    return found.groupBy("pack").applyInArrow(spans_of, "doc_id long, text_hash long, start int, length int")


def with_spans(docs: DataFrame) -> DataFrame:
    spans = saved(removed_spans(docs), "covered")
    each = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_text")).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return docs.join(each, (F.col("doc_id") == F.col("span_id")) & (F.xxhash64("text") == F.col("span_text")), "left").drop("span_id", "span_text")


def kept_parts(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int]:
    """The bytes that stay, and the number of removed runs."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, np.minimum(starts, len(text)), 1)
    np.add.at(edge, np.minimum(starts + lengths, len(text)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int((gone & ~np.append(False, gone[:-1])).sum())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(utf8_of(batch), batch.column("spans"), strict=True):
            kept, n = text, 0
            if spans.is_valid and len(spans):
                starts, lengths = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("start", "length"))
                kept, n = kept_parts(text, starts, lengths)
            rows.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    rows = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return map_rows(rows, lambda: step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
