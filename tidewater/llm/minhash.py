"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch of a set has ``COORDINATES`` bins. In round i each element goes to one bin with the value (i, hash): in the
first rounds to a hashed bin, in the later ones all elements to bin i - t, so every bin is filled after 2 t rounds at
most, and mostly after a few; a bin keeps its least value. Bins of two sets agree with the probability of their Jaccard
similarity, and agree less unevenly than independent minima would. Bands of ``ROWS`` bins form bucket keys: a pair of
similarity 0.85 (0.8) shares none of the ``BANDS`` buckets with a probability of 6e-9 (3e-6).

Copies (equal sets) are one class with a written number, represented by the row of the smallest doc_id. Links between classes are found without all
pairs of a bucket: in each round every bucket names one hub, members in another component than the hub are verified
against it on the full sets, and components are joined. After ``HUB_ROUNDS`` rounds, the classes of buckets that still
hold several components are compared exactly: those of different components that share one of their rarest shingles
(prefix filter, see ``rare_pairs``) are verified pair by pair, so that no link between them is lost.

Hot buckets are never collected: hubs come from an aggregate, and pairs from joins that adaptive execution splits.
Tables between rounds are written to the shared folder.

Defined results: texts without a word have an empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle; repeated rows are copies; rows that repeat a doc_id with other texts are linked by their texts
only; a row with a null doc_id is a document of its own, and a component without any doc_id has the id null; an empty
table gives no row; further columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import Memo, map_rows, mix64, read_table, saved

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
HUB_ROUNDS = 3
#: Rows of a batch that are sketched together.
SLICE_ROWS = 500


def word_hashes(column: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case) and the number of words of each text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(column.fill_null("")), r"[ \t\n\v\f\r]+")
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(parts.offsets.to_numpy()))
    coded = flat.dictionary_encode()
    table = np.array([memo[w] for w in coded.dictionary.to_pylist()], np.uint64)
    return table[coded.indices.to_numpy()[real]], np.bincount(row[real], minlength=len(column))


def shingle_sets(column: pa.Array, size: int, memo: Memo) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words, counts = word_hashes(column, memo)
    ends = np.cumsum(counts)
    run = mix64(words + np.uint64(1))
    for k in range(1, size):
        run[:len(words) - k] = mix64(run[:len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(run[a:b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` bins for each set that isn't empty."""
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(len(sets) * t, never)
    for i in range(2 * t):
        h = mix64(values ^ mix64(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at = row * t + ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else row * t + (i - t)
        np.minimum.at(bins, at, (np.uint64(i) << np.uint64(40)) | (h & np.uint64(0xFFFFFFFFFF)))
        open_rows = (bins.reshape(-1, t) == never).any(1)
        if not open_rows.any():
            break
        if i % 4 == 3 or i == 1:
            some = open_rows[row]
            values, row = values[some], row[some]
    return bins.reshape(-1, t)


def band_keys(bins: np.ndarray) -> np.ndarray:
    parts = bins.reshape(len(bins), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(bins), 0)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def hasher() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_a, text_b (two hashes of the text, which tell rows of one doc_id apart)."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))


def sketch_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, set_hash (null if empty), keys (bucket keys)."""
    def make():
        memo = hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, keys = [], [], []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                sets = shingle_sets(batch.column("text").slice(at, SLICE_ROWS), size, memo)
                full = [s for s in sets if len(s)]
                found = iter(band_keys(sketches(full)).tolist()) if full else iter(())
                n += map(len, sets)
                digest += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys += [next(found) if len(s) else [] for s in sets]
            there = [batch.column(c) for c in ("doc_id", "text_a", "text_b")]
            return pa.RecordBatch.from_arrays([*there, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_a", "text_b", "n_shingles", "set_hash", "keys"])
        return step
    return map_rows(with_text_key(docs), make, "doc_id long, text_a long, text_b long, n_shingles long, set_hash binary, keys array<long>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """rep and its set (sorted 64-bit hashes in a binary column) for ``rep, text``."""
    def make():
        memo = hasher()
        return lambda b: pa.RecordBatch.from_arrays([b.column("rep"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), size, memo)], pa.binary())], names=["rep", "set"])
    return map_rows(texts.select("rep", "text"), make, "rep long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep))
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return map_rows(both, lambda: step, "a long, b long")


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``members`` (rep, label, n) with different labels that can be similar enough: such sets share
    one of the shingles that are rarest among the members, n - ceil(percent n / 100) + 1 of each."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("set")]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), list(map(len, parts)))), pa.array(np.concatenate(parts))], names=["rep", "shingle"])
    there = sets.join(members.select("rep"), "rep", "left_semi").select("rep", "set")
    each = map_rows(there, lambda: step, "rep long, shingle long")
    counts = each.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("times"))
    alone = counts.where("times = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    more = members.join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("rarest", F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    shared = each.join(counts.where("times > 1").select("shingle", "times"), "shingle").join(more.where("alone < rarest"), "rep")
    nth = F.row_number().over(W.partitionBy("rep").orderBy("times", "shingle"))
    posted = saved(shared.withColumn("nth", nth).where(F.col("alone") + F.col("nth") <= F.col("rarest")).select("shingle", "rep", "label", "n", (F.col("n") - F.col("alone") - F.col("nth") + 1).alias("left")), "rare-shingles")
    other = posted.select("shingle", F.struct("rep", "label", "n", "left").alias("y"))
    most = F.least("left", "y.left")  # from their first common shingle on they share so many at most
    return (posted.join(other, "shingle").where((F.col("rep") < F.col("y.rep")) & (F.col("label") != F.col("y.label")) & (100 * most >= percent * (F.col("n") + F.col("y.n") - most)))
            .select(F.col("rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def joined(edges: DataFrame, name: str) -> DataFrame:
    """node, label: the least node of each node's connected component, for the nodes of ``edges`` (a, b).

    Each step points every node at the least label among itself and its neighbours and at that label's own label."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = step.join(labels.select(F.col("node").alias("to"), F.col("label").alias("then")), "to", "left")
        new = saved(jump.select("node", F.least("to", F.coalesce("then", "to")).alias("label"), "was"), f"{name}-labels")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def first_row() -> Column:
    """The row that stands for several: the smallest doc_id, null ones last; then by text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_a", "text_b"))


def linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For each row: doc_id, text_a, text_b, n_shingles, set_hash, label (the number of its component, null if the set is
    empty); and for each component: label, first (its row of the smallest doc_id)."""
    rows = saved(sketch_rows(docs, size), "sketches")
    classes = rows.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(first_row().alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    posted = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    members = saved(posted.join(shared, "key"), "buckets")
    involved = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "text_a", "text_b")))
    same = (F.col("text_a") == F.col("first_text_a")) & (F.col("text_b") == F.col("first_text_b")) & F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    sets = saved(full_sets(with_text_key(docs).join(involved, same), size).dropDuplicates(["rep"]), "sets")
    labels = None  # node -> label of the classes that have a link
    edges = tested = None
    for r in range(HUB_ROUNDS + 1):
        if labels is None:
            now = members.withColumn("label", F.col("rep"))
        else:
            now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        close = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
        if r < HUB_ROUNDS:
            hub = F.min(F.struct(F.lit(0) if r == 0 else F.xxhash64("rep", F.lit(r)), F.col("rep").alias("hub"), F.col("label").alias("label"), F.col("n").alias("n"))).alias("hub")
            hubs = now.groupBy("key").agg(hub, F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", "hub")
            pairs = (now.join(hubs, "key").where((F.col("label") != F.col("hub.label")) & close)
                     .select(F.least("rep", "hub.hub").alias("a"), F.greatest("rep", "hub.hub").alias("b")).distinct())
        else:
            open_keys = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
            left = saved(now.join(open_keys, "key", "left_semi").select("rep", "label", "n").distinct(), "open-members")
            if left.isEmpty():
                break
            pairs = rare_pairs(left, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, f"pairs-{r}")
        if pairs.isEmpty():
            if r < HUB_ROUNDS:
                continue
            break
        found = saved(verified(pairs, sets, percent), f"links-{r}")
        edges = found if edges is None else edges.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            labels = joined(edges, f"round-{r}")
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        classes = classes.withColumn("label", F.lit(None).cast("long"))
    classes = classes.select("set_hash", F.coalesce("label", "rep").alias("label"), "first")
    known = rows.select("doc_id", "text_a", "text_b", "n_shingles", "set_hash").join(classes.select("set_hash", "label"), "set_hash", "left")
    return known, classes.groupBy("label").agg(F.min("first").alias("first"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``doc_id, text``: doc_id, n_shingles, component_id (its smallest doc_id), kept (the row has that id)."""
    known, firsts = linked(docs, size, percent)
    known = known.join(firsts.select("label", F.col("first.doc_id").alias("smallest"), F.lit(True).alias("full")), "label", "left")
    component = F.when(F.col("full"), F.col("smallest")).otherwise(F.col("doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each group of near duplicates stays, all columns as they were. Texts without a word
    stay, but of those with the same doc_id one."""
    known, firsts = linked(docs, size, percent)
    empty = known.where(F.col("set_hash").isNull())
    kept = (firsts.select("first.doc_id", "first.text_a", "first.text_b", F.lit(False).alias("each"))
            .unionByName(empty.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(first_row().alias("first")).select("first.doc_id", "first.text_a", "first.text_b", F.lit(False).alias("each")))
            .unionByName(empty.where(F.col("doc_id").isNull()).select("doc_id", "text_a", "text_b", F.lit(True).alias("each")).distinct()))
    kept = kept.select(*(F.col(c).alias(f"kept_{c}") for c in ("doc_id", "text_a", "text_b", "each")))
    text_a, text_b = F.xxhash64("c_text"), F.xxhash64(F.lit(1), "c_text")
    same = (text_a == F.col("kept_text_a")) & (text_b == F.col("kept_text_b")) & F.col("c_doc_id").eqNullSafe(F.col("kept_doc_id"))
    rows = docs.toDF(*(f"c_{n}" for n in docs.columns)).join(kept, same)
    rows = rows.withColumn("kept_row", F.when(F.col("kept_each"), F.monotonically_increasing_id()))  # null: equal rows are one
    rows = rows.dropDuplicates(["kept_doc_id", "kept_text_a", "kept_text_b", "kept_row"])
    return rows.select(*(F.col(f"c_{n}").alias(n) for n in docs.columns))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_table(spark, sf_dir, "documents"), size=3, percent=85)
