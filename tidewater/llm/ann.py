"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``prefix`` nearest pivots among ``n_pivots`` (a bounded sample of the
vectors; every row is indexed). The vectors are dealt over blocks of about ``BLOCK`` rows; a block posts its vectors,
with the place of the pivot in their order, in one inverted file for each pivot. A query reads the files of its own
nearest pivots, and the places met there give the footrule distance of the two orders (pivots missing from an order
count as the place after its last): with places i and j below L, each shared pivot takes 2 (L - max(i, j)) from a
distance that is the same for all. The ``share`` of a block that is nearest by footrule (ties: smaller vec_id) is scored
exactly, and the best of all blocks are merged.

Queries are a stated set of rows, searched in blocks against blocks of all rows: a task holds one block of vectors and
one of queries, whatever the size of the table or the number of equal vectors. For the largest inner product, vectors
get one more component that makes all of them as long as the longest, and pivots are vectors with theirs. A query's own
order has 0 there, whatever its length: so the vectors nearest to it are those of the largest product, not those that
lie near it.

Recall at 20 on random vectors of 64 dimensions is above 0.9 for unit vectors, plain Gaussian ones and ones of mixed
lengths (measured in the tests).

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; equal vectors are ordered by vec_id; a row is no candidate for its own vec_id; of rows with the same vec_id
each is a candidate and the first a query; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import map_rows, read_table, saved

N_PIVOTS, PREFIX, SHARE, LEAST = 512, 96, 0.1, 400
#: Vectors and queries that a task holds.
BLOCK, QUERY_BLOCK = 8192, 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                   & F.exists("vector", lambda x: x != 0)))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0].n if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, longest * longest - (x * x).sum(1)))])


def index(rows: DataFrame, n_pivots: int = N_PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """Rows of ``usable`` with the order of their nearest pivots as vectors (near) and as queries (asked): int16 numbers
    in binary columns."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    sample = rows.dropDuplicates(["vector"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()  # bounded: n_pivots rows
    pivots = lifted(np.array([r.vector for r in sample], np.float64), longest) if sample else np.zeros((0, 1))
    n = min(prefix, len(pivots))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("vector"))
        orders = [np.argsort(-products, axis=1, kind="stable")[:, :n].astype(np.int16) for products in (lifted(x, longest) @ pivots.T, x @ pivots[:, :-1].T)]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *(pa.array([o.tobytes() for o in order], pa.binary()) for order in orders)], names=["vec_id", "vector", "near", "asked"])
    return map_rows(rows, lambda: step, "vec_id long, vector array<double>, near binary, asked binary")


def search_block(ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_near: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vec_ids and scores of the best ``k`` of a block for each query. ``ids`` ascend."""
    n, length = near.shape
    flat = near.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by_pivot], np.arange(int(flat.max()) + 2))
    posted, worth = by_pivot // length, (length - by_pivot % length).astype(np.float64)
    ranked = max(least, k + 1, math.ceil(share * n))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, vector, order in zip(query_ids, queries, query_near, strict=True):
        files = [(i, ends[p], ends[p + 1]) for i, p in enumerate(order.tolist()) if p + 1 < len(ends)]
        who = np.concatenate([posted[a:b] for _, a, b in files])
        gain = np.concatenate([np.minimum(worth[a:b], length - i) for i, a, b in files])
        total = np.bincount(who, gain, n)  # the higher, the nearer by footrule
        if n > ranked:
            last = np.partition(total, n - ranked)[n - ranked]
            above = np.flatnonzero(total > last)
            best = np.concatenate([above, np.flatnonzero(total == last)[:ranked - len(above)]])
        else:
            best = np.arange(n)
        best = best[ids[best] != q]
        score = (vectors[best] * vector).sum(1)
        top = np.lexsort((ids[best], -score))[:k]
        out.append((np.full(len(top), q), ids[best[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(indexed: DataFrame, query: DataFrame, k: int = 20, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score. ``query``: rows of ``indexed``."""
    n_blocks = max(1, math.ceil(indexed.count() / BLOCK))
    asked = query.dropDuplicates(["vec_id"])
    n_query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = (indexed.select(deal(n_blocks).alias("block"), every(n_query_blocks).alias("query_block"), F.lit(False).alias("asks"), "vec_id", "vector", "near")
            .unionByName(asked.select(every(n_blocks).alias("block"), deal(n_query_blocks).alias("query_block"), F.lit(True).alias("asks"), "vec_id", "vector", F.col("asked").alias("near"))))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        there, here = group.filter(pa.array(~asks)).sort_by("vec_id"), group.filter(pa.array(asks))
        names = ["query_id", "vec_id", "score"]
        if not there.num_rows or not here.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        orders = lambda t: np.frombuffer(b"".join(t.column("near").to_pylist()), np.int16).reshape(t.num_rows, -1)
        found = search_block(there.column("vec_id").to_numpy(), matrix(there.column("vector")), orders(there), here.column("vec_id").to_numpy(), matrix(here.column("vector")), orders(here), k, share, least)
        return pa.table(dict(zip(names, found, strict=True)))

    found = rows.groupBy("block", "query_block").applyInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = saved(index(usable(read_table(spark, sf_dir, "embeddings"))), "permutations")
    return search(indexed, indexed.where(F.col("vec_id") % 20 == 0))
