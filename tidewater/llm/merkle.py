"""Merkle manifest of a data set: a tree for each source, a tree of their subroots, and a proof for every document.

A node is the hash (lowercase hex sha256) of its children's hex digests, ``ARITY`` consecutive nodes of the level below;
the last node of a level may have fewer, even one. Leaves of a source ascend by doc_id (null first, equal doc_ids by
digest); subroots are ordered by source (null first, by UTF-8 bytes).

Only every ``EVERY``-th level is kept, as a table of aligned blocks of ``ARITY ** EVERY`` nodes. Building reads one
kept level and writes the next. Proofs go the other way: for each block the missing levels are hashed again from its
kept nodes, the siblings of every node of the block are put before the path of the block itself, and the regenerated
nodes are dropped. So a path is shipped once for each block, and no task holds more than a block's nodes of a source.

Places of leaves come from one sort by range of (source, doc_id) and the row counts of its partitions, so a source of
any size is spread over all tasks.

Defined results: rows that repeat a doc_id are leaves of their own; a null doc_id comes first and is never tampered
with; null fields are hashed as ``-``; an empty or very long text is hashed like any other; a table without rows has
neither root nor proofs; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import map_rows, read_table, saved

ARITY, EVERY = 3, 3
BLOCK = ARITY ** EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: dict[str, Column]) -> Column:
    """The hash of the fields: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    shown = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown)), 256)


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels from ``nodes`` up, ``levels`` of them above."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i:i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def path_of(levels: list[list[str]], i: int) -> str:
    """The siblings of node ``i`` of the lowest level, level by level: place in the run, number of siblings, siblings."""
    parts = []
    for nodes in levels[:-1]:
        first = i - i % ARITY
        others = [nodes[j] for j in range(first, min(first + ARITY, len(nodes))) if j != i]
        parts.append(f"{i % ARITY}{len(others)}{''.join(others)}")
        i //= ARITY
    return "".join(parts)


def siblings(path: str) -> list[tuple[int, list[str]]]:
    """The levels of a path: place in the run, siblings."""
    out, at = [], 0
    while at < len(path):
        place, n = int(path[at]), int(path[at + 1])
        out.append((place, [path[at + 2 + 64 * j:at + 66 + 64 * j] for j in range(n)]))
        at += 2 + 64 * n
    return out


def fold(node: str, path: str) -> str:
    """The root that ``node`` and a path give."""
    for place, others in siblings(path):
        node = digest("".join([*others[:place], node, *others[place:]]))
    return node


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (tree, digest, ...) with ``i``, the place in the tree by ``order``, and ``n``, the tree's leaves."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), f"merkle-{name}")
    parts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # rows: partitions that a tree reaches over
    parts = parts.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    found = ranged.join(parts, ["tree", "part"])
    return found.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """tree, block, n, nodes (in order, at most ``BLOCK``) of nodes tree, i, n, digest and ``extra`` columns."""
    at = F.floor(F.col("i") / BLOCK).alias("block")
    one = F.struct("i", "digest", *extra)
    return nodes.groupBy("tree", at).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(one)).alias("nodes"))


class Forest:
    """Trees over rows (tree string, ``order`` columns, digest, ``extra`` columns); kept levels are written tables."""

    def __init__(self, rows: DataFrame, order: list[str], extra: list[str], name: str):
        self.spark, self.name, self.levels = rows.sparkSession, name, []
        level = saved(blocks(placed(rows, order, name), extra), f"merkle-{name}-0")
        most = level.agg(F.max("n")).first()[0] or 0
        roots = []
        while most:
            self.levels.append(level)

            def up(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for tree, block, n, nodes in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "nodes")), strict=True):
                    top = climb([x["digest"] for x in nodes], min(EVERY, height(n)))[-1]
                    out.append((tree, block, -(-n // BLOCK), top[0]))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["tree", "i", "n", "digest"])

            nodes = saved(map_rows(level.select("tree", "block", "n", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes")), lambda up=up: up, "tree string, i long, n long, digest string"), f"merkle-{name}-nodes")
            roots.append(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
            most = -(-most // BLOCK)
            if most == 1:
                break
            level = saved(blocks(nodes.where("n > 1"), []), f"merkle-{name}-{EVERY * len(self.levels)}")
        self.roots = roots[0] if roots else rows.select("tree", F.lit("").alias("root")).limit(0)
        for more in roots[1:]:
            self.roots = self.roots.unionByName(more)

    def paths(self, above: DataFrame) -> DataFrame:
        """The blocks of the leaves with the path of each block: tree, n, nodes, path and the further columns of
        ``above`` (tree, path: what is above the tree's root)."""
        more = [c for c in above.columns if c not in ("tree", "path")]
        top = len(self.levels) - 1
        start = above.withColumn("block", F.lit(0).cast("long"))
        path = None
        for k in range(top, -1, -1):
            # trees whose only block of this level is its top start here, the others get the paths of the level above
            here = start if path is None else path.unionByName(start.join(self.levels[k].where(f"n <= {BLOCK}").select("tree"), "tree", "left_semi"))
            if path is None and top:
                here = start.join(self.levels[k].select("tree").distinct(), "tree", "left_semi")
            found = self.levels[k].join(here, ["tree", "block"])
            if k == 0:
                return found
            schema = ", ".join(["tree string", "block long", "path string", *(f"{c} string" for c in more)])

            def down(batch: pa.RecordBatch, more=more) -> pa.RecordBatch:
                out = []
                for tree, n, nodes, path, *rest in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "nodes", "path", *more)), strict=True):
                    levels = climb([x["digest"] for x in nodes], min(EVERY, height(n)))
                    out += [(tree, x["i"], path_of(levels, j) + path, *rest) for j, x in enumerate(nodes)]
                names = ["tree", "block", "path", *more]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if name == "block" else pa.string()) for name, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

            path = saved(map_rows(found.select("tree", "n", "nodes", "path", *more), lambda down=down: down, schema), f"merkle-{self.name}-paths")
        return start.select("tree", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<struct<i:long,digest:string>>").alias("nodes"), "path", *more).limit(0)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (see ``siblings``), seen (the leaf of the row with ``tampered`` columns)."""
    docs = docs.select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # null first
    rows = saved(docs.select(tree.alias("tree"), "doc_id", leaf_hash(fields).alias("digest"), leaf_hash(fields | (tampered or {})).alias("seen")), "merkle-leaves")
    forest = Forest(rows, ["doc_id", "digest"], ["doc_id", "seen"], "rows")
    sources = Forest(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["source"], ["source"], "sources")
    root = sources.roots.select("root").first()
    root = root[0] if root else ""
    above = explain(sources.paths(sources.roots.select("tree", F.lit("").alias("path"))), "source string", "source")
    above = saved(above.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-sources-above")
    found = explain(forest.paths(above), "doc_id long, seen string, subroot string", "doc_id", "seen", "subroot")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", "seen")


def explain(found: DataFrame, schema: str, *names: str) -> DataFrame:
    """A row for each leaf of blocks with their paths: digest, path up to the very root, ``names`` (of node or block)."""
    of_node = [c for c in names if c not in found.columns]
    of_block = [c for c in names if c in found.columns]
    kinds = [pa.int64() if part.strip().split()[1] == "long" else pa.string() for part in schema.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, nodes, path, *rest in zip(*(batch.column(c).to_pylist() for c in ("n", "nodes", "path", *of_block)), strict=True):
            levels = climb([x["digest"] for x in nodes], min(EVERY, height(n)))
            out += [(x["digest"], path_of(levels, j) + path, *(x[c] for c in of_node), *rest) for j, x in enumerate(nodes)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.string(), *kinds], strict=True)], names=["digest", "path", *of_node, *of_block])

    return map_rows(found.select("n", "nodes", "path", *of_block), lambda: run, f"digest string, path string, {schema}")


def proofs(rows: DataFrame) -> DataFrame:
    """``manifest`` with proof_sha256 (hash of all siblings), folded_root (from ``seen`` and the path) and verified."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, folded = [], []
        for path, seen in zip(batch.column("path").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            hashes.append(digest("".join(x for _, others in siblings(path) for x in others)))
            folded.append(fold(seen, path))
        kept = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
        verified = [a == b for a, b in zip(folded, batch.column("root").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(hashes), pa.array(folded), pa.array(verified)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return map_rows(rows, lambda: run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return proofs(manifest(docs, {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}))


OP12_SQL = """
WITH RECURSIVE polynomial(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM polynomial WHERE k < 8),
remainders AS (SELECT b, v FROM polynomial WHERE k = 8),
crc(doc_id, k, c) AS (
  SELECT doc_id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, k + 1, xor(c >> 8, v) FROM crc JOIN remainders ON b = xor(c, ascii(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT) & 255
  WHERE k < length(doc_id::VARCHAR)),
even AS (SELECT doc_id FROM crc WHERE k = length(doc_id::VARCHAR) AND xor(c, 4294967295) % 2 = 0),
fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
      ELSE strlen(text) || ':' || text END, '-')) AS seen
  FROM fields),
places AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaves),
up(s, level, i, n, node) AS (
  SELECT s, 0, i, n, leaf FROM places
  UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY s, level, i // 3, n),
subroots AS (SELECT s, node AS subroot, (SELECT count(DISTINCT s) FROM places) AS n FROM up WHERE n = 1),
over(level, i, n, node) AS (
  SELECT 0, s, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // 3, n),
low(id, s, level, i, n, node, proof) AS (
  SELECT row_number() OVER (), s, 0, i, n, seen, '' FROM places
  UNION ALL
  SELECT l.id, l.s, l.level + 1, l.i // 3, (l.n + 2) // 3,
    sha256(string_agg(CASE WHEN u.i = l.i THEN l.node ELSE u.node END, '' ORDER BY u.i)),
    l.proof || coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i <> l.i), '')
  FROM low l JOIN up u ON u.s = l.s AND u.level = l.level AND u.i // 3 = l.i // 3 WHERE l.n > 1
  GROUP BY l.id, l.s, l.level, l.i // 3, l.n, l.proof),
high(id, level, i, n, node, proof) AS (
  SELECT id, 0, l.s, subroots.n, node, proof FROM low l JOIN subroots USING (s) WHERE l.n = 1
  UNION ALL
  SELECT h.id, h.level + 1, h.i // 3, (h.n + 2) // 3,
    sha256(string_agg(CASE WHEN u.i = h.i THEN h.node ELSE u.node END, '' ORDER BY u.i)),
    h.proof || coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i <> h.i), '')
  FROM high h JOIN over u ON u.level = h.level AND u.i // 3 = h.i // 3 WHERE h.n > 1
  GROUP BY h.id, h.level, h.i // 3, h.n, h.proof),
numbered AS (SELECT row_number() OVER () AS id, * FROM places),
top AS (SELECT node AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM numbered JOIN subroots USING (s) JOIN (SELECT id, node, proof FROM high WHERE n = 1) USING (id) CROSS JOIN top
"""
