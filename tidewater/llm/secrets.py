"""Secret scan with corpus-wide ownership frequency.

Regular expressions find candidates in each text; their values are hashed and counted over the whole corpus by distinct
repositories and owners. A value that many owners have is a copied example; one that stays with its owner looks live.
Owner and repository are columns of the input; the ``documents`` table has ``source`` (owner) and each document stands
for a repository.

Only built-in DataFrame functions run: positions come from splitting the text at the matches of a pattern and summing
the lengths of what lies between them, in code points.

The candidate table (the few documents with a candidate, written once to the shared folder) feeds the counts and the
verdicts, so the texts are scanned once. Counts go by (value, owner) first and by value then, so a value that a third
of all documents share is summed before the shuffle; the join back is a plain one that adaptive execution splits.

Defined results: a null or empty text has no spans; repeated rows (same doc_id and all) count as documents of their
own and each gets its row; a null owner counts as one owner; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import read_table, saved

#: Kinds of the base: pattern, group that holds the value, and the least length of that group.
BASE = {
    "assign": (r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),  # a run of 24 or more starts where a shorter pattern's run would
}
#: Kinds that the method adds, of any length: a key runs, over header lines too, to the next marker of five hyphens, which
#: must be its end; user names and passwords of an address run to the next delimiter (no way back, so a text without one
#: is read once). A value that at least ``COPIED_OWNERS`` owners share is an example and adds no span.
ADDED = {
    "private_key": (r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?>[\s\S]*?-----)END [A-Z0-9 ]*PRIVATE KEY-----)", 1, 1),
    "github": (r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    "slack": (r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15),
    # begins where no character of its class stands before, with no way back: a run of them is read once
    "jwt": (r"((?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 28),
    "google": (r"(AIza[A-Za-z0-9_-]{35})", 1, 39),
    "stripe": (r"([sr]k_live_[A-Za-z0-9]{16,})", 1, 24),
    "bearer": (r"([bB]earer\x20+)([A-Za-z0-9+/_.=-]{20,})", 2, 20),
    "url": (r"([a-z][a-z0-9+]{1,15}://[^\s/:@\"']++:)([^\s/:@\"']{3,}+)(?=@)", 2, 3),
}
#: Text that every match of a kind holds: a plain search for it comes before the pattern.
SURE = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "github": "gh", "slack": "xox", "jwt": "eyJ", "google": "AIza", "stripe": "k_live_", "bearer": "earer", "url": "://"}
#: Owners with the same value from which on it counts as a copied example.
COPIED_OWNERS = 3


def spans_of(text: Column, kind: str, nth: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, nth, end, kind, value) of the matches whose value is long enough."""
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    one = F.transform(F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(between, 1, F.size(matches)).alias("b")), lambda x: F.struct(x["m"].alias("m"), x["v"].alias("v"), x["b"].alias("b")))
    empty = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string,value:string>>")
    walked = F.aggregate(
        one, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + F.length(x["m"])).alias("at"),
            F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["b"]).alias("start"), F.lit(nth).alias("nth"), (acc["at"] + x["b"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    there = text.contains(SURE[kind]) & text.rlike(pattern) if kind in SURE else text.rlike(pattern)
    return F.when(there, walked).otherwise(empty)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Rows with a candidate: doc_id, row_id, text_hash, owner, repository, spans (array of start, nth, end, kind, value hash)."""
    kinds = [*BASE.items(), *ADDED.items()]
    found = F.concat(*(spans_of(F.col("text"), kind, i, *rest) for i, (kind, rest) in enumerate(kinds)))
    return (docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.xxhash64("text").alias("text_hash"), F.col(owner).alias("owner"), F.col(repository).cast("string").alias("repository"), found.alias("spans"))
            .withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"], s["nth"], s["end"], s["kind"], F.sha2(s["value"], 256).alias("hash")))))


def verdicts(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row for each value hash: n_repositories, n_owners, live (few owners have it)."""
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return (by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
            .withColumn("live", F.col("n_owners") < copied_owners))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """For each row: doc_id, row_id, text_hash and its spans in order (start, nth, end, kind, hash, base, live); base spans and
    live-looking added ones. ``nth`` is the kind's place in the list of kinds."""
    rows = saved(candidates(docs, owner, repository), "secrets")
    found = rows.where(F.size("spans") > 0)
    each = found.select("row_id", F.explode("spans").alias("s")).select("row_id", "s.*")
    known = each.join(verdicts(found, copied_owners).select("hash", "live"), "hash")
    base = F.col("nth") < len(BASE)
    spans = (known.where(base | F.col("live")).groupBy("row_id")
             .agg(F.array_sort(F.collect_list(F.struct("start", "nth", "end", "kind", "hash", base.alias("base"), "live"))).alias("spans")))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("doc_id", "row_id", "text_hash").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", empty))


def mask(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All documents and columns; values of spans that look live are replaced by ``mark`` (for kinds with a prefix, the
    whole span is). Copied examples stay."""
    spans = (scan(docs).select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0)
             .dropDuplicates(["doc_id", "text_hash"]).alias("found"))  # equal rows have equal spans
    names = docs.columns
    marked = docs.toDF(*(f"c_{n}" for n in names)).withColumnRenamed("c_text", "text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(F.col("spans"), zero, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], mark).otherwise("")).alias("out"))))
    text = F.concat(walked["out"], F.substring(F.col("text"), walked["at"] + 1, F.length("text")))
    same = F.col("c_doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash"))
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text")
    return marked.join(spans, same, "left").select(*(masked if n == "text" else F.col(f"c_{n}").alias(n) for n in names))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                       F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
