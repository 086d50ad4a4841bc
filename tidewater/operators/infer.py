"""Schema inference, discovery and field profiling over JSON documents.

Documents arrive as ``(namespace cols..., doc_id, doc VARIANT[, doc_text])``.
All statistics are computed in one distributed pass per level: explode the
keys, then a partial-aggregated ``groupBy(namespace, key)``. The per-key
result is as wide as the schema, never as long as the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.types import js_string, resolve_type, variant_canonical_type
from tidewater.sources.tables import computed_once

NS = ("database", "coll")
MAP_VARIANT = "map<string,variant>"


def explode_fields(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id",
                   doc_col: str = "doc", text_col: str | None = "doc_text") -> DataFrame:
    """One row per (document, top-level key): ``pos`` is the key's position in
    the document text when the text is available (insertion order), else in
    the VARIANT's own key order. ``value`` is the VARIANT value (a JSON null
    stays a variant null; a missing key produces no row)."""
    m = F.col(doc_col).try_cast(MAP_VARIANT)
    if text_col and text_col in docs.columns:
        # once per document, not once per key
        base = computed_once(docs.select(*ns_cols, id_col, doc_col, text_col), m.alias("_m"), F.json_object_keys(F.col(text_col)).alias("_keys"))
        base = base.select(*ns_cols, id_col, "_m", F.posexplode("_keys").alias("pos", "key"))
        return base.select(*ns_cols, id_col, "pos", "key", F.element_at("_m", F.col("key")).alias("value"))
    return docs.select(*ns_cols, id_col, F.posexplode(m).alias("pos", "key", "value"))


def _doc_counts(docs: DataFrame, ns_cols) -> DataFrame:
    return docs.groupBy(*ns_cols).agg(F.count(F.lit(1)).cast("long").alias("n_docs"))


def infer_schema(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id", widen_numeric: bool = False,
                 namespaces: DataFrame | None = None, sample: int | None = None,
                 seed: int = 42) -> DataFrame:
    """T1-T3 (+T2 when ``namespaces`` lists collections that may be empty).

    Returns the schema table: one row per (namespace, column) with ordinal
    (first-seen order in ``id_col`` order), canonical type, nullable,
    primary_key, presence_count, observed_types (comma-joined, only when
    the field is mixed) and n_docs."""
    if sample is not None:
        from tidewater.sources.tables import sample_n
        docs = sample_n(docs, id_col, sample, seed=seed, partition_by=list(ns_cols))
    kv = explode_fields(docs, ns_cols, id_col).withColumn("ctype", variant_canonical_type(F.col("value")))
    per_key = kv.groupBy(*ns_cols, "key").agg(
        F.count(F.lit(1)).cast("long").alias("presence_count"),
        F.collect_set("ctype").alias("types"),
        F.min(F.struct(F.col(id_col), F.col("pos"))).alias("first_seen"),
    )
    schema = per_key.join(_doc_counts(docs, ns_cols), list(ns_cols))
    non_null = F.array_sort(F.array_remove("types", "null"))
    resolved = resolve_type(non_null, widen_numeric)
    w = Window.partitionBy(*ns_cols).orderBy("first_seen")
    out = schema.select(
        *ns_cols,
        F.row_number().over(w).cast("int").alias("ordinal"),
        F.col("key").alias("column_name"),
        resolved.alias("type"),
        ((F.col("presence_count") < F.col("n_docs")) | (resolved == "null")
         | F.array_contains("types", "null")).alias("nullable"),
        (F.col("key") == "_id").alias("primary_key"),
        "presence_count",
        F.when(F.size(non_null) > 1, F.array_join(non_null, ",")).alias("observed_types"),
        "n_docs",
    )
    if namespaces is not None:
        out = out.unionByName(empty_namespace_schema(namespaces.join(docs.select(*ns_cols).distinct(),
                                                                     list(ns_cols), "left_anti"), ns_cols))
    return out


def empty_namespace_schema(empty_ns: DataFrame, ns_cols=NS) -> DataFrame:
    """A collection with no sampled documents gets a lone ``_id objectid`` key."""
    return empty_ns.select(
        *ns_cols, F.lit(1).alias("ordinal"), F.lit("_id").alias("column_name"),
        F.lit("objectid").alias("type"), F.lit(False).alias("nullable"), F.lit(True).alias("primary_key"),
        F.lit(0).cast("long").alias("presence_count"), F.lit(None).cast("string").alias("observed_types"),
        F.lit(0).cast("long").alias("n_docs"))


def schema_warnings(schema: DataFrame, ns_cols=NS) -> DataFrame:
    """T4 (+T2): mixed_type_field (warn), all_null_field (info), empty_collection (info)."""
    name = F.col("column_name")
    mixed = schema.filter(F.col("type") == "mixed").select(
        *ns_cols, "ordinal", name, F.lit("warn").alias("severity"), F.lit("mixed_type_field").alias("code"),
        F.format_string('Field "%s" holds several types (%s); it is stored as TEXT.', name,
                        F.regexp_replace("observed_types", ",", ", ")).alias("message"))
    all_null = schema.filter(F.col("type") == "null").select(
        *ns_cols, "ordinal", name, F.lit("info").alias("severity"), F.lit("all_null_field").alias("code"),
        F.format_string('Field "%s" is null in every document; it is created as nullable TEXT.', name)
        .alias("message"))
    empty = schema.filter(F.col("n_docs") == 0).select(
        *ns_cols, F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("column_name"), F.lit("info").alias("severity"),
        F.lit("empty_collection").alias("code"),
        F.format_string('Collection "%s.%s" has no documents; only _id is created.', *[F.col(c) for c in ns_cols])
        .alias("message"))
    return mixed.unionByName(all_null).unionByName(empty)


def discovery_type(v: Column) -> Column:
    """T5 value type names of the discovery path (null is a type of its own)."""
    t = variant_canonical_type(v)
    return (F.when(t == "timestamp", F.lit("date"))
            .when(t == "jsonb", F.lit("object"))
            .when(t.isin("long", "int"), F.when(F.schema_of_variant(v).startswith("OBJECT"), t)
                  .otherwise(F.lit("int")))
            .otherwise(t))


def discover_schema(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id", first_n: int | None = None) -> DataFrame:
    """T5 + S7: discovery inference. Null is a type (int + null -> mixed) and a
    field is nullable only when some document lacks it. ``first_n`` keeps the
    first n documents per namespace in ``id_col`` order (a per-key top-n)."""
    if first_n is not None:
        w = Window.partitionBy(*ns_cols).orderBy(id_col)
        docs = docs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first_n).drop("_rn")
    kv = explode_fields(docs, ns_cols, id_col).withColumn("dtype", discovery_type(F.col("value")))
    per_key = kv.groupBy(*ns_cols, "key").agg(
        F.count(F.lit(1)).cast("long").alias("presence_count"),
        F.array_sort(F.collect_set("dtype")).alias("types"),
        F.min(F.struct(F.col(id_col), F.col("pos"))).alias("first_seen"))
    w = Window.partitionBy(*ns_cols).orderBy("first_seen")
    return per_key.join(_doc_counts(docs, ns_cols), list(ns_cols)).select(
        *ns_cols, F.row_number().over(w).cast("int").alias("ordinal"),
        F.col("key").alias("column_name"),
        F.when(F.size("types") == 1, F.col("types")[0]).otherwise(F.lit("mixed")).alias("type"),
        (F.col("presence_count") < F.col("n_docs")).alias("nullable"),
        (F.col("key") == "_id").alias("primary_key"), "presence_count",
        F.when(F.size("types") > 1, F.array_join("types", ",")).alias("observed_types"))


# -- T6-T8 field profile ---------------------------------------------------------
def profile_type(v: Column) -> Column:
    """Type names of the field profile (null excluded later)."""
    t = variant_canonical_type(v)
    return (F.when(t == "timestamp", F.lit("date"))
            .when(t == "jsonb", F.lit("object"))
            .when(t == "decimal", F.lit("decimal128"))
            .when(t.isin("uuid", "binary"), F.lit("binary"))
            .when((t == "long") & ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("int"))
            .otherwise(t))


def walk_paths(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id", max_depth: int = 5) -> DataFrame:
    """T6 walk: one row per (document, dotted path) down to depth ``max_depth``
    (objects are entered, arrays are not; the top-level ``_id`` is skipped).

    Each level is an array column built from the previous level's column with
    ``filter``/``transform`` over ``map_entries``; inside those lambdas only a
    single map cast per element is done (it answers "is this an object?").
    All levels are exploded once and typed afterwards in an ordinary
    projection, where Catalyst shares repeated subexpressions. The scan is
    read once, and each level is computed once (every level column is
    referenced twice, so the projections are not merged)."""
    entry = "struct<path:string,value:variant,m:map<string,variant>>"

    def node(path, value):
        return F.struct(path.alias("path"), value.alias("value"), value.try_cast(MAP_VARIANT).alias("m"))

    def is_plain_object(e):
        keys = F.map_keys(e["m"])
        return e["m"].isNotNull() & ~((F.size(keys) == 1) & keys[0].startswith("$"))

    top = F.filter(F.map_entries(F.col("doc").try_cast(MAP_VARIANT)), lambda c: c["key"] != "_id")
    d = docs.select(*ns_cols, id_col, F.transform(top, lambda c: node(c["key"], c["value"])).cast(f"array<{entry}>")
                    .alias("l0"))
    names = ["l0"]
    for k in range(1, max_depth + 1):
        prev = F.col(names[-1])
        nxt = F.flatten(F.transform(F.filter(prev, is_plain_object),
                                    lambda e: F.transform(F.map_entries(e["m"]),
                                                          lambda c: node(F.concat_ws(".", e["path"], c["key"]), c["value"]))))
        d = d.select("*", F.coalesce(nxt, F.array().cast(f"array<{entry}>")).alias(f"l{k}"))
        names.append(f"l{k}")
    return (d.select(*ns_cols, id_col, F.explode(F.concat(*[F.col(n) for n in names])).alias("e"))
            .select(*ns_cols, id_col, F.col("e.path").alias("path"), F.col("e.value").alias("value"))
            .withColumn("ptype", profile_type(F.col("value"))))


def profile_fields(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id", max_depth: int = 5,
                   distinct_cap: int = 1000, approximate: bool = False) -> DataFrame:
    """Per path types, isMixedType, presencePercent, nullRate,
    cardinality (distinct ``String(value)`` of scalars; the true count, and
    whether it is above ``distinct_cap``, where a display would cut it)."""
    p = walk_paths(docs, ns_cols, id_col, max_depth)
    scalar = F.col("ptype").isin("string", "int", "double", "boolean")
    sval = F.when(scalar, js_string(F.col("value")))
    distinct = F.approx_count_distinct(sval) if approximate else F.count_distinct(sval)
    per_path = p.groupBy(*ns_cols, "path").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if(F.col("ptype") == "null").alias("null_cnt"),
        F.array_sort(F.collect_set(F.when(F.col("ptype") != "null", F.col("ptype")))).alias("types"),
        distinct.alias("n_distinct"),
    )
    return per_path.join(_doc_counts(docs, ns_cols), list(ns_cols)).select(
        *ns_cols, "path", F.when(F.size("types") > 0, F.array_join("types", ",")).alias("types"),
        (F.size("types") > 1).alias("is_mixed_type"),
        F.round(F.col("cnt") / F.col("n_docs") * 100, 4).alias("presence_percent"),
        F.round(F.col("null_cnt") / F.col("n_docs") * 100, 4).alias("null_rate"),
        F.col("n_distinct").cast("long").alias("cardinality"), (F.col("n_distinct") > distinct_cap).alias("cardinality_capped"),
    )


def profile_numeric(docs: DataFrame, ns_cols=NS, id_col: str = "doc_id", max_depth: int = 5) -> DataFrame:
    """min/max/avg over the numeric values of every path whose types
    include int or double; one conditional aggregate pass over all data."""
    p = walk_paths(docs, ns_cols, id_col, max_depth)
    num = F.when(F.col("ptype").isin("int", "double"), F.try_variant_get("value", "$", "double"))
    return (p.groupBy(*ns_cols, "path")
            .agg(F.count_if(F.col("ptype").isin("int", "double")).alias("n_numeric"),
                 F.min(num).alias("min"), F.max(num).alias("max"), F.avg(num).alias("avg"))
            .filter(F.col("n_numeric") > 0)
            .select(*ns_cols, "path", F.col("n_numeric").cast("long").alias("n_numeric"),
                    F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
                    F.round("avg", 4).alias("avg")))
