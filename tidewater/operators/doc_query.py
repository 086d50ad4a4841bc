"""Document query surface (Q1-Q17): ``find`` and ``pipeline`` take the
document-database dict syntax and compose DataFrame calls, so Catalyst plans
the result (filters reach the scan, $group is a partial aggregate, $sort +
$limit is a bounded top-k).

Collections are DataFrames with one column per top-level field. A column
``_keys`` (array of present top-level keys) keeps the document distinction
between a missing field and a present null; without it, missing = null.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.tables import computed_once

KEYS = "_keys"


# -- filters ---------------------------------------------------------------------------------
class Scope:
    """What paths of a filter start from: the columns of a collection, or an element of an array of documents."""

    def __init__(self, fields: T.StructType, column, keys: Column | None = None):
        self.fields, self.column, self.keys = fields, column, keys

    @classmethod
    def of(cls, df: DataFrame) -> Scope:
        return cls(df.schema, F.col, F.col(KEYS) if KEYS in df.columns else None)

    def plain(self, path: str) -> Column | None:
        """The column of a path without arrays on its way (the last field may be one), so that filters reach the scan."""
        kind: T.DataType = self.fields
        for name in path.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            kind = kind[name].dataType
        if self.column is F.col:
            return F.col(path)
        out = self.column(path.split(".")[0])
        for name in path.split(".")[1:]:
            out = out[name]
        return out

    def any(self, path: str, pred, missing: bool = False, whole: bool = False) -> Column:
        """Whether a value that the path reaches holds ``pred(column, type)``. A step on an array of documents goes to
        each of them (a number: to that element only); a last field that is an array is tried as a whole and by its
        elements (``whole``: as a whole only). ``missing``: what a path without such a field gives."""
        first, *rest = path.split(".")
        if first not in self.fields.fieldNames():
            return F.lit(missing)
        return _reach(self.column(first), self.fields[first].dataType, rest, pred, missing, whole)


def _reach(c: Column, kind: T.DataType, rest: list[str], pred, missing: bool, whole: bool) -> Column:
    if not rest:
        if isinstance(kind, T.ArrayType) and not whole:
            each = F.coalesce(F.exists(c, lambda x: F.coalesce(pred(x, kind.elementType), F.lit(False))), F.lit(False))
            return F.coalesce(pred(c, kind), F.lit(False)) | each
        return pred(c, kind)
    name, *more = rest
    if isinstance(kind, T.StructType):
        if name not in kind.fieldNames():
            return F.lit(missing)
        return _reach(c[name], kind[name].dataType, more, pred, missing, whole)
    if isinstance(kind, T.ArrayType):
        if name.isdigit():
            inside = _reach(F.get(c, F.lit(int(name))), kind.elementType, more, pred, missing, whole)
            return (c.isNotNull() & (F.size(c) > int(name)) & inside) if not missing else (c.isNull() | (F.size(c) <= int(name)) | inside)
        if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.lit(missing)
        found = F.exists(c, lambda x: F.coalesce(_reach(x, kind.elementType, [name, *more], pred, missing, whole), F.lit(False)))
        return F.coalesce(found, F.lit(missing))
    return F.lit(missing)


_TYPE_NAMES = {"string": T.StringType, "bool": T.BooleanType, "int": T.IntegerType, "long": T.LongType,
               "double": T.DoubleType, "array": T.ArrayType, "object": T.StructType, "date": T.TimestampType}


def _known(c: Column, pred: Column) -> Column:
    """Two-valued predicate (false on null) that still pushes down to the
    scan: ``c IS NOT NULL AND pred`` instead of ``coalesce(pred, false)``."""
    return c.isNotNull() & pred


def _comparable(kind: T.DataType, v: Any) -> bool:
    """Values of unlike types never match (a number and an array, a text and a document)."""
    if isinstance(v, list):
        return isinstance(kind, T.ArrayType)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return False
    if isinstance(v, str):
        return not isinstance(kind, (T.NumericType, T.BooleanType))
    if isinstance(v, bool):
        return isinstance(kind, T.BooleanType)
    return not (isinstance(v, (int, float)) and isinstance(kind, (T.StringType, T.BooleanType)))


def _literal(v: Any) -> Column:
    return F.array(*[_literal(x) for x in v]) if isinstance(v, list) else F.lit(v)


def _compare(v: Any, test) -> Any:
    return lambda c, kind: _known(c, test(c, _literal(v))) if _comparable(kind, v) else F.lit(False)


_COMPARE = {"$eq": lambda c, v: c == v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def _present(scope: Scope, path: str) -> Column:
    if scope.keys is not None and "." not in path:
        return F.array_contains(scope.keys, path)
    return scope.any(path, lambda c, _: c.isNotNull(), whole=True)


def _eq(scope: Scope, path: str, v: Any) -> Column:
    if v is None:
        return scope.any(path, lambda c, _: c.isNull(), missing=True)
    return scope.any(path, _compare(v, _COMPARE["$eq"]))


def _elem_match(spec: dict) -> Any:
    """A test of one array: whether one of its elements holds all of ``spec``, a filter of documents or operators."""
    def test(c: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        inner = kind.elementType
        if all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
            one = lambda x: _cond(Scope(T.StructType([T.StructField("x", inner)]), lambda _: x), "x", spec)
        elif isinstance(inner, T.StructType):
            one = lambda x: filter_on(Scope(inner, lambda name: x[name]), spec)
        else:
            return F.lit(False)
        return F.coalesce(F.exists(c, lambda x: F.coalesce(one(x), F.lit(False))), F.lit(False))
    return test


def _op(scope: Scope, path: str, op: str, v: Any) -> Column:
    if op == "$eq":
        return _eq(scope, path, v)
    if op == "$ne":
        return ~_eq(scope, path, v)
    if op in _COMPARE:
        return scope.any(path, _compare(v, _COMPARE[op]))
    if op == "$in":
        c = scope.plain(path)
        vals = [x for x in v if x is not None]
        kind = _dtype_of(scope, path)
        if c is not None and not isinstance(kind, T.ArrayType):
            vals = [x for x in vals if _comparable(kind, x)]
            m = _known(c, c.isin(vals)) if vals else F.lit(False)
            return m | c.isNull() if None in v else m
        out = F.lit(False)
        for x in v:
            out = out | _eq(scope, path, x)
        return out
    if op == "$nin":
        return ~_op(scope, path, "$in", v)
    if op == "$exists":
        return _present(scope, path) if v else ~_present(scope, path)
    if op == "$regex":
        return scope.any(path, lambda c, kind: _known(c, c.rlike(v)) if isinstance(kind, T.StringType) else F.lit(False))
    if op == "$size":
        return scope.any(path, lambda c, kind: _known(c, F.size(c) == F.lit(v)) if isinstance(kind, T.ArrayType) else F.lit(False), whole=True)
    if op == "$all":
        out = F.lit(bool(v))
        for x in v:
            out = out & (_op(scope, path, "$elemMatch", x["$elemMatch"]) if isinstance(x, dict) and "$elemMatch" in x else _eq(scope, path, x))
        return out
    if op == "$elemMatch":
        return scope.any(path, _elem_match(v), whole=True)
    if op == "$type":
        if v == "null":
            return scope.any(path, lambda c, _: c.isNull()) & _present(scope, path)
        return scope.any(path, lambda c, kind: c.isNotNull() & F.lit(isinstance(kind, _TYPE_NAMES[v])))
    if op == "$not":
        return ~_cond(scope, path, v)
    raise ValueError(f"unsupported query operator {op}")


def _dtype_of(scope: Scope, path: str):
    kind: T.DataType = scope.fields
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def _dtype(df: DataFrame, path: str):
    return _dtype_of(Scope.of(df), path)


def _cond(scope: Scope, path: str, spec: Any) -> Column:
    if isinstance(spec, dict) and spec and all(k.startswith("$") for k in spec):
        opts = spec.get("$options", "")
        out = F.lit(True)
        for op, v in spec.items():
            if op == "$options":
                continue
            if op == "$regex" and "i" in opts:
                v = "(?i)" + v
            out = out & _op(scope, path, op, v)
        return out
    return _eq(scope, path, spec)


def filter_on(scope: Scope, q: dict | None) -> Column:
    out = F.lit(True)
    for k, v in (q or {}).items():
        if k == "$and":
            part = F.lit(True)
            for sub in v:
                part = part & filter_on(scope, sub)
        elif k == "$or":
            part = F.lit(False)
            for sub in v:
                part = part | filter_on(scope, sub)
        elif k == "$nor":
            part = F.lit(True)
            for sub in v:
                part = part & ~filter_on(scope, sub)
        else:
            part = _cond(scope, k, v)
        out = out & part
    return out


def filter_expr(df: DataFrame, q: dict | None) -> Column:
    """Q1: a filter document -> one boolean Column (missing fields never raise). A path goes through arrays: it holds if
    any value it reaches does, and a negated operator holds if none does. Of an empty array nothing is reached."""
    return filter_on(Scope.of(df), q)


# -- find --------------------------------------------------------------------------------------
def project(df: DataFrame, projection: dict | None) -> DataFrame:
    """Q2: inclusion (``_id`` kept unless excluded) or exclusion projection."""
    if not projection:
        return df.drop(KEYS) if KEYS in df.columns else df
    inc = [k for k, v in projection.items() if v and k != "_id"]
    if inc or projection.get("_id"):
        cols = (["_id"] if projection.get("_id", 1) and "_id" in df.columns else []) + inc
        return df.select(*[F.col(c).alias(c) for c in cols])
    drop = [k for k, v in projection.items() if not v] + ([KEYS] if KEYS in df.columns else [])
    return df.drop(*drop)


def sort_cols(sort: dict | None) -> list[Column]:
    """Q3: +1 ascending (nulls first), -1 descending (nulls last)."""
    return [F.col(k).asc_nulls_first() if v == 1 else F.col(k).desc_nulls_last() for k, v in (sort or {}).items()]


def find(df: DataFrame, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None,
         skip: int = 0, limit: int | None = None) -> DataFrame:
    """Q1-Q4: filter, sort, skip, limit (if given), then project."""
    out = df.filter(filter_expr(df, filter))
    if sort:
        out = out.orderBy(*sort_cols(sort))
    if skip:
        out = out.offset(max(0, int(skip)))
    if limit is not None:
        out = out.limit(max(int(limit), 1))
    return project(out, projection)


def find_total(df: DataFrame, filter: dict | None = None) -> int:
    """Q5: filtered total (one number back to the driver)."""
    return df.filter(filter_expr(df, filter)).count()


# -- aggregation pipeline ------------------------------------------------------------------------
def expr(df: DataFrame, e: Any) -> Column:
    """Aggregation expressions: "$field" refs, literals and a few operators."""
    if isinstance(e, str) and e.startswith("$"):
        return F.col(e[1:])
    if isinstance(e, dict) and len(e) == 1:
        (op, args), = e.items()
        if op == "$literal":
            return F.lit(args)
        a = [expr(df, x) for x in (args if isinstance(args, list) else [args])]
        if op == "$add":
            out = a[0]
            for x in a[1:]:
                out = out + x
            return out
        if op == "$subtract":
            return a[0] - a[1]
        if op == "$multiply":
            out = a[0]
            for x in a[1:]:
                out = out * x
            return out
        if op == "$divide":
            return a[0] / a[1]
        if op == "$concat":
            return F.concat(*a)
        if op == "$toLower":
            return F.lower(a[0])
        if op == "$toUpper":
            return F.upper(a[0])
        if op == "$size":
            return F.size(a[0])
        if op == "$round":
            return F.round(a[0], int(args[1]) if isinstance(args, list) and len(args) > 1 else 0)
        raise ValueError(f"unsupported expression operator {op}")
    return F.lit(e)


def _order_struct(df: DataFrame, sort: dict) -> Column:
    """A struct whose natural ordering follows a $sort spec (descending
    numeric keys are negated), used by min_by/max_by and ordered arrays."""
    parts = []
    for k, v in sort.items():
        c = F.col(k)
        if v != 1:
            if not isinstance(_dtype(df, k), T.NumericType):
                raise ValueError(f"descending $sort on non-numeric {k} before $group is not supported")
            c = -c
        parts.append(c.alias(k.replace(".", "_")))
    return F.struct(*parts)


def _group(df: DataFrame, spec: dict, order: dict) -> DataFrame:
    """Q7 $group. $first/$last/$push follow the order of the preceding $sort
    (carried as ``_ord``); $addToSet is returned sorted."""
    key = spec["_id"]
    if isinstance(key, dict):
        keys = [expr(df, v).alias(k) for k, v in key.items()]
        out_key = F.struct(*[F.col(k) for k in key])
    elif key is None:
        keys, out_key = [], F.lit(None)
    else:
        keys, out_key = [expr(df, key).alias("_id")], None
    d = df.withColumn("_ord", _order_struct(df, order)) if order else df.withColumn("_ord", F.monotonically_increasing_id())
    aggs = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        (op, arg), = acc.items()
        x = expr(d, arg)
        if op == "$sum":
            aggs.append((F.count(F.lit(1)) if arg == 1 else F.sum(x)).alias(name))
        elif op == "$avg":
            aggs.append(F.avg(x).alias(name))
        elif op == "$min":
            aggs.append(F.min(x).alias(name))
        elif op == "$max":
            aggs.append(F.max(x).alias(name))
        elif op == "$first":
            aggs.append(F.min_by(x, F.col("_ord")).alias(name))
        elif op == "$last":
            aggs.append(F.max_by(x, F.col("_ord")).alias(name))
        elif op == "$push":
            aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_ord").alias("o"), x.alias("v")))),
                                    lambda s: s["v"]).alias(name))
        elif op == "$addToSet":
            aggs.append(F.array_sort(F.collect_set(x)).alias(name))
        elif op == "$count":
            aggs.append(F.count(F.lit(1)).alias(name))
        else:
            raise ValueError(f"unsupported accumulator {op}")
    g = d.groupBy(*keys).agg(*aggs)
    if out_key is not None:
        g = g.select(out_key.alias("_id"), *[c for c in g.columns if c not in [k for k in (key or {})]])
    return g


def _lookup(df: DataFrame, spec: dict, collections: dict[str, DataFrame]) -> DataFrame:
    """Q12 $lookup: a left equi-join into an array (empty when no match), in the order of the foreign collection. A null
    or missing field matches null or missing ones; an array, on either side, matches by each of its elements, and a
    foreign document that several elements match is there once. The foreign side is grouped by key first, so a frequent
    key (null too) is joined as one row and no pairs of documents are shuffled."""
    right = collections[spec["from"]]
    lf, ff, name = spec["localField"], spec["foreignField"], spec["as"]
    lists = [isinstance(_dtype(x, f), T.ArrayType) for x, f in ((df, lf), (right, ff))]
    docs = F.struct(*[F.col(c) for c in right.columns])
    keyed = right.select(F.monotonically_increasing_id().alias("_fid"), F.col(ff).alias("_fk"), docs.alias("_doc"))  # ids before elements
    keyed = keyed.select("_fid", _elements(F.col("_fk"), lists[1]).alias("_fk"), "_doc")
    grouped = keyed.groupBy("_fk").agg(F.array_sort(F.collect_list(F.struct("_fid", "_doc")), _by_id).alias(name))
    found = lambda c: F.coalesce(F.transform(c, lambda m: m["_doc"]), F.array().cast(T.ArrayType(grouped.schema[name].dataType.elementType["_doc"].dataType)))
    if not any(lists):
        j = df.join(grouped.withColumnRenamed(name, "_found"), df[lf].eqNullSafe(grouped["_fk"]), "left")
        return j.withColumn(name, found(F.col("_found"))).drop("_fk", "_found")
    whole = F.struct(*[F.col(c) for c in df.columns])
    lk = F.col("_lk")
    items = F.when(lk.isNull(), F.array(F.get(lk, F.lit(0)))).otherwise(F.array_distinct(lk)) if lists[0] else F.array(lk)
    rows = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(lf).alias("_lk"), whole.alias("_row"))
    rows = computed_once(rows, items.alias("_items")).drop("_lk")
    # a document of one element has its matches from the join; only those of several are regrouped
    one = rows.filter(F.size("_items") <= 1).select("_rid", "_row", F.get("_items", F.lit(0)).alias("_lk"), (F.size("_items") == 1).alias("_any"))
    out = _matched(one, grouped.withColumnRenamed(name, "_found")).select("_row", "_found")
    if lists[0]:
        several = rows.filter(F.size("_items") > 1).select("_rid", "_row", F.explode("_items").alias("_lk"), F.lit(True).alias("_any"))
        j = _matched(several, grouped.withColumnRenamed(name, "_found"))
        j = j.groupBy("_rid").agg(F.first("_row").alias("_row"), F.flatten(F.collect_list("_found")).alias("_found"))
        j = computed_once(j.withColumnRenamed("_found", "_each"), F.array_sort("_each", _by_id).alias("_found"))
        again = lambda m, i: (i > 0) & (F.get("_found", i - 1)["_fid"] == m["_fid"])
        out = out.unionByName(j.select("_row", (F.filter("_found", lambda m, i: ~again(m, i)) if lists[1] else F.col("_found")).alias("_found")))
    return out.select("_row.*", found(F.col("_found")).alias(name))


#: Documents of a key beyond which its group is copied, once for each so many, and the most copies.
HOT_DOCS, MOST_COPIES = 256, 64


def _matched(each: DataFrame, grouped: DataFrame) -> DataFrame:
    """``each`` (_rid, _row, _lk, _any) left joined with its key's ``_found``. The rows of a key with many documents are
    dealt over copies of its group, so that its arrays, as many as such rows, are not all made in one task."""
    copies = F.least(F.lit(MOST_COPIES), F.ceil(F.size("_found") / HOT_DOCS)).cast("int")
    hot = grouped.filter(F.size("_found") > HOT_DOCS).select(F.col("_fk").alias("_hk"), copies.alias("_copies"))
    dealt = each.join(hot, each["_any"] & each["_lk"].eqNullSafe(hot["_hk"]), "left")
    dealt = dealt.withColumn("_at", F.pmod(F.xxhash64("_rid"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_hk", "_copies")
    spread = grouped.select("_fk", "_found", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"))
    return dealt.join(spread, dealt["_any"] & dealt["_lk"].eqNullSafe(spread["_fk"]) & (dealt["_at"] == spread["_copy"]), "left")


def _by_id(x: Column, y: Column) -> Column:
    return F.when(x["_fid"] < y["_fid"], -1).when(x["_fid"] > y["_fid"], 1).otherwise(0)


def _elements(c: Column, is_list: bool) -> Column:
    """A row for each different element of an array (null: one row of null), or the value itself."""
    return F.explode(F.when(c.isNull(), F.array(F.get(c, F.lit(0)))).otherwise(F.array_distinct(c))) if is_list else c


def _unwind(df: DataFrame, spec: Any) -> DataFrame:
    """Q11 $unwind: one row per element; null/empty arrays drop unless preserved."""
    if isinstance(spec, str):
        spec = {"path": spec}
    path = spec["path"].lstrip("$")
    keep = spec.get("preserveNullAndEmptyArrays", False)
    idx = spec.get("includeArrayIndex")
    others = [c for c in df.columns if c != path]
    if not isinstance(df.schema[path].dataType, T.ArrayType):
        return df.filter(F.col(path).isNotNull()) if not keep else df
    if idx:
        gen = F.posexplode_outer(path) if keep else F.posexplode(path)
        return df.select(*others, gen.alias(idx, path))
    gen = F.explode_outer(path) if keep else F.explode(path)
    return df.select(*others, gen.alias(path))


def pipeline(df: DataFrame, stages: list[dict], limit: int | None = None,
             collections: dict[str, DataFrame] | None = None) -> DataFrame:
    """Q6-Q15: run stages in order; the caller limit, if given, is
    appended as a final $limit."""
    order: dict = {}
    out = df
    for i, st in enumerate(stages):
        (op, spec), = st.items()
        if op == "$match":
            out = out.filter(filter_expr(out, spec))
        elif op == "$sort":
            order = dict(spec)
            if not (i + 1 < len(stages) and "$group" in stages[i + 1]):
                out = out.orderBy(*sort_cols(spec))      # $group takes the order from the sort keys
        elif op == "$limit":
            out = out.limit(int(spec))
        elif op == "$skip":
            out = out.offset(int(spec))
        elif op == "$project":
            inc = {k: v for k, v in spec.items() if not (isinstance(v, (int, bool)) and not v)}
            if all(isinstance(v, (int, bool)) for v in spec.values()):
                out = project(out, spec)
            else:
                cols = (["_id"] if spec.get("_id", 1) and "_id" in out.columns and "_id" not in inc else [])
                out = out.select(*[F.col(c) for c in cols],
                                 *[(F.col(k) if isinstance(v, (int, bool)) else expr(out, v)).alias(k)
                                   for k, v in inc.items() if k != "_id" or not isinstance(v, (int, bool))])
        elif op == "$addFields":
            out = out.withColumns({k: expr(out, v) for k, v in spec.items()})
        elif op == "$group":
            out = _group(out, spec, order)
            order = {}
        elif op == "$unwind":
            out = _unwind(out, spec)
        elif op == "$lookup":
            out = _lookup(out, spec, collections or {})
        elif op == "$count":
            out = out.agg(F.count(F.lit(1)).cast("long").alias(spec))
        elif op == "$facet":
            out = facet(out, spec, collections)
        else:
            raise ValueError(f"unsupported stage {op}")
    if limit is not None:
        out = out.limit(max(int(limit), 1))
    return out


def _keeps_order(stages: list[dict]) -> bool:
    """Whether the output of the stages is in the order of a $sort."""
    ops = [next(iter(st)) for st in stages]
    return "$sort" in ops and not {"$group", "$count", "$facet"} & set(ops[ops.index("$sort"):])


def facet(df: DataFrame, branches: dict[str, list[dict]], collections=None) -> DataFrame:
    """Q15 $facet: each branch runs over the same input; one row per branch
    with its number of documents and the documents as a JSON array, in the
    branch's order (without a $sort: by their text). A branch is one array
    by definition, bounded in the source system by the size of a document.
    Branch outputs are unioned and grouped by branch name, never crossed."""
    parts = [df.sparkSession.createDataFrame([(name, None, None) for name in branches], "facet string, _o long, doc string")]
    for name, stages in branches.items():
        b = pipeline(df, stages, collections=collections)
        order = F.monotonically_increasing_id() if _keeps_order(stages) else F.lit(0).cast("long")
        parts.append(b.select(F.lit(name).alias("facet"), order.alias("_o"), F.to_json(F.struct(*[F.col(c) for c in b.columns])).alias("doc")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    each = F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("_o", "doc")))
    return u.groupBy("facet").agg(
        F.count("doc").cast("long").alias("n_docs"),
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(each), lambda s: s["doc"]), ","), F.lit("]")).alias("docs"))


def coll_stats(docs: DataFrame, ns_cols: list[str], text_col: str = "doc_text") -> DataFrame:
    """Q16: count, size (bytes of the JSON text) and average object size."""
    return docs.groupBy(*ns_cols).agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.sum(F.octet_length(text_col)).cast("long").alias("size"),
        F.round(F.avg(F.octet_length(text_col)), 4).alias("avg_obj_size"))
