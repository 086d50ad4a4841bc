"""Run queries() against oracle_sql() on DuckDB, the way the correctness gate
does: same row count, same column names, same order-insensitive values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidewater.sources.tables import TESTDATA_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TESTDATA_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, _dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, out


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def _family_spark(t) -> str:
    from pyspark.sql import types as T
    for k, v in ((T.IntegerType, "int32"), (T.LongType, "int64"), (T.ShortType, "int16"), (T.ByteType, "int8"),
                 (T.DoubleType, "float64"), (T.FloatType, "float32"), (T.StringType, "string"), (T.BooleanType, "bool"),
                 (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.DateType, "date"),
                 (T.DecimalType, "decimal"), (T.BinaryType, "binary")):
        if isinstance(t, k):
            return v
    if isinstance(t, T.ArrayType):
        return "list<" + _family_spark(t.elementType) + ">"
    return type(t).__name__


def _family_duck(s: str) -> str:
    s = str(s).upper()
    if s.endswith("[]"):
        return "list<" + _family_duck(s[:-2]) + ">"
    if s.startswith("DECIMAL"):
        return "decimal"
    return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
            "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "DATE": "date",
            "BLOB": "binary", "JSON": "string", "TIMESTAMP WITH TIME ZONE": "timestamp"}.get(s, s)


def type_diffs(spark_df, con, sql) -> list:
    """Column type families that differ between the Spark result and the oracle."""
    st = {f.name: _family_spark(f.dataType) for f in spark_df.schema.fields}
    dt = {d[0]: _family_duck(d[1]) for d in con.execute("SELECT * FROM (" + sql + ") LIMIT 0").description}
    return [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)]


def compare(spark_df, con, sql):
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    a, b = sorted(sr, key=_key), sorted(dr, key=_key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff:\n spark={x}\n duck ={y}"
    return True, f"{len(sr)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from tidewater.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    ok_all = True
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
                td = type_diffs(df, con, sqls[name])
                if ok and td:
                    msg += f"  (type families differ: {td})"
            else:
                n = df.count()
                ok, msg = True, f"{n} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        ok_all &= ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t0:6.2f}s  {msg}", flush=True)
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
