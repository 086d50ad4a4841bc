"""Whole documents, pages, snapshots, feeds and mapped changes on small tables of awkward rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tidewater.operators import alerts, infer, load, mapping, monitor
from tidewater.operators.mapping import Col
from tidewater.sources import sinks, tables


def test_rendered_at_any_depth(spark):
    cases = {
        '{"a":{"$oid":"ab"},"b":[{"$numberLong":"9007199254740993"},{"c":{"$date":"2024-01-01T00:00:00Z"}}]}':
            '{"a":"ab","b":["9007199254740993",{"c":"2024-01-01T00:00:00Z"}]}',
        '{"b":{"$binary":{"base64":"AQI=","subType":"00"}}}': '{"b":"AQI="}',
        '{"d":{"$date":{"$numberLong":"-5"}}}': '{"d":"-5"}',
        '{"t":"{\\"$oid\\":\\"ab\\"}","u":"x\\\\"}': '{"t":"{\\"$oid\\":\\"ab\\"}","u":"x\\\\"}',
        '{"o":{"$oid":"a\\"b"},"p":{"$oid":"a\\"}"}}': '{"o":{"$oid":"a\\"b"},"p":{"$oid":"a\\"}"}}',
        '{"more":{"$oid":"ab","x":1}}': '{"more":{"$oid":"ab","x":1}}',
        '{ "a" : { "$oid" : "ab" } }': '{ "a" : "ab" }',
        "{}": "{}",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    out = [r[0] for r in df.select(sinks.render_document_text(F.col("t"))).collect()]
    assert out[:-1] == list(cases.values()) and out[-1] is None
    for text in out[:-1]:
        json.loads(text)
    long = '{"a":[' + ",".join(['{"$numberLong":"7"}'] * 20000) + '],"s":"' + 'x"'.replace('"', '\\"') * 20000 + '","b":{"$binary":{"base64":"' + "A\\/" * 300000 + '","subType":"00"}}}'
    got = spark.createDataFrame([(long,)], "t string").select(sinks.render_document_text(F.col("t"))).first()[0]
    assert json.loads(got)["a"] == ["7"] * 20000 and json.loads(got)["b"] == "A/" * 300000


def test_collections_under_their_own_headers(spark, tmp_path):
    rows = [("a", 1, '{"x":1,"k,1":"say \\"hi\\", you","n":null}'), ("a", 2, '{"y":{"b":1,"a":2.50}}'), ("b", 3, '{"x":2.0}')]
    docs = spark.createDataFrame(rows, "coll string, doc_id long, doc_text string").withColumn("doc", F.parse_json("doc_text"))
    headers = sinks.union_columns(infer.explode_fields(docs, ("coll",)), ["coll"], ["doc_id", "pos"])
    base = sinks.export_collections(docs, headers, str(tmp_path / "out"))
    read = lambda part: sorted((r["coll"], r["value"]) for r in spark.read.text(f"{base}/{part}").collect())
    assert read("header") == [("a", 'x,"k,1",n,y'), ("b", "x")]
    assert read("rows") == [("a", ',,,"{""b"":1,""a"":2.5}"'), ("a", '1,"say ""hi"", you",,'), ("b", "2")]


def test_pages_cover_a_table_without_a_key(spark):
    rows = [(i % 3, None if i % 5 == 0 else f"v{i % 4}", i % 2 == 0) for i in range(47)]
    df = spark.createDataFrame(rows, "a long, b string, c boolean").repartition(5)
    seen = []
    for at in range(0, 60, 10):
        page = tables.fetch_rows(df, None, 10, at).collect()
        assert all(r["total"] == 47 and r["total_exact"] for r in page)
        seen += [(r["a"], r["b"], r["c"]) for r in page]
    assert sorted(seen, key=str) == sorted(rows, key=str)
    assert tables.fetch_rows(df.limit(0), None, 10).count() == 0
    assert not tables.fetch_rows(df, ["a"], 1, documents=True).first()["total_exact"]


def test_catalog_namespaces(spark):
    rows = [("shop", "b", "r"), ("shop", "a", "p"), ("shop", "v", "v"), ("pg_catalog", "x", "r"), ("hr", "a", "r"), (None, "z", "r")]
    c = spark.createDataFrame(rows, "database string, name string, kind string")
    got = [tuple(r) for r in tables.catalog_namespaces(c, "pg").collect()]
    assert got == [("hr", "a"), ("shop", "a"), ("shop", "b")]
    assert [r["name"] for r in tables.catalog_namespaces(c, "pg", "hr").collect()] == ["a"]
    assert tables.catalog_namespaces(c, "mysql").count() == 0


def test_snapshot_sizes_are_those_on_disk(spark, tmp_path):
    base = str(tmp_path / "snap")
    sinks.snapshot_write(spark.range(1000).repartition(3), base, "r1")
    sinks.snapshot_write(spark.range(10).repartition(1), base, "r2")
    for run, n in (("r1", 1000), ("r2", 10)):
        files = [f for f in os.listdir(f"{base}/run_id={run}") if f.endswith(".parquet")]
        size = sum(os.path.getsize(f"{base}/run_id={run}/{f}") for f in files)
        assert tuple(sinks.snapshot_files(spark, base, run).first()) == (run, n, len(files), size)
    assert tuple(sinks.snapshot_files(spark, base, "none").first()) == ("none", 0, 0, 0)


def test_feed_filters_and_limits(spark):
    ev = spark.createDataFrame([(r, i, "firing" if i % 2 else "resolved", 1000 - i // 3) for r in range(4) for i in range(150)],
                               "rule_id long, island long, status string, fired_ms long")
    rules = spark.createDataFrame([(r, f"n{r}", "m", r % 2) for r in range(4)], "rule_id long, name string, metric string, connection_id long")
    one = spark.createDataFrame([(1,), (1,)], "connection_id long")
    assert alerts.feed(ev, rules).count() == 50
    got = alerts.feed(ev, rules, one, "firing", 999).collect()
    want = sorted(((-(1000 - i // 3), r, i) for r in (1, 3) for i in range(150) if i % 2))[:200]
    assert [(-r["fired_ms"], r["rule_id"], r["island"]) for r in got] == want[:len(got)] and len(got) == len(want)
    assert alerts.feed(ev, rules, one.limit(0)).count() == 0


def test_reports_sorted_by_any_column(spark):
    df = spark.createDataFrame([("a", 3, None), ("b", 5, 1), ("c", 5, 2), ("d", None, 2)], "db string, size long, n long")
    order = lambda c, d=True: [r["db"] for r in monitor.sorted_report(df, c, d).collect()]
    assert order("size") == ["b", "c", "a", "d"] and order("size", False) == ["a", "b", "c", "d"]
    assert order("n") == ["c", "d", "b", "a"] and order("db") == ["d", "c", "b", "a"]


def test_changes_are_mapped_deleted_or_rejected(spark):
    rows = [(1, "insert", '{"p":1.5,"extra":{"x":1}}'), (2, "insert", '{"p":"dear"}'), (3, "delete", None), (4, "update", "{}"), (5, "update", '{"p":null}')]
    out = mapping.map_changes(spark.createDataFrame(rows, "key long, op string, doc string"), [Col("p", "double")], "pg", ["key"])
    assert sorted(map(tuple, out.collect())) == [(1, "apply", None, 1.5), (2, "reject", "p", None), (3, "delete", None, None), (4, "apply", None, None), (5, "apply", None, None)]


def test_preview_counts_namespaces_without_warnings(spark):
    w = spark.createDataFrame([("d", "a", "warn"), ("d", "a", "info"), ("d", "a", "info")], "database string, coll string, severity string")
    ns = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "b")], "database string, coll string")
    got = {tuple(r) for r in load.preview_warnings(w, ns, ["database", "coll"]).collect()}
    assert got == {("d", "a", 1, 2), ("d", "b", 0, 0), ("*", "*", 1, 2)}
    empty = load.preview_warnings(w.limit(0), ns.limit(0), ["database", "coll"])
    assert {tuple(r) for r in empty.collect()} == {("*", "*", 0, 0)}


def test_dry_run_names_and_types(spark):
    schema = spark.createDataFrame([("d", "a", 1, "_id", "objectid", True, True), ("d", "a", 2, "x.y", "long", True, False), ("d", "a", 3, "x_y", "mixed", False, False), ("d", "b", 1, "_id", "int", False, True)],
                                   "database string, coll string, ordinal int, column_name string, type string, nullable boolean, primary_key boolean")
    told = spark.createDataFrame([("d", "a", "x_y"), ("d", "a", "x_y"), ("d", "b", None)], "database string, coll string, column_name string")
    got = {(r.coll, r.ordinal): (r.dest_name, r.dest_type, r.nullable, r.n_warnings) for r in load.dry_run(schema, told, "pg", ["database", "coll"]).collect()}
    assert got[("a", 1)][2:] == (False, 0) and got[("a", 2)] == ("x_y", "BIGINT", True, 0) and got[("b", 1)][3] == 0
    assert got[("a", 3)][1:] == ("TEXT", False, 2) and got[("a", 3)][0] != "x_y" and len(got) == 4
    assert load.dry_run(schema.limit(0), told, "mysql", ["database", "coll"]).count() == 0
