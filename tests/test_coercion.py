"""Values that do not convert on their way between document and SQL stores."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import mapping as mp
from tidewater.operators.mapping import Col


def _warnings(df):
    return {(r["code"], r["column"]): r.n_rows for r in df.collect()}


@pytest.mark.parametrize(("text", "holds"), [
    ("1", True), ("-1.50", True), ("+.5", True), ("5.", True), ("1e10", True), ("1.5E-7", True), ("NaN", True), ("-Infinity", True),
    ("inf", True), ("1" * 34, True), ("1" * 35, False), ("1" + "0" * 40, True), ("0" * 40 + "1", True), ("0." + "0" * 40 + "12", True),
    ("", False), (".", False), ("e5", False), ("1e", False), ("1,5", False), ("0x10", False), (" 1", False), ("--1", False)])
def test_what_a_decimal128_holds(spark, text, holds):
    assert spark.createDataFrame([(text,)], "t string").select(mp.is_decimal128(F.col("t"))).first()[0] is holds


def test_sql_rows_to_documents_keep_what_does_not_parse(spark):
    rows = spark.createDataFrame([(1, "12", "1.5", (1,)), (2, "2147483648", "x", None), (3, "a\"b", None, (3,)), (4, None, "", (4,))],
                                 "id long, n string, d string, m struct<c:int>")
    cols = [Col("id", "long", True), Col("n", "long"), Col("d", "decimal"), Col("m", "mixed")]
    docs = {r._id: r.doc for r in mp.map_sql_to_doc(rows, cols, "pg")[0].collect()}
    assert docs == {"1": '{"_id":1,"n":12,"d":{"$numberDecimal":"1.5"},"m":{"c":1}}',
                    "2": '{"_id":2,"n":{"$numberLong":"2147483648"},"d":"x","m":null}',
                    "3": '{"_id":3,"n":"a\\"b","d":null,"m":{"c":3}}', "4": '{"_id":4,"n":null,"d":"","m":{"c":4}}'}
    lost = {("long_coerce_failed", "n"): 1, ("decimal_coerce_failed", "d"): 2}
    assert _warnings(mp.row_warnings(rows, cols, "pg", "doc")) == lost
    assert _warnings(mp.row_warnings(rows, cols, "mysql", "doc")) == lost | {("mixed_to_subdoc", "m"): 3}
    assert _warnings(mp.row_warnings(rows.limit(0), cols, "mysql", "doc")) == {}


def test_objects_and_scalars_of_a_variant_column(spark):
    rows = spark.createDataFrame([(1, '{"a":1}'), (2, "[1]"), (3, "7"), (4, "null"), (5, None)], "id long, t string")
    rows = rows.select("id", F.parse_json("t").alias("m"))
    assert _warnings(mp.row_warnings(rows, [Col("id", "long", True), Col("m", "mixed")], "mysql", "doc")) == {("mixed_to_subdoc", "m"): 2}


def test_broken_json_between_sql_engines_is_null_and_told(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{a"), (3, None), (4, "")], "id long, j string")
    cols = [Col("id", "long", True), Col("j", "json")]
    for source, dest in (("pg", "mysql"), ("mysql", "pg")):
        got = {r.id: r.j for r in mp.map_sql_to_sql(rows, cols, source, dest).collect()}
        assert got == {1: '{"a": 1}', 2: None, 3: None, 4: None}
        assert _warnings(mp.row_warnings(rows, cols, source, dest)) == {("json_stringify_failed", "j"): 2}


def test_what_holds_no_bytes_is_stored_as_json(spark):
    texts = ['{"b":{"$binary":"aGk="}}', '{"b":{"$binary":{"base64":"aGk=","subType":"00"}}}', '{"b":"aGk="}', '{"b":5}', '{"b":null}', "{}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, doc_text string").withColumn("doc", F.parse_json("doc_text"))
    mapped, rejects, warnings = mp.map_doc_to_sql(docs, [Col("b", "binary")], "pg", keep=["id"])
    got = {r.id: bytes(r.b) if r.b is not None else None for r in mapped.collect()}
    assert (got[0], got[1], got[3], got[4], got[5]) == (b"hi", b"hi", b"5", None, None) and got[2] in (b'"aGk="', b"aGk=")
    assert rejects.count() == 0 and _warnings(warnings) == {("binary_coerce_failed", "b"): 2}
