"""Documents of unlike collections mapped through a schema table."""

from pyspark.sql import functions as F

from tidewater.operators import infer, mapping


def _docs(spark, rows):
    return spark.createDataFrame(rows, "coll string, doc_id long, doc_text string").withColumn("doc", F.parse_json("doc_text"))


def test_each_collection_has_its_own_columns(spark):
    docs = _docs(spark, [("a", 1, '{"_id":1,"x":5,"p.q":1,"p_q":2}'), ("a", 2, '{"_id":2,"x":7.0}'), ("a", 3, "{}"),
                         ("b", 1, '{"_id":1,"x":"five","t":{"z":1,"a":[2]}}'), ("b", 2, '{"_id":2,"x":null,"n":"3000000000"}')])
    schema = infer.infer_schema(docs, ns_cols=["coll"])
    schema = schema.withColumn("type", F.when(F.col("column_name") == "n", F.lit("int")).otherwise(F.col("type")))
    named = mapping.destination_schema(schema, "pg", ["coll"])
    fields = mapping.map_doc_fields(docs, named, "pg", ["coll"])
    got = {(r.coll, r.doc_id): (r.row, r.failed_columns) for r in mapping.field_rows(fields, docs, ["coll"]).collect()}
    assert got == {("a", 1): ({"_id": "1", "x": "5", "p_q": "1", "p_q_": "2"}, []), ("a", 2): ({"_id": "2", "x": "7"}, []), ("a", 3): ({}, []),
                   ("b", 1): ({"_id": "1", "x": "five", "t": '{"z":1,"a":[2]}'}, []), ("b", 2): ({"_id": "2", "x": None, "n": None}, ["n"])}
    rows = mapping.field_rows(fields, docs, ["coll"]).filter(F.col("coll") == "a")
    table = mapping.namespace_table(rows, named.filter(F.col("coll") == "a")).orderBy(F.col("_id").asc_nulls_last())
    assert table.dtypes == [("_id", "int"), ("x", "int"), ("p_q", "int"), ("p_q_", "int")]
    assert [tuple(r) for r in table.collect()] == [(1, 5, 1, 2), (2, 7, None, None), (None, None, None, None)]


def test_many_dynamic_keys(spark):
    docs = spark.range(20_000).select(F.lit("a").alias("coll"), F.col("id").alias("doc_id"),
                                      F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('":1}')).alias("doc_text")).withColumn("doc", F.parse_json("doc_text"))
    named = mapping.destination_schema(infer.infer_schema(docs, ns_cols=["coll"]), "pg", ["coll"])
    fields = mapping.map_doc_fields(docs, named, "pg", ["coll"])
    assert fields.agg(F.count_distinct("column_name"), F.sum(F.col("value").cast("long"))).first()[:] == (20_000, 20_000)


def test_no_documents(spark):
    docs = _docs(spark, [])
    named = mapping.destination_schema(infer.infer_schema(docs, ns_cols=["coll"]), "mysql", ["coll"])
    assert mapping.field_rows(mapping.map_doc_fields(docs, named, "mysql", ["coll"]), docs, ["coll"]).collect() == []
