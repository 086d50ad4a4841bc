"""The corpus pipeline, stage by stage, against brute-force versions of its stages."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SMALL, brute_components, brute_lines, brute_quality, text_of, tiles
from tidewater.llm import lines, quality
from tidewater.llm.common import saved


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def test_columns_and_lengths(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert df.where("n_chars != length(text)").count() == 0


def test_quality_stage(stages):
    before, after = text_of(stages[0]), text_of(stages[1])
    for d, t in before.items():
        kept = [x for x, rule in quality.judged(t.encode()) if rule is None]
        size = lambda x: len(b"".join(x.split()))
        stays = not brute_quality(t)[-1] and sum(map(size, kept)) >= quality.MIN_KEPT_SHARE * size(t.encode())
        assert (d in after) == stays and (not stays or after[d] == b"\n".join(kept).decode())


def test_line_stage(stages):
    before, after = text_of(stages[1]), text_of(stages[2])
    gone = brute_lines(before)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    assert after == {d: t for d, t in want.items() if t.split() or not gone[d]}
    assert len(after) < len(before)


def test_emptied_documents_go(spark):
    rows = [(1, "one two three four five\nsix"), (2, "six\n\none two three four five"), (3, "one two three four five\nnew words"), (4, ""), (5, None), (6, " \n"), (None, "six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_lines", F.lit(1)).withColumn("row", F.lit(2))
    got = {r.doc_id: r.text for r in lines.clean(docs, drop_emptied=True).collect()}
    assert got == {1: rows[0][1], 3: "new words", 4: "", 5: None, 6: " \n"}
    assert lines.clean(docs).count() == 7 and lines.clean(docs, drop_emptied=True).columns == docs.columns


def test_near_stage(stages):
    before, after = text_of(stages[2]), text_of(stages[3])
    assert after == {d: before[d] for d, x in brute_components(before, 5, 80).items() if x[2]}


def test_secret_stage(stages):
    before, after = text_of(stages[3]), text_of(stages[4])
    assert set(before) == set(after)
    assert all(after[d] == t or "[secret]" in after[d] for d, t in before.items())


def test_packing_stage(stages):
    got = stages[5].collect()
    tiles([(r.sequence_id, r.offset, r.length, r.sequence_length) for r in got])
    n = collections.Counter()
    for r in got:
        n[r.doc_id] += r.length
    assert {d: n[d] for d in n} == {r.doc_id: r.doc_tokens for r in got} and set(n) == set(text_of(stages[4]))


def test_run_is_the_stages(spark, stages):
    got, want = (sorted(map(tuple, df.drop("sequence_id").collect())) for df in (corpus_pipeline.run(spark, SMALL), stages[5]))
    assert np.array_equal([x[0] for x in got], [x[0] for x in want]) and sum(x[2] for x in got) == sum(x[2] for x in want)
