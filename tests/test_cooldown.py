"""The cooldown against a plain loop over the firings, on short gaps, ties, exact gaps and long chains."""

import collections
import random

import pytest

from tidewater.operators import alerts as al


def loop(rows, cooldown):
    out, last = {}, {}
    for rule, t, island in sorted(rows):
        ok = rule not in last or t - last[rule] > cooldown
        out[rule, island] = ok
        if ok:
            last[rule] = t
    return out


def check(spark, rows, cooldown):
    df = spark.createDataFrame([(r, i, t, 1.5) for r, t, i in rows], "rule_id long, island long, fired_ms long, value double")
    out = al.notify_flags(df, cooldown)
    assert set(out.columns) == {*df.columns, "notified"}
    assert {(r.rule_id, r.island): r.notified for r in out.collect()} == loop(rows, cooldown)


def test_a_month_of_short_gaps(spark):
    """Two rules firing every 7 and 11 minutes for a month: one chain of over 1,000 notified firings each."""
    check(spark, [(rule, i * gap * 60_000, i) for rule, gap in ((1, 7), (2, 11)) for i in range(31 * 24 * 60 // gap)], 30 * 60_000)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_gaps_and_ties(spark, seed):
    r = random.Random(seed)
    rows, n = [], collections.Counter()
    for _ in range(400):
        rule = r.choice([1, 1, 1, 2, 3])
        n[rule] += 1
        rows.append((rule, r.choice([0, 10, 20, 30]) * 86_400 * 100 + r.randrange(60) * 500, n[rule]))
    check(spark, rows, 1000)


def test_exact_gaps_days_and_none(spark):
    check(spark, [(1, t, t) for t in (-5000, 0, 1000, 1001, 2001, 2002, 86_400_000, 86_401_000, 86_401_001)], 1000)
    empty = spark.createDataFrame([], "rule_id long, island long, fired_ms long")
    assert al.notify_flags(empty).collect() == []
