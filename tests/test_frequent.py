"""Frequent values against plain counting, with and without the sketch's proof."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from framescope.operators import ask, frequent, stats
from tests.test_plans import plan_of

HEAD = "the same long beginning of every text in this column, sixty-four characters and more: "


def expected(values, k):
    n = collections.Counter(v for v in values if v is not None)
    return [(v, c, i + 1) for i, (v, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:k])]


def answers(df):
    return [(r["value"], r["count"], r["rank"]) for r in df.orderBy("rank").collect()]


def skewed(n, kinds, seed, make):
    rng = np.random.default_rng(seed)
    return [make(int(x)) if x else None for x in np.minimum(rng.zipf(1.3, n), kinds)]


@pytest.mark.parametrize("tracked, candidates", [(10_000, 200), (64, 20), (64, 2)])
@pytest.mark.parametrize("make", [str, lambda x: HEAD + f"{x * 7 % 101} {x}" * (x % 3 + 1)])
def test_frequent_values_equal_plain_counts(spark, monkeypatch, tracked, candidates, make):
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    monkeypatch.setattr(frequent, "CANDIDATES", candidates)
    values = skewed(4000, 900, 3, make)
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v string, _c int").repartition(5)
    for k in (1, 5, 12):
        assert answers(stats.value_counts(df, "v", k)) == expected(values, k)
        assert [tuple(r) for r in ask.count_by_group(df, "v", k).collect()] == [x[:2] for x in expected(values, k)]


@pytest.mark.parametrize("make", [lambda x: f"only {x:03}", lambda x: HEAD + f"{x:03}"])
def test_values_that_all_occur_once_are_taken_in_order(spark, make):
    values = [make(x) for x in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    assert answers(stats.value_counts(df, "v", 5)) == expected(values, 5)


def test_short_value_that_begins_a_long_one(spark):
    values = [HEAD[:64]] * 3 + [HEAD[:64] + "x"] * 3 + [HEAD[:64] + "a"] * 3 + ["b", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert answers(stats.value_counts(df, "v", 3)) == expected(values, 3)


def test_many_columns_and_no_values(spark):
    rows = [(None, "a" * 100, i, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "e string, l string, `_n` long, b boolean")
    got = {(r["column"], r["value"], r["count"], r["rank"]) for r in stats.top_values(df, ["e", "l", "_n", "b"], 1).collect()}
    assert got == {("l", "a" * 100, 10, 1), ("_n", "0", 1, 1), ("b", "false", 5, 1)}
    assert stats.top_values(df.limit(0), ["e", "l"], 3).count() == 0


def test_no_long_text_is_shuffled_and_only_candidates_are_counted(spark, monkeypatch):
    plans, write = [], frequent.written
    monkeypatch.setattr(frequent, "written", lambda df, name: (plans.append(plan_of(df)), write(df, name))[1])
    values = [HEAD + str(x) for x in [*range(500), *[1000] * 900, *[2000] * 800]]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    out = stats.value_counts(df, "v", 2)
    assert answers(out) == expected(values, 2)
    counted = plans[0].split("HashAggregate(keys=")[-1]
    assert "xxhash64" in plans[0] and ("IN (" in plans[0] or "INSET" in plans[0])  # candidates alone
    assert "_s#" in counted and "_h#" in counted
    assert "BroadcastHashJoin" in plan_of(out)  # winners meet the texts where these are


def test_bound_of_the_sketch():
    listed = [{"item": i, "count": c} for i, c in enumerate([500, 400, 90])]
    assert frequent._proven(listed, 1_000, 2) == [0, 1, 2]  # 400 of 1,000 cannot be passed
    assert frequent._proven(listed, 990, 5) == [0, 1, 2]  # all rows are listed
    assert frequent._proven(listed, 1_000_000, 2) is None  # 400 may be noise
