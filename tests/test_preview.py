from __future__ import annotations

import pytest

from framescope.operators import preview


def samples(df, order_by, k=3) -> dict:
    return {r["column"]: r["samples"] for r in preview.sample_values(df, order_by, k).collect()}


@pytest.mark.parametrize("head", [1, 4, 200])
def test_samples_are_the_first_values_by_key(spark, monkeypatch, head):
    """Also of columns whose values begin late, are few or missing."""
    monkeypatch.setattr(preview, "HEAD_ROWS", head)
    rows = [(i, float(i) if i % 4 == 1 else float("nan"), f"t{i}" if i >= 90 else None, None, [i, None] if i == 50 else None)
            for i in range(100)]
    df = spark.createDataFrame(rows, "`a key` int, `v.x` double, t string, none string, l array<int>").repartition(7)
    assert samples(df, ["a key"]) == {"a key": ["0", "1", "2"], "v.x": ["1.0", "5.0", "9.0"], "t": ["t90", "t91", "t92"],
                                      "l": ["[50,null]"]}
    assert samples(df.where("t IS NULL"), ["a key"], 1) == {"a key": ["0"], "v.x": ["1.0"], "l": ["[50,null]"]}
    assert samples(df.limit(0), ["a key"]) == {}


def test_samples_sort_no_whole_table(spark):
    """The table goes through a top-k; windows see only the rows it kept."""
    df = spark.range(10_000).selectExpr("id AS k", "id % 7 AS v", "IF(id > 9000, id, NULL) AS late")
    got = preview.sample_values(df, ["k"])
    assert {r["column"]: r["samples"] for r in got.collect()}["late"] == ["9001", "9002", "9003"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" not in plan.split("TakeOrderedAndProject")[-1]
