"""Edge fixtures: odd names, zero rows, all-missing and constant columns,
other column types. Every operator must survive them."""

import datetime as dt
import decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framescope.operators import ask, charts, quality, stats
from framescope.operators.quantile import exact_quantiles
from framescope.plans.chart_plan import chart_plan
from framescope.plans.profile import profile


@pytest.fixture
def odd_df(spark):
    rows = [(float(i), f"v{i % 3}", i % 2 == 0, decimal.Decimal(f"{i}.50"), dt.date(2024, 1, 1 + i % 28),
             [i, i + 1], {"k": i}) for i in range(40)]
    return spark.createDataFrame(
        rows, "`a.b c` double, `name x` string, flag boolean, amount decimal(10,2), day date, "
              "arr array<int>, m map<string,int>")


def test_profile_with_odd_names_and_types(odd_df):
    prof = profile(odd_df)
    assert prof.quality.first()["duplicates"] == 0
    cols = {r["column"] for r in prof.describe.collect()}
    assert cols == {"a.b c", "amount"}
    plan = prof.chart_plan.collect()
    assert any(r["chart_type"] == "Trend Line" and r["x_axis"] == "day" for r in plan)
    for frame in prof.charts.values():
        frame.collect()
    prof.follow_ups.collect()
    prof.observations.collect()


def test_zero_rows(spark):
    df = spark.createDataFrame([], "x double, s string, d timestamp")
    r = quality.quality_report(df).first()
    assert r["total_rows"] == 0 and r["empty_columns"] == ["x", "s", "d"]
    assert stats.describe(df).count() == 0
    assert stats.correlation_matrix(df).count() == 0
    assert charts.histogram(df, "x").count() == 0
    assert chart_plan(df).count() == 0
    assert ask.sum_by_group(df, "s", "x").count() == 0


def test_all_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3.0, float(i)) for i in range(10)], "e double, k double, v double")
    d = {r["column"]: r for r in stats.describe(df).collect()}
    assert set(d) == {"k", "v"} and d["k"]["std"] == 0.0
    assert stats.iqr_outliers(df).count() == 0
    corr = {(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert corr[("k", "v")] is None and corr[("v", "v")] == 1.0
    h = charts.histogram(df, "k").collect()
    assert sum(r["count"] for r in h) == 10


def test_boolean_is_categorical(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "b boolean")
    assert [r["value"] for r in stats.top_values(df).orderBy("rank").collect()] == ["true", "false"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False, width=32), min_size=1, max_size=300),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, ["v"], [p], final_rows=20, sketch=16).first()["value"]
    assert got == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)), rel=1e-12, abs=1e-9)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200))
def test_histogram_property(spark, values):
    v = np.array(values, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    h = charts.histogram(df, "v").orderBy("bin").toPandas()
    counts, edges = np.histogram(v, bins=min(30, max(5, len(np.unique(v)))))
    assert list(h["count"]) == list(counts) and list(h["lo"]) == list(edges[:-1])


def test_dedup_with_map_and_dotted_columns(odd_df):
    doubled = odd_df.unionByName(odd_df)
    assert quality.duplicate_rows(doubled).first()["duplicates"] == 40
    assert quality.dedup_rows(doubled).count() == 40


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)),
                          st.one_of(st.none(), st.sampled_from(["a", "b"])),
                          st.sampled_from([0.0, -0.0, 1.5, float("nan")])),
                min_size=0, max_size=60),
       )
def test_duplicates_property(spark, rows):
    pdf = pd.DataFrame(rows, columns=["i", "s", "d"])
    df = spark.createDataFrame(rows, "i int, s string, d double")
    assert quality.duplicate_rows(df).first()["duplicates"] == int(pdf.duplicated().sum())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.just(float("nan")), st.floats(-1e4, 1e4, allow_nan=False)),
                min_size=1, max_size=80))
def test_describe_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = pd.Series(values, dtype=float).dropna()
    got = stats.describe(df).collect()
    if s.empty:
        assert got == []
        return
    r = got[0]
    assert r["n"] == len(s)
    for name, exp in (("mean", s.mean()), ("median", s.median()), ("min", s.min()), ("max", s.max()),
                      ("std", s.std() if len(s) > 1 else 0.0)):
        assert r[name] == pytest.approx(round(float(exp), 4), abs=2e-4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from(["x", "y", "z", "w", "v", "u", "t"])), min_size=1, max_size=80))
def test_top_values_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [(r["value"], r["count"]) for r in stats.top_values(df).orderBy("rank").collect()]
    vc = pd.Series(values, dtype=object).value_counts(dropna=True)
    exp = sorted(vc.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert got == [(k, int(v)) for k, v in exp]


def test_names_that_differ_only_by_case_are_refused(spark):
    from framescope.operators import quality, stats

    df = spark.createDataFrame([(1, 2.0)], "a long, b double").toDF("Total", "total")
    for operator in (stats.describe, quality.quality_report, stats.top_values):
        with pytest.raises(ValueError, match="'Total' and 'total' differ only by case"):
            operator(df)
