import numpy as np
import pandas as pd
import pytest

from framescope.functions.classes import ColumnNotFoundError
from framescope.operators import charts
from framescope.plans.chart_data import ChartSpec, chart_data
from framescope.plans.chart_plan import chart_plan


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    v = np.round(rng.gamma(2.0, 3.0, 2000), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    h = charts.histogram(df, "v").orderBy("bin").toPandas()
    counts, edges = np.histogram(v, bins=min(30, max(5, len(np.unique(v)))))
    assert list(h["count"]) == list(counts)
    assert list(h["lo"]) == list(edges[:-1]) and list(h["hi"]) == list(edges[1:])


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "v double")
    h = charts.histogram(df, "v").orderBy("bin").toPandas()
    counts, edges = np.histogram(np.array([5.0] * 4), bins=5)
    assert list(h["count"]) == list(counts) and list(h["lo"]) == list(edges[:-1])


def test_box_summary_matches_matplotlib_rules(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(50, 5, 300), [0.0, 120.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": ["a", "b"] * 151}))
    r = charts.box_summary(df, "v", decimals=None).first()
    q1, med, q3 = np.percentile(v, [25, 50, 75])
    iqr = q3 - q1
    hi = v[v <= q3 + 1.5 * iqr].max()
    lo = v[v >= q1 - 1.5 * iqr].min()
    fl = int(((v < lo) | (v > hi)).sum())
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
    assert (r["whisker_lo"], r["whisker_hi"], r["fliers"]) == (pytest.approx(lo), pytest.approx(hi), fl)
    by = {x["g"]: x for x in charts.box_summary(df, "v", by="g").collect()}
    assert set(by) == {"a", "b"} and sum(x["n"] for x in by.values()) == len(v)


def test_pie_shares_over_kept_slices(spark):
    rows = [(f"v{i}",) for i in range(10) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "s string")
    pie = charts.pie_shares(df, "s").collect()
    assert len(pie) == 8
    kept = sum(r["count"] for r in pie)
    top = max(pie, key=lambda r: r["count"])
    assert top["value"] == "v9" and top["share"] == round(10 * 100 / kept, 1)


def test_chart_plan_skips_empty_and_has_no_trend_without_dates(bodies_df, readings_df):
    plan = chart_plan(readings_df).collect()
    used = {r["column"] for r in plan} | {r["x_axis"] for r in plan} | {r["y_axis"] for r in plan}
    assert "remark" not in used
    assert any(r["chart_type"] == "Trend Line" for r in plan)
    assert not any(r["chart_type"] == "Trend Line" for r in chart_plan(bodies_df).collect())


def test_chart_dispatch(bodies_df):
    meta, frame = chart_data(bodies_df, ChartSpec("scatter", "height", "weight"))
    assert meta.chart_type == "Scatter Plot" and frame.count() == 36
    meta, frame = chart_data(bodies_df, ChartSpec("bar", x_column="side"))
    assert meta.x_axis == "Count" and frame.count() == 2
    meta, frame = chart_data(bodies_df, ChartSpec("bar", "side", "height"))
    assert frame.columns == ["side", "mean_y", "rank"]
    with pytest.raises(ValueError):
        chart_data(bodies_df, ChartSpec("gibberish"))
    with pytest.raises(ColumnNotFoundError):
        chart_data(bodies_df, ChartSpec("histogram", column="nope"))
    with pytest.raises(ValueError):
        chart_data(bodies_df, ChartSpec("line", x_column="height"))
    with pytest.raises(ValueError):
        chart_data(bodies_df.select("height", "side"), ChartSpec("heatmap"))


def test_line_series_sorted_complete_pairs(readings_df):
    rows = charts.line_series(readings_df, "taken", "rain").collect()
    assert len(rows) == 167 - 12
    assert [r["taken"] for r in rows] == sorted(r["taken"] for r in rows)


def test_histograms_many_columns_match_numpy(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 1500), "b": rng.integers(0, 7, 1500).astype(float),
                        "c": np.full(1500, 2.5)})
    h = charts.histograms(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas()
    for c in ("a", "b", "c"):
        got = h[h["column"] == c].sort_values("bin")
        counts, edges = np.histogram(pdf[c], bins=min(30, max(5, pdf[c].nunique())))
        assert list(got["count"]) == list(counts)
        assert list(got["lo"]) == list(edges[:-1]) and list(got["hi"]) == list(edges[1:])


@pytest.mark.parametrize("spec,chart_type,columns", [
    (ChartSpec("line", "taken", "wind"), "Line", ["taken", "wind"]),
    (ChartSpec("area", "taken", "rain"), "Area", ["taken", "rain"]),
    (ChartSpec("pie", x_column="station"), "Pie", ["value", "count", "share", "rank"]),
    (ChartSpec("box", column="wind"), "Box",
     ["n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "fliers"]),
    (ChartSpec("box", x_column="station", y_column="wind"), "Box",
     ["station", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "fliers"]),
    (ChartSpec("histogram", x_column="wind"), "Histogram", ["bin", "lo", "hi", "count"]),
    (ChartSpec("heatmap"), "Heatmap", ["column_a", "column_b", "r"]),
])
def test_chart_dispatch_every_type(readings_df, spec, chart_type, columns):
    meta, frame = chart_data(readings_df, spec)
    assert meta.chart_type == chart_type
    assert frame.columns == columns
    assert frame.count() > 0


def test_custom_heatmap_keeps_empty_numeric_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, None), (3.0, 5.0, None)], "a double, b double, e double")
    _, frame = chart_data(df, ChartSpec("heatmap"))
    got = {(r["column_a"], r["column_b"]): r["r"] for r in frame.collect()}
    assert ("e", "a") in got and got[("e", "a")] is None


def test_large_groups_of_a_box_are_not_sorted_by_key(spark, monkeypatch):
    """Rows of a large group meet their quartiles by broadcast, those of
    small groups by key; both give the boxes of the plain join."""
    rows = [("big", float(i * 37 % 101)) for i in range(300)] + [("wide", float(i * i)) for i in range(40)]
    rows += [(f"s{i % 5}", float(i * 13 % 29)) for i in range(60)] + [("one", 4.0), (None, 9.0), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = sorted(map(tuple, charts.box_summary(df, "v", by="g").collect()))
    assert len(want) == 8 and sum(r[1] for r in want) == 401
    monkeypatch.setattr(charts, "GROUP_ROWS", 20)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for exact in (True, False):
            assert sorted(map(tuple, charts.box_summary(df, "v", by="g").collect())) == want
        large = charts.box_summary(df.where("g IN ('big', 'wide')"), "v", by="g")
        assert sorted(map(tuple, large.collect())) == [r for r in want if r[0] in ("big", "wide")]
        assert "SortMergeJoin" not in large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
