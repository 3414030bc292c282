import pytest

from framescope.operators import ask, charts, quality
from framescope.sources.sinks import to_payload


def test_single_values(bodies_df, bodies_pdf):
    for column in ("height", "weight"):
        for op, name in ((ask.avg_col, "mean"), (ask.max_col, "max"), (ask.min_col, "min")):
            assert op(bodies_df, column).first()["value"] == getattr(bodies_pdf[column], name)()
    assert ask.row_count(bodies_df).first()["rows"] == len(bodies_pdf)


def test_totals_and_counts_by_group(readings_df, readings_pdf):
    by = readings_pdf.groupby("station")
    table = to_payload(ask.sum_by_group(readings_df, "station", "rain"))
    assert table == {"columns": ["station", "rain"], "truncated": False,
                     "rows": [[k, round(v, 4)] for k, v in sorted(by["rain"].sum().items())]}
    sizes = sorted(by.size().items(), key=lambda kv: (-kv[1], kv[0]))
    assert [tuple(r) for r in ask.count_by_group(readings_df, "station").collect()] == sizes
    assert [tuple(r) for r in ask.top_n_values(readings_df, "station", 2).collect()] == sizes[:2]


def test_totals_do_not_overflow(spark):
    big = (1 << 62) + 5
    df = spark.createDataFrame([("a", big, 1)] * 5 + [("b", -big, 2)] * 3 + [("c", None, 3)], "g string, v long, m int")
    got = {r["g"]: int(r["v"]) for r in ask.sum_by_group(df, "g", "v").collect()}
    assert got == {"a": 5 * big, "b": -3 * big, "c": 0}
    assert int(ask.argmax_group(df, "g", "v").first()["total"]) == 5 * big
    assert {r["g"]: int(r["v"]) for r in ask.group_agg(df, ["g"], "v", "sum").collect()} == got


NAMES = ("n", "count", "value", "p", "_h", "column", "v", "q1", "total", "rank", "_g0", "_v", "a.b", "x`y")


@pytest.mark.parametrize("name", NAMES)
def test_any_column_name(spark, name):
    rows = [("b", 1.0), ("b", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0)]
    df = spark.createDataFrame(rows, "g string, w double").toDF(name, "measure")
    assert quality.duplicate_rows(df).first()[0] == 1
    assert [tuple(r) for r in ask.count_by_group(df, name).collect()] == [("a", 3), ("b", 2)]
    assert [tuple(r) for r in ask.count_by_group(df, name, 1).collect()] == [("a", 3)]
    assert sorted(map(tuple, ask.group_agg(df, [name], "measure", "median").collect())) == [("a", 4.0), ("b", 1.0)]
    assert [tuple(r) for r in ask.sum_by_group(df, name, "measure").collect()] == [("a", 15.0), ("b", 2.0)]
    assert tuple(ask.argmax_group(df, name, "measure").first()) == ("a", 15.0)
    box = {r[0]: r["median"] for r in charts.box_summary(df, "measure", by=name).collect()}
    assert box == {"a": 4.0, "b": 1.0}
    assert [r[0] for r in charts.bar_mean_by_category(df, name, "measure").collect()] == ["a", "b"]
    if name != "truncated":
        assert [tuple(r) for r in ask.capped(df, ["measure"], 2).collect()] == [("b", 1.0, True)] * 2


def test_argmax_month_threshold(readings_df, readings_pdf):
    g = ask.argmax_group(readings_df, "station", "wind").first()
    assert g["station"] == readings_pdf.groupby("station")["wind"].sum().idxmax()
    m = ask.best_month(readings_df, "taken", "rain").first()
    exp = readings_pdf.groupby(readings_pdf["taken"].dt.to_period("M"))["rain"].sum().idxmax()
    assert m["month"] == str(exp)
    assert ask.count_above(readings_df, "wind", 500).first()["count"] == int((readings_pdf.wind > 500).sum())


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, v double")
    got = {r["g"]: r["v"] for r in ask.sum_by_group(df, "g", "v").collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_group_agg_variants(readings_df, readings_pdf):
    for agg, fn in (("mean", "mean"), ("median", "median"), ("nunique", "nunique"), ("max", "max")):
        got = {r["station"]: r["wind"] for r in ask.group_agg(readings_df, ["station"], "wind", agg).collect()}
        exp = getattr(readings_pdf.groupby("station")["wind"], fn)()
        for k, v in exp.items():
            assert abs(got[k] - v) < 1e-9


def test_capped_and_shaped(readings_df):
    rows = ask.capped(readings_df, ["taken", "station"], cap=10).collect()
    assert len(rows) == 10 and all(r["truncated"] for r in rows)
    shaped = ask.shape_result(readings_df).first()
    assert isinstance(shaped["taken"], str) and len(shaped["taken"]) == 10


def test_rows_above_excludes_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (5.0,), (None,)], "v double")
    assert [r["v"] for r in ask.rows_above(df, "v", 2).collect()] == [5.0]
    assert ask.count_above(df, "v", 2).first()["count"] == 1
