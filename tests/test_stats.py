import math

import numpy as np
import pandas as pd
import pytest

from framescope.operators import stats
from framescope.operators.quantile import exact_quantiles


def test_correlation_detected(correlated_df):
    strong = stats.strong_correlations(correlated_df).collect()
    assert len(strong) == 1 and strong[0]["r"] < -0.9
    assert strong[0]["description"].startswith("x is negatively correlated with y (")


def test_single_numeric_column_has_empty_matrix(bodies_df):
    assert stats.correlation_matrix(bodies_df.select("height", "side")).count() == 0


def test_top_categories(bodies_df):
    tops = stats.top_values(bodies_df).collect()
    assert {r["column"] for r in tops} == {"side"}


def test_describe_matches_pandas(readings_df, readings_pdf):
    got = {r["column"]: r for r in stats.describe(readings_df).collect()}
    assert set(got) == {"wind", "rain"}
    for c in ("wind", "rain"):
        s = readings_pdf[c].dropna()
        assert got[c]["n"] == len(s)
        for k, v in (("mean", s.mean()), ("median", s.median()), ("std", s.std()), ("min", s.min()),
                     ("max", s.max())):
            assert got[c][k] == pytest.approx(round(float(v), 4), abs=1e-4)


def test_std_is_zero_for_one_value(spark):
    df = spark.createDataFrame([(1.5,)], "v double")
    assert stats.describe(df).first()["std"] == 0.0


def test_correlation_matches_pandas_pairwise(readings_df, readings_pdf):
    got = {(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_matrix(readings_df).collect()}
    exp = readings_pdf[["wind", "rain"]].corr().round(3)
    for a in ("wind", "rain"):
        for b in ("wind", "rain"):
            assert got[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-9)


def test_constant_column_correlation_is_missing(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i * 2)) for i in range(10)], "a double, k double, b double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "b")] == 1.0


def test_outliers_match_pandas(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 500), [15, -20, 30]])
    pdf = pd.DataFrame({"v": v})
    q1, q3 = pdf.v.quantile(0.25), pdf.v.quantile(0.75)
    iqr = q3 - q1
    exp = int(((pdf.v < q1 - 1.5 * iqr) | (pdf.v > q3 + 1.5 * iqr)).sum())
    r = stats.iqr_outliers(spark.createDataFrame(pdf)).first()
    assert r["count"] == exp
    assert r["percentage"] == round(exp / len(v) * 100, 2)


def test_outliers_need_four_values_and_spread(tiny_df, spark):
    assert stats.iqr_outliers(tiny_df).count() == 0
    const = spark.createDataFrame([(1.0,)] * 10 + [(9.0,)], "v double")
    assert stats.iqr_outliers(const).count() == 0  # iqr == 0 is skipped


def test_distinct_and_roles(bodies_df):
    d = {r["column"]: r["distinct"] for r in stats.distinct_counts(bodies_df).collect()}
    assert d["side"] == 2
    roles = {r["column"]: r for r in stats.column_roles(bodies_df).collect()}
    assert roles["side"]["description"] == "A categorical field with 2 distinct value(s)."
    assert roles["height"]["description"].startswith("A numeric measure ranging from ")


@pytest.mark.parametrize("final_rows,sketch,group_rows", [(1_000_000, 2000, 50_000), (40, 16, 50_000), (40, 64, 200), (1_000_000, 200, 0)])
def test_exact_quantiles_against_pandas(spark, final_rows, sketch, group_rows):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "x": rng.normal(0, 1, n),
        "hot_value": np.where(rng.random(n) < 0.34, 7.0, rng.exponential(2, n)),
    })
    pdf.loc[:20, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "hot_value"], probs, final_rows=final_rows, sketch=sketch).collect()
    assert len(got) == 2 * len(probs)
    for r in got:
        assert r["value"] == pytest.approx(pdf[r["column"]].quantile(r["p"]), abs=1e-12)
    got = exact_quantiles(df, ["x"], probs, group_cols=["g"], final_rows=final_rows, sketch=sketch,
                          group_rows=group_rows).collect()
    assert len(got) == 3 * len(probs)
    for r in got:
        exp = pdf[pdf.g == r["g"]]["x"].quantile(r["p"])
        assert r["value"] == pytest.approx(exp, abs=1e-12)


def test_quantiles_all_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 1000, "v double")
    got = exact_quantiles(df, ["v"], [0.25, 0.5], final_rows=10, sketch=16).collect()
    assert all(r["value"] == 2.0 for r in got)


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",)], "s string")
    got = [(r["value"], r["count"], r["rank"]) for r in stats.top_values(df).orderBy("rank").collect()]
    assert got == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]
    assert not any(math.isnan(c) for _, c, _ in got)


def test_whole_table_quantiles_of_heavy_tails_in_two_reads(spark, monkeypatch):
    from framescope.operators import quantile as q

    reads, largest, inside, write = [], [], q._inside, q.written

    def counted(*args):
        reads.append(1)
        return inside(*args)

    def sized(df, name):
        out = write(df, name)
        largest.append(out.count())
        return out

    monkeypatch.setattr(q, "_inside", counted)
    monkeypatch.setattr(q, "written", sized)
    rng = np.random.default_rng(14)
    v = np.exp(rng.normal(0, 60, 40_000))
    v[:3], v[3:9] = np.inf, -np.inf
    pdf = pd.DataFrame({"v": v})
    got = exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], final_rows=500).collect()
    order = np.sort(v)
    assert len(got) == 5
    for r in got:
        h = (len(v) - 1) * r["p"]
        lo, hi = order[int(h)], order[min(int(h) + 1, len(v) - 1)]
        assert r["value"] == (lo if lo == hi else pytest.approx(lo + (h - int(h)) * (hi - lo), rel=1e-12))
    assert len(reads) == 1  # beside the read that sketches
    assert largest[0] < 0.06 * len(v)  # five brackets of about a hundredth


def test_a_bracket_that_misses_is_done_again(spark, monkeypatch):
    from framescope.operators import quantile as q

    monkeypatch.setattr(q, "MARGIN", 1e-9)  # no room for the sketch's error
    rng = np.random.default_rng(15)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 9000), "v": rng.normal(0, 1, 9000)})
    df = spark.createDataFrame(pdf).repartition(7)
    for r in exact_quantiles(df, ["v"], [0.3, 0.5], sketch=8).collect():
        assert r["value"] == pytest.approx(pdf.v.quantile(r["p"]), abs=1e-12)
    for r in exact_quantiles(df, ["v"], [0.3, 0.5], ["g"], sketch=8, group_rows=100).collect():
        assert r["value"] == pytest.approx(pdf[pdf.g == r["g"]].v.quantile(r["p"]), abs=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (float("nan"), 2.0, "a")], "e double, v double, g string")
    got = exact_quantiles(df, ["e", "v"], [0.5]).collect()
    assert [(r["column"], r["value"]) for r in got] == [("v", 1.5)]
    assert exact_quantiles(df.limit(0), ["e", "v"], [0.5]).count() == 0
    assert [tuple(r) for r in exact_quantiles(df, ["e", "v"], [0.5], ["g"], group_rows=0).collect()] == [("a", "v", 0.5, 1.5)]


def test_approx_quantiles_close(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"v": rng.normal(0, 1, 5000)})
    q = stats.quartiles(spark.createDataFrame(pdf), exact=False).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert q[name] == pytest.approx(pdf.v.quantile(p), abs=0.01)


@pytest.mark.parametrize("final_rows", [20, 100_000])
def test_grouped_quantiles_split_a_hot_group(spark, monkeypatch, final_rows):
    from framescope.operators import quantile as q

    plans, write = {}, q.written

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(q, "written", kept)
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"p": np.where(rng.random(6000) < 0.4, 0, rng.integers(0, 300, 6000)), "value": rng.exponential(3, 6000)})
    got = q.grouped_quantiles(spark.createDataFrame(pdf), ["value"], [0.5, 0.9], ["p"], final_rows=final_rows, group_rows=500).collect()
    assert len(got) == pdf["p"].nunique()
    for r in got:
        own = pdf[pdf["p"] == r["_g0"]]["value"]
        assert (r["_n0"], r["_q0_0"], r["_q0_1"]) == (len(own), pytest.approx(own.quantile(0.5), abs=1e-12),
                                                      pytest.approx(own.quantile(0.9), abs=1e-12))
    # many values inside the brackets are dealt out by ranges of (group, value)
    assert ("ranges" in plans) == (final_rows == 20)
    if final_rows == 20:
        assert "rangepartitioning(_g0#" in plans["ranges"] and "_v#" in plans["ranges"].split("rangepartitioning(")[1]


def test_pairs_agree_at_every_width_and_infinity_has_no_coefficient(spark):
    rng = np.random.default_rng(29)
    n = 400
    a = rng.normal(5, 1, n)
    b = np.where(np.arange(n) < 50, 1e6 / 3, np.nan)  # constant where it is present
    c = np.where(np.arange(n) < 50, 0.1, rng.normal(0, 1, n))  # constant on the rows shared with b
    narrow = pd.DataFrame({"a": a, "b": b, "c": c, "k": np.where(np.arange(n) == 7, np.inf, a)})
    wide = narrow.assign(**{f"w{i}": rng.normal(0, 1, n) for i in range(20)})
    got = [{(r["column_a"], r["column_b"]): r["r"] for r in stats.correlation_matrix(
        spark.createDataFrame(t), decimals=None).collect()} for t in (narrow, wide)]
    for x in narrow:
        for y in narrow:
            assert got[0][x, y] == got[1][x, y] or got[0][x, y] == pytest.approx(got[1][x, y], abs=1e-12)
            e = narrow.corr().loc[x, y] if "k" not in (x, y) else np.nan
            if "b" in (x, y) or np.isnan(e):
                assert got[0][x, y] is None
            else:
                assert got[0][x, y] == pytest.approx(e, abs=1e-9)
    strong = stats.strong_correlations(spark.createDataFrame(narrow)).collect()
    assert not any("k" in (r["column_a"], r["column_b"]) or "NaN" in r["description"] for r in strong)


def test_wide_table_with_missing_values(spark):
    rng = np.random.default_rng(17)
    n = 3000
    data = {f"c{i}": rng.normal(0, 1, n) + (i % 3) * rng.normal(0, 1, n) for i in range(17)}
    data["k"] = np.full(n, 2.0)
    data["m1"] = np.where(rng.random(n) < 0.2, np.nan, data["c0"] * 3 + rng.normal(0, 1, n))
    data["m2"] = np.where(rng.random(n) < 0.1, np.nan, rng.normal(0, 1, n))
    pdf = pd.DataFrame(data)
    got = {(r["column_a"], r["column_b"]): r["r"]
           for r in stats.correlation_matrix(spark.createDataFrame(pdf), decimals=None).collect()}
    exp = pdf.corr()
    for (a, b), r in got.items():
        e = exp.loc[a, b]
        if np.isnan(e):
            assert r is None
        else:
            assert r == pytest.approx(e, abs=1e-9)
    assert len(got) == 20 * 20


def test_wide_table_all_columns_with_missing_values(spark):
    rng = np.random.default_rng(19)
    n = 4000
    base = rng.normal(0, 1, n)
    data = {}
    for i in range(18):
        v = base * (i % 4) + rng.normal(50, 2 + i, n)
        data[f"c{i}"] = np.where(rng.random(n) < 0.05 + 0.02 * i, np.nan, v)
    pdf = pd.DataFrame(data)
    got = {(r["column_a"], r["column_b"]): r["r"]
           for r in stats.correlation_matrix(spark.createDataFrame(pdf), decimals=None).collect()}
    exp = pdf.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(exp.loc[a, b], abs=1e-9)


def test_approximate_describe_and_box(spark):
    from framescope.operators import charts

    rng = np.random.default_rng(23)
    pdf = pd.DataFrame({"v": rng.normal(10, 2, 4000), "g": rng.choice(["a", "b"], 4000)})
    df = spark.createDataFrame(pdf)
    d = stats.describe(df, exact=False).first()
    assert d["median"] == pytest.approx(pdf.v.median(), abs=0.02)
    b = {r["g"]: r for r in charts.box_summary(df, "v", by="g", exact=False).collect()}
    assert b["a"]["median"] == pytest.approx(pdf[pdf.g == "a"].v.median(), abs=0.05)
