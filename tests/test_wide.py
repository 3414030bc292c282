"""Correlations from blocks of columns, against pandas and the narrow path."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framescope.operators import charts, gram, stats


def wide_pandas(rows: int, width: int, seed: int = 3) -> pd.DataFrame:
    """Columns around shared factors: every third one has gaps, one is
    constant, one empty, one far from zero."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 4)) @ rng.normal(size=(4, width)) + rng.normal(size=(rows, width))
    base[:, ::3][rng.random((rows, len(range(0, width, 3)))) < 0.3] = np.nan
    base[:, 1], base[:, 3], base[:, 4] = 7.0, np.nan, base[:, 4] + 1e6
    return pd.DataFrame(base, columns=[f"c{i}" for i in range(width)])


def pair_dict(frame) -> dict:
    return {(r["column_a"], r["column_b"]): r["r"] for r in frame.collect()}


def same(got: dict, want: dict) -> None:
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None), (k, got[k], r)
        assert r is None or abs(got[k] - r) < 1e-9, (k, got[k], r)


def wanted(pdf: pd.DataFrame) -> dict:
    with np.errstate(all="ignore"):
        r = pdf.corr()
    return {(a, b): None if np.isnan(r.loc[a, b]) else r.loc[a, b] for a in pdf for b in pdf}


@pytest.mark.parametrize("tile, state, fan", [(128, 256 << 20, 32), (7, 256 << 20, 2), (16, 20_000, 4)])
def test_blocks_agree_with_pandas(spark, monkeypatch, tile, state, fan):
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    for name, value in (("TILE", tile), ("STATE", state), ("FAN", fan), ("CHUNK", 40_000)):
        monkeypatch.setattr(gram, name, value)
    pdf = wide_pandas(700, 40)
    got = pair_dict(stats.correlation_matrix(spark.createDataFrame(pdf).repartition(9), decimals=None))
    same(got, wanted(pdf.drop(columns="c3")))


def test_named_columns_keep_the_empty_one(spark, monkeypatch):
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    pdf = wide_pandas(60, 6)
    names = ["c5", "c3", "c0"]
    got = pair_dict(charts.heatmap(spark.createDataFrame(pdf), columns=names))
    same(got, wanted(pdf[names]))


def test_infinite_value_spoils_its_pairs_only_where_it_meets(spark, monkeypatch):
    """An infinity counts on the rows of a pair alone, as in narrow tables."""
    rows = [(float(i), float(i * i % 7), None if i == 3 else float(i % 5), float("inf") if i == 3 else float(i % 4))
            for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    narrow = pair_dict(stats.correlation_matrix(df, None))
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    wide = pair_dict(stats.correlation_matrix(df, None))
    same(wide, narrow)
    assert wide[("a", "d")] is None and wide[("c", "d")] is not None


def test_empty_and_tiny_tables(spark, monkeypatch):
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    empty = spark.createDataFrame([], "x double, y double")
    assert stats.correlation_matrix(empty).count() == 0
    assert set(pair_dict(stats.correlation_matrix(empty, None, ["x", "y"])).values()) == {None}
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert pair_dict(stats.correlation_matrix(one))[("x", "y")] is None
    same_rows = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0)], "x double, y double")
    assert pair_dict(stats.correlation_matrix(same_rows))[("x", "y")] is None


def test_odd_names_and_strong_pairs(spark, monkeypatch):
    pdf = pd.DataFrame({"a.b c": np.arange(50.0), "tile": np.arange(50.0) * 2 + np.arange(50) % 3,
                        "it's `odd`": -np.arange(50.0)})
    df = spark.createDataFrame(pdf)
    narrow = [r.asDict() for r in stats.strong_correlations(df).orderBy("rank").collect()]
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    assert [r.asDict() for r in stats.strong_correlations(df).orderBy("rank").collect()] == narrow
    assert len(narrow) == 3


def test_two_thousand_columns(spark, tmp_path):
    """The plan holds no expression a pair: two reads, whatever the width."""
    width = 2000
    pdf = wide_pandas(300, width)
    path = str(tmp_path / "wide.parquet")
    pdf.to_parquet(path)
    df = spark.read.parquet(path)
    begin = time.time()
    upper, cols, varies = stats.pair_correlations(df)
    n = upper.count()
    assert n == len(cols) * (len(cols) - 1) // 2 and len(cols) == width - 1
    print(f"{width} columns: {time.time() - begin:.1f} s")
    want = pdf[["c0", "c1", "c4", "c1500", "c1998"]].corr()
    got = pair_dict(upper.where("column_a IN ('c0', 'c1', 'c4') AND column_b IN ('c1500', 'c1998')"))
    for (a, b), r in got.items():
        assert (r is None and np.isnan(want.loc[a, b])) or abs(r - want.loc[a, b]) < 1e-9
    assert not varies["c1"] and varies["c4"]


def test_wide_table_is_read_once(spark):
    """The table is packed in one read; its plan is not made again for the
    facts and for the pairs."""
    rows, width = 50, stats.WIDE_COLUMNS + 6
    seen = spark.sparkContext.accumulator(0)
    values = np.random.default_rng(5).normal(size=(rows, width))

    def read(row):
        seen.add(1)
        return [float(x) for x in row]

    df = spark.createDataFrame(spark.sparkContext.parallelize(values.tolist(), 3).map(read),
                               ", ".join(f"c{i} double" for i in range(width)))
    got = pair_dict(stats.correlation_matrix(df, None))
    same(got, wanted(pd.DataFrame(values, columns=df.columns)))
    assert seen.value == rows


def test_wide_table_with_empty_columns_left_out(spark, monkeypatch):
    """Packed columns that hold nothing stay out of the pairs."""
    monkeypatch.setattr(stats, "WIDE_COLUMNS", 2)
    for name, value in (("TILE", 3), ("PACK", 100), ("CHUNK", 300)):
        monkeypatch.setattr(gram, name, value)
    pdf = wide_pandas(40, 9)
    pdf.loc[::2, "c6"] = np.nan
    pdf[["c0", "c8"]] = np.nan
    got = pair_dict(stats.correlation_matrix(spark.createDataFrame(pdf).repartition(4), None))
    same(got, wanted(pdf.drop(columns=["c0", "c3", "c8"])))


def odd_cells(spark):
    """Sales by day and shop: gaps, a day and a shop without a name, a shop and
    a day that never sold, a shop of one value."""
    rng = np.random.default_rng(11)
    rows = [(None if d == 4 else f"d{d}", None if k == 3 else k * 7, None if k == 5 or d == 2 or rng.random() < 0.2
             else 0.0 if k == 6 else float("nan") if rng.random() < 0.1 else float(rng.integers(1, 30)) * (1 + k % 3))
            for d in range(40) for k in range(12) if rng.random() < 0.9 for _ in range(2)]
    return spark.createDataFrame(rows, "day string, shop int, sold double")


@pytest.mark.parametrize("tile, state, pack, chunk", [(128, 256 << 20, 256 << 10, 16 << 20), (2, 1500, 150, 300)])
def test_cells_agree_with_a_pivoted_frame(spark, monkeypatch, tile, state, pack, chunk):
    """Cells give what the frame with a column for each key gives."""
    df = odd_cells(spark)
    sums = F.sum("sold").alias("sold")
    frame = df.groupBy("day").pivot("shop").agg(sums)
    frame = frame.toDF("day", *[f"s{c}" for c in frame.columns[1:]])
    want = pair_dict(stats.correlation_matrix(frame, None))
    strong = [r.asDict() for r in stats.strong_correlations(frame, 0.1).orderBy("rank").collect()]
    for name, value in (("TILE", tile), ("STATE", state), ("PACK", pack), ("CHUNK", chunk), ("SLICE", 3)):
        monkeypatch.setattr(gram, name, value)
    cells = gram.Pivoted(df.groupBy("day", "shop").agg(sums), "day", "shop", "sold", "s{}")
    same(pair_dict(stats.correlation_matrix(cells, None)), want)
    assert [r.asDict() for r in stats.strong_correlations(cells, 0.1).orderBy("rank").collect()] == strong
    assert ("snull", "s0") in want and strong and None in want.values()


def test_blocks_of_columns_agree_with_pandas(spark, monkeypatch):
    """Where the sums would outweigh the rows, blocks of columns meet in tasks
    of their own; infinities spoil their pairs there, too."""
    for name, value in (("TILE", 4), ("STATE", 20_000), ("CHUNK", 4_000), ("PACK", 3_000), ("SLICE", 5)):
        monkeypatch.setattr(gram, name, value)
    monkeypatch.setattr(stats, "PAIRS_WRITTEN", 10)
    met = []
    monkeypatch.setattr(gram, "_by_columns", lambda *a, f=gram._by_columns: met.append(1) or f(*a))
    pdf = wide_pandas(90, 70)
    df = spark.createDataFrame(pdf).repartition(5)
    want = wanted(pdf.drop(columns="c3"))
    same(pair_dict(stats.correlation_matrix(df, decimals=None)), want)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in stats.strong_correlations(df, 0.5).collect()}
    close = {p for p, r in want.items() if int(p[0][1:]) < int(p[1][1:]) and r is not None and abs(r) >= 0.5005}
    assert close <= got.keys() and all(abs(want[p] - r) < 0.0006 for p, r in got.items()) and len(close) > 50
    assert len(met) == 2
    pdf.loc[7, "c9"] = np.inf
    r = pair_dict(stats.correlation_matrix(spark.createDataFrame(pdf).repartition(5), decimals=None))
    assert r[("c9", "c2")] is None
    same({p: x for p, x in r.items() if "c9" not in p}, {p: x for p, x in want.items() if "c9" not in p})


def test_more_columns_than_a_pivot_takes(spark):
    """Spark's pivot refuses more than ``spark.sql.pivotMaxValues`` columns, and
    no plan holds that many."""
    limit = int(spark.conf.get("spark.sql.pivotMaxValues"))
    cells = spark.range(3 * (limit + 2)).select(
        (F.col("id") % 3).alias("row"), F.floor(F.col("id") / 3).alias("key"),
        F.hash("id").cast("double").alias("value"))
    pairs = stats.strong_correlations(gram.Pivoted(cells, "row", "key", "value"), 1.0)
    exact = stats.pair_correlations(gram.Pivoted(cells.where("key % 2000 = 1"), "row", "key", "value"))[0]
    assert exact.count() == 6 * 5 // 2
    # any two columns of three rows: some thousandths of the pairs round to 1
    assert pairs.count() > limit


def test_supplier_days_take_any_number_of_suppliers(spark, tmp_path):
    """The queries run where suppliers outnumber a pivot's columns."""
    import __spark_entry__ as entry

    rows = [(k, f"2020-01-0{1 + d}", float((k * 7 + d * d * (k % 3 + 1)) % 11)) for k in range(12) for d in range(9)]
    spark.createDataFrame(rows, "l_suppkey long, d string, l_quantity double").selectExpr(
        "l_suppkey", "CAST(d AS TIMESTAMP_NTZ) AS l_shipdate", "l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", 10)
    try:
        assert entry.queries()["correlation_wide"](spark, str(tmp_path)).count() == 12 * 12
        strong = entry.queries()["strong_correlations_wide"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)
    pdf = pd.DataFrame(rows, columns=["k", "d", "q"]).pivot(index="d", columns="k", values="q")
    r = pdf.corr()
    assert {(x["column_a"], x["column_b"]) for x in strong} == {
        (f"s{a}", f"s{b}") for a in r for b in r if a < b and abs(round(r.loc[a, b], 3)) >= 0.25}
