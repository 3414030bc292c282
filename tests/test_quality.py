import numpy as np
import pandas as pd
import pytest

from framescope.operators import quality


def test_detects_missing_and_duplicates(readings_df, readings_pdf):
    r = quality.quality_report(readings_df).first()
    assert r["missing_values"] == int(readings_pdf.isnull().sum().sum()) == 179
    assert r["duplicates"] == 7
    assert "remark" in r["empty_columns"]
    assert r["total_rows"] == 167 and r["total_columns"] == 5


def test_no_issues_on_clean_data(bodies_df):
    r = quality.quality_report(bodies_df).first()
    assert r["missing_values"] == 0 and r["duplicates"] == 0 and r["empty_columns"] == []
    issues = quality.quality_issues(bodies_df).collect()
    assert [i["issue"] for i in issues] == ["no_issues"]


def test_issue_messages(readings_df):
    issues = {i["issue"]: i for i in quality.quality_issues(readings_df).collect()}
    assert issues["missing_values"]["message"] == "Fill or drop 179 missing values across 2 column(s)."
    assert issues["duplicates"]["message"] == "Remove 7 duplicate row(s)."
    assert issues["empty_columns"]["message"] == "Drop fully empty column(s): remark."


def test_basic_cleaning(readings_df):
    cleaned = quality.dedup_rows(readings_df)
    assert "remark" not in cleaned.columns
    assert cleaned.count() == 160
    assert quality.duplicate_rows(cleaned).first()["duplicates"] == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    m = quality.missing_by_column(df).first()
    assert (m["missing"], m["total"]) == (2, 3)


def test_duplicates_with_nulls_compare_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "k int, s string")
    assert quality.duplicate_rows(df).first()["duplicates"] == 3


def test_near_empty_bounds(spark):
    rows = [(i, "v" if i < 1 else None, None if i < 10 else "v") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, ninety string, hundred string")
    near = {r["column"] for r in quality.near_empty_columns(df).collect()}
    empty = {r["column"] for r in quality.empty_columns(df).collect()}
    assert near == {"ninety"} and empty == {"hundred"}


def test_zero_row_frame_all_columns_empty(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {r["column"] for r in quality.empty_columns(df).collect()} == {"a", "b"}


def test_numeric_as_text_patterns(spark):
    vals = ["$1,200", "12%", "-3.", "1e5", "12 units"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    r = quality.numeric_as_text(df).first()
    assert r["numeric_like"] == 3 and not r["flagged"]
    df2 = spark.createDataFrame([(v,) for v in ["$1,200", "12%", "-3.", "4", "5"]], "t string")
    assert quality.numeric_as_text(df2).first()["flagged"]


def test_drop_empty_columns_keeps_order(readings_df):
    assert quality.drop_empty_columns(readings_df).columns == ["taken", "station", "wind", "rain"]


def test_missing_matches_pandas(readings_df, readings_pdf):
    got = {r["column"]: r["missing"] for r in quality.missing_by_column(readings_df).collect()}
    exp = readings_pdf.isnull().sum().to_dict()
    assert got == {k: int(v) for k, v in exp.items()}
    assert np.isclose(sum(got.values()), 179)


def test_duplicates_hash_prefilter_paths(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 2.0), (1, None, 2.0), (2, 2, 3.0), (2, 2, 3.0)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    assert quality.duplicate_rows(df).first()["duplicates"] == 2  # -0.0 equals 0.0
    assert quality.duplicate_rows(df.select("a", "b")).first()["duplicates"] == 3


@pytest.mark.parametrize("map_bits", [26, 10])
def test_dedup_rows_equals_pandas(spark, monkeypatch, map_bits):
    monkeypatch.setattr(quality, "MAP_BITS", map_bits)
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame({"a": rng.integers(0, 400, 3000), "b": rng.choice([0.0, -0.0, 1.5, np.nan], 3000),
                        "c": rng.choice(["x", "y", None], 3000)})
    pdf.loc[:900, ["a", "b", "c"]] = [7, 1.5, "x"]  # a third of the rows are one row
    df = spark.createDataFrame(pdf).repartition(6)
    got = quality.dedup_rows(df).toPandas()
    want = pdf.assign(b=pdf.b + 0.0).drop_duplicates()
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).assign(b=f.b + 0.0).itertuples(index=False)))
    assert key(got) == key(want)


def test_dedup_rows_compares_nested_floats_by_value(spark):
    df = spark.sql("SELECT explode(array(named_struct('a', array(0.0D), 'b', 1), named_struct('a', array(-0.0D), 'b', 1), "
                   "named_struct('a', array(2.0D), 'b', 1))) AS s").select("s.*")
    assert quality.dedup_rows(df).count() == 2
    assert quality.dedup_rows(df.select("a")).count() == 2
    assert quality.duplicate_rows(df).first()[0] == 1


def test_unique_rows_pass_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select((F.col("id") % 1990).alias("k"), F.concat(F.lit("text "), (F.col("id") % 1990).cast("string")).alias("t"))
    out = quality.dedup_rows(df)
    assert out.count() == 1990
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union"):]
    first, second = union.split("+- Aggregate") if "+- Aggregate" in union else (union, "")
    assert "Aggregate" not in first.split("\n:- ")[0] and second  # only the second branch groups rows
    assert out.select("t").where("false").count() == 0
