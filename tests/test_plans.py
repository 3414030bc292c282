"""Physical-plan checks for the scale properties the operators rely on."""

import pytest

import __spark_entry__ as E
from framescope.operators import ask, charts, findings, quality, stats

SF = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_values_limit_before_shuffle(spark):
    p = plan_of(stats.top_values(spark.read.parquet(f"{SF}/orders.parquet")))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_threshold_filter_reaches_parquet(spark):
    p = plan_of(ask.rows_above(spark.read.parquet(f"{SF}/orders.parquet"), "o_totalprice", 450000))
    assert "GreaterThan(o_totalprice,450000.0)" in p


def test_group_total_reads_two_columns(spark):
    p = plan_of(ask.sum_by_group(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_returnflag", "l_extendedprice"))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in p
    assert "partial_sum" in p


PASSES = {
    "quality": lambda s: quality.quality_report(E.messy_lineitem(s, SF)),
    "describe": lambda s: stats.describe(s.read.parquet(f"{SF}/lineitem.parquet")),
    "outliers": lambda s: stats.iqr_outliers(s.read.parquet(f"{SF}/events.parquet")),
    "box": lambda s: charts.box_summary(s.read.parquet(f"{SF}/lineitem.parquet"), "l_tax", by="l_returnflag"),
    "histograms": lambda s: charts.histograms(s.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_tax"]),
    "follow-ups": lambda s: findings.follow_ups(E.correlated(s, SF)),
    "correlation": lambda s: stats.correlation_matrix(E.messy_lineitem(s, SF)),
    "roles": lambda s: stats.column_roles(s.read.parquet(f"{SF}/orders.parquet")),
}


def passes_of(spark, make) -> list[str]:
    """The plans of every job that an operator runs, its own passes included:
    the eager actions go through these three methods."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, kept = [], {n: getattr(DataFrame, n) for n in ("collect", "count", "head")}

    def noted(f):
        def run(self, *args):
            plans.append(plan_of(self))
            return f(self, *args)

        return run

    try:
        for n, f in kept.items():
            setattr(DataFrame, n, noted(f))
        make(spark).collect()
    finally:
        for n, f in kept.items():
            setattr(DataFrame, n, f)
    return plans


@pytest.mark.parametrize("name", PASSES)
def test_no_cartesian_products_in_any_pass(spark, name):
    plans = passes_of(spark, PASSES[name])
    assert any("FileScan parquet" in p for p in plans)
    for p in plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "Expand" not in p


def test_sorted_and_shuffled_input_give_the_same_plan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_partkey", "l_returnflag")
    for make in (lambda d: charts.histograms(d, ["l_tax", "l_partkey"]), lambda d: charts.bar_counts(d, "l_returnflag")):
        first, second = (len(passes_of(spark, lambda s, o=o: make(df.orderBy(o)))) for o in ("l_tax", "l_partkey"))
        assert first == second


def test_duplicate_prefilter_shuffles_hashes_only(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    _, candidates = quality.duplicate_candidates(df)
    p = plan_of(candidates)
    exchange = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchange) == 1 and "_h" in exchange[0]
    assert "partial_count" in p
