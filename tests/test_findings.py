import pytest

import __spark_entry__ as E
from framescope.operators import findings, stats
from framescope.plans.chart_plan import chart_plan
from framescope.plans.profile import profile


def test_follow_ups_propose_correlated_pair(correlated_df):
    recs = findings.follow_ups(correlated_df).collect()
    assert 1 <= len(recs) <= 5
    assert recs[0]["chart_type"] == "scatter"
    assert {recs[0]["x_column"], recs[0]["y_column"]} == {"x", "y"}


def test_follow_ups_limit_and_fields(readings_df):
    recs = findings.follow_ups(readings_df).collect()
    assert len(recs) <= 5
    for r in recs:
        assert r["title"] and r["chart_request"]


def test_key_findings_fallback(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    rows = findings.key_findings(df).collect()
    assert [r["kind"] for r in rows] == ["none"]


def test_key_findings_grounded(correlated_df, bodies_df):
    rows = findings.key_findings(correlated_df).collect()
    assert rows[0]["text"].startswith("X is negatively correlated with y")
    tops = findings.key_findings(bodies_df).collect()
    assert tops[0]["kind"] == "top_value" and "most frequent value in 'side'" in tops[0]["text"]


def test_observations_cover_every_chart(correlated_df):
    plan = chart_plan(correlated_df)
    strong = stats.strong_correlations(correlated_df)
    obs = findings.chart_observations(plan, correlated_df.columns, strong, stats.iqr_outliers(correlated_df))
    assert {r["chart_id"] for r in obs.collect()} == {r["chart_id"] for r in plan.collect()}


def test_chart_columns_skip_axis_labels(bodies_df):
    plan = chart_plan(bodies_df)
    cols = {r["column"] for r in findings.chart_columns(plan, bodies_df.columns).collect()}
    assert "Frequency" not in cols and "Count" not in cols and "side" in cols


def test_end_to_end_profile(readings_df):
    prof = profile(readings_df)
    assert prof.quality.first()["duplicates"] == 7
    assert {r["chart_id"] for r in prof.observations.collect()} == set(prof.charts)
    assert prof.follow_ups.count() <= 5


def test_profile_minimal_dataset(tiny_df):
    prof = profile(tiny_df)
    assert prof.outliers.count() == 0
    assert prof.headline.first()["total_rows"] == 3


def test_entry_smoke(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_every_query_runs_at_smallest_scale(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 0


def test_profile_reports_schema(readings_df):
    prof = profile(readings_df, with_charts=False)
    rows = prof.schema.orderBy("position").collect()
    assert [r["column"] for r in rows] == readings_df.columns
    assert [r["class"] for r in rows] == ["datetime", "categorical", "numeric", "numeric", "categorical"]
