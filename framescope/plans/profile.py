"""Profile a table end to end.

``profile(df)`` returns named frames: quality, statistics, chart data,
observations, follow-ups and findings, all computed on the raw (canonical)
frame. Every heavy fact is computed once and shared: one scan gives the
missing counts, the numeric-looking text counts, the moments and the
correlation centring facts; one quantile job feeds the description and the
outliers; one pair-correlation aggregation feeds the matrix, the heatmap
and the strong pairs. Those
shared facts are small (bounded by the schema) and kept as local
relations; the chart frames stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonicalize
from ..functions.classes import classify, schema_frame, shape_frame
from ..operators import charts, findings, quality, stats
from ..operators.quantile import exact_quantiles
from ..session import run_concurrently
from .chart_plan import PIE_PROBE, distinct_up_to, plan_aggs, plan_frame, plan_rows_from


@dataclass
class Profile:
    shape: DataFrame
    schema: DataFrame
    quality: DataFrame
    issues: DataFrame
    missing: DataFrame
    describe: DataFrame
    correlations: DataFrame
    strong: DataFrame
    top_values: DataFrame
    outliers: DataFrame
    chart_plan: DataFrame
    charts: dict[int, DataFrame] = field(default_factory=dict)
    observations: DataFrame | None = None
    follow_ups: DataFrame | None = None
    findings: DataFrame | None = None
    headline: DataFrame | None = None

    def report(self) -> DataFrame:
        """Long view ``section, column, metric, value`` of the numeric facts
        (descriptive statistics, missing counts, outliers)."""
        return profile_report_from(self.describe, self.missing, self.outliers)


def profile_report_from(describe: DataFrame, missing: DataFrame, outliers: DataFrame) -> DataFrame:
    d = describe.select("column", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in ("n", "mean", "median", "std", "min", "max")
    ]))).select(F.lit("describe").alias("section"), "column", "metric", "value")
    m = missing.select(F.lit("missing").alias("section"), "column", F.lit("missing").alias("metric"),
                       F.col("missing").cast("double").alias("value"))
    o = outliers.select("column", F.inline(F.array(
        F.struct(F.lit("count").alias("metric"), F.col("count").cast("double").alias("value")),
        F.struct(F.lit("percentage").alias("metric"), F.col("percentage").cast("double").alias("value")),
    ))).select(F.lit("outliers").alias("section"), "column", "metric", "value")
    return d.unionByName(m).unionByName(o)


def profile(df: DataFrame, with_charts: bool = True) -> Profile:
    """Every profile frame of ``df``. Shared facts are computed once
    (eagerly, as small local relations); chart frames and findings stay
    lazy frames over them. ``with_charts=False`` skips the chart frames."""
    df = canonicalize(df)
    small = findings.schema_bounded
    numeric = classify(df).numeric
    # ONE scan for every per-column fact: missing counts, numeric-looking
    # text, moments (which also give the correlation centring facts) and
    # the chart plan's counts.
    row = df.agg(*quality.quality_fact_aggs(df), *stats.moment_aggs(numeric), *plan_aggs(df)).first()
    facts = quality.quality_facts_from_row(df, row)
    missing = facts[0]
    mom = stats.moments_from_row(df, numeric, row)
    mom_rows = mom.collect()
    num = [r["column"] for r in sorted(mom_rows, key=lambda r: r["position"]) if r["n"] > 0]

    # Four independent branches, submitted together (their jobs overlap):
    def quantile_branch():
        q = exact_quantiles(df, num, [0.25, 0.5, 0.75]) if num else None
        return q, small(stats.iqr_outliers(df, num, quantiles=q))

    def correlation_branch():
        pairs = stats.pair_correlations(
            df, num, facts=stats.column_facts_from_moments(numeric, row, row["__total"]))
        return pairs, small(stats.strong_from_pairs(pairs))

    def values_branch():
        # one top-9 job: the top-5 values and the pie rule's "2 to 8
        # distinct values" test; then the histograms the plan asks for
        top9 = small(stats.top_values(df, k=PIE_PROBE))
        rows = plan_rows_from(df, row, distinct_up_to(top9))
        hist_cols = [r[4] for r in rows if r[1] == "Histogram"] if with_charts else []
        hists = small(charts.histograms(df, hist_cols)) if hist_cols else None
        return top9, rows, hists

    def quality_branch():
        return small(quality.quality_report(df, facts))

    (q, outliers), (pairs, strong), (top9, rows, hists), report = run_concurrently(
        quantile_branch, correlation_branch, values_branch, quality_branch)
    describe = stats.describe(df, quantiles=q, moment_frame=mom) if num else stats.describe(df)
    tops = top9.where(F.col("rank") <= stats.TOP_VALUES_PROFILE)
    plan = plan_frame(df, rows)
    prof = Profile(
        shape=shape_frame(df),
        schema=schema_frame(df.sparkSession, df),
        quality=report,
        issues=quality.quality_issues(df, report),
        missing=missing,
        describe=describe,
        correlations=stats.matrix_from_pairs(pairs, 3),
        strong=strong,
        top_values=tops,
        outliers=outliers,
        chart_plan=plan,
    )
    if with_charts:
        for chart in plan.collect():  # at most 10 chart rows
            t = chart["chart_type"]
            if t == "Histogram":
                prof.charts[chart["chart_id"]] = hists.where(F.col("column") == chart["column"]).drop("column")
            elif t == "Bar Chart":
                prof.charts[chart["chart_id"]] = charts.bar_counts(df, chart["column"])
            elif t == "Pie Chart":
                prof.charts[chart["chart_id"]] = charts.pie_shares(df, chart["column"])
            elif t == "Trend Line":
                prof.charts[chart["chart_id"]] = charts.trend_series(df, chart["x_axis"], chart["y_axis"])
            else:
                prof.charts[chart["chart_id"]] = stats.matrix_from_pairs(pairs, None)
    prof.observations = findings.chart_observations(plan, df.columns, strong, outliers)
    prof.follow_ups = findings.follow_ups(df, plan, strong, outliers)
    prof.findings = findings.key_findings(df, strong, tops)
    prof.headline = findings.headline(df, strong, total_rows=row["__total"])
    return prof
