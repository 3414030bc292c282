"""Derived findings (F1-F5): small frames over the profile frames.

Inputs are the strong-correlation frame (one row per column pair), the
outlier frame (one row per column), the top-value frame and the chart plan
(a handful of rows); all are bounded by the schema, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonicalize
from ..functions.classes import classify
from ..functions.text import fill
from ..plans.chart_plan import AXIS_COUNT, AXIS_FREQUENCY
from .stats import iqr_outliers, strong_correlations, top_values

# Finding limits and texts.
FINDING_CORRELATIONS = 3
FINDING_TOP_COLUMNS = 2
FOLLOW_UP_LIMIT = 5
FOLLOW_UP_SCATTERS = 2
FOLLOW_UP_OUTLIER_SHARE = 5
FOLLOW_UP_HEATMAP_COLUMNS = 3
OBSERVATION_CORRELATIONS = 2
NO_PATTERN = "No strong patterns were detected in the available numeric or categorical data."
NO_OBSERVATION = "Review the chart visually for notable patterns or clusters."
TOP_VALUE_TEXT = "'{}' is the most frequent value in '{}' ({} occurrences)."
HEADLINE_TEXT = ("The dataset contains {} records across {} columns. "
                 "{} notable relationship(s) were found between numeric fields, summarized below.")
OUTLIER_OBSERVATION_TEXT = "{} has {} outlier value(s) ({}% of records)."
SCATTER_TITLE, SCATTER_REQUEST = "{} vs {}", "scatter plot between {} and {}"
LINE_TITLE, LINE_REQUEST = "{} Trend Over Time", "line chart between {} and {}"
BAR_TITLE, BAR_REQUEST = "{} by {}", "bar chart comparing {} and {}"
BOX_TITLE, BOX_REQUEST = "{} Outlier Review", "boxplot for {}"
HEATMAP_TITLE, HEATMAP_REQUEST = "Full Correlation Overview", "correlation heatmap for all numeric columns"

FINDING_SCHEMA = "rank int, kind string, subject string, text string"


def schema_bounded(df: DataFrame) -> DataFrame:
    """Bring a frame whose size is bounded by the schema (one row per
    column, per column pair, per chart) back as a local relation, so the
    several findings that read it do not recompute it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def shared_inputs(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chart plan, strong correlations and outliers of a table with their
    per-column facts gathered in ONE scan: the plan's counts, the moments
    and the correlation
    centring facts. Then one pair-sum pass, the quantile passes and one
    outlier count."""
    from ..operators.quantile import exact_quantiles
    from ..session import run_concurrently
    from ..plans.chart_plan import pie_candidates_up_to, plan_aggs, plan_frame, plan_rows_from
    from .stats import column_facts_from_moments, moment_aggs, moments_from_row
    from .stats import pair_correlations, strong_from_pairs

    df = canonicalize(df)
    numeric = classify(df).numeric
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *plan_aggs(df), *moment_aggs(numeric)).first()
    mom = moments_from_row(df, numeric, row).collect()
    num = [r["column"] for r in mom if r["n"] > 0]

    def plan_branch():
        return plan_frame(df, plan_rows_from(df, row, pie_candidates_up_to(df)))

    def strong_branch():
        return schema_bounded(strong_from_pairs(
            pair_correlations(df, num, facts=column_facts_from_moments(numeric, row, row["__rows"]))))

    def outlier_branch():
        q = exact_quantiles(df, num, [0.25, 0.75]) if num else None
        return schema_bounded(iqr_outliers(df, num, quantiles=q))

    # independent branches: their jobs overlap
    plan, strong, outliers = run_concurrently(plan_branch, strong_branch, outlier_branch)
    return plan, strong, outliers


def sentence_case(c: Column) -> Column:
    """First character upper-case, the rest lower-case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def key_findings(df: DataFrame, strong: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """``rank, kind, subject, text`` - the 3 strongest correlations and
    the most frequent value of the first 2 text columns, else one
    "no pattern" row."""
    from ..session import run_concurrently

    df = canonicalize(df)
    strong, tops = run_concurrently(
        (lambda: strong) if strong is not None else (lambda: schema_bounded(strong_correlations(df))),
        (lambda: tops) if tops is not None else (lambda: schema_bounded(top_values(df))),
    )
    corr = strong.where(F.col("rank") <= FINDING_CORRELATIONS).select(
        F.col("rank").alias("rank"), F.lit("correlation").alias("kind"),
        F.concat_ws(", ", "column_a", "column_b").alias("subject"),
        F.concat(sentence_case(F.col("description")), F.lit(".")).alias("text"),
    )
    cats = classify(df).categorical
    order = F.create_map(*[x for i, c in enumerate(cats) for x in (F.lit(c), F.lit(i))]) if cats else None
    first = tops.where(F.col("rank") == 1)
    if order is not None:
        # one row per text column
        w = Window.orderBy(order[F.col("column")])
        first = first.withColumn("col_rank", F.row_number().over(w)).where(F.col("col_rank") <= FINDING_TOP_COLUMNS)
    else:
        first = first.withColumn("col_rank", F.lit(1)).where(F.lit(False))
    top = first.select(
        (F.lit(FINDING_CORRELATIONS) + F.col("col_rank")).cast("int").alias("rank"),
        F.lit("top_value").alias("kind"), F.col("column").alias("subject"),
        fill(TOP_VALUE_TEXT, F.col("value"), F.col("column"), F.col("count").cast("string")).alias("text"),
    )
    found = corr.unionByName(top)
    none = df.sparkSession.createDataFrame([(0, "none", None, NO_PATTERN)], FINDING_SCHEMA)
    has_any = found.agg(F.count(F.lit(1)) > 0).scalar()
    # at most five rows
    return found.unionByName(none.where(~has_any)).withColumn("rank", F.dense_rank().over(
        Window.orderBy("rank")).cast("int"))


def headline(df: DataFrame, strong: DataFrame | None = None, total_rows: int | None = None) -> DataFrame:
    """``total_rows, total_columns, strong_correlations, summary``
    (pass ``total_rows`` when already counted)."""
    from ..session import run_concurrently

    def count_strong():
        s = strong if strong is not None else strong_correlations(df)
        return s.count()

    k, rows = run_concurrently(count_strong, (lambda: total_rows) if total_rows is not None else df.count)
    spark = df.sparkSession
    return spark.createDataFrame(
        [(rows, len(df.columns), k)], "total_rows bigint, total_columns int, strong_correlations bigint"
    ).select(
        "*",
        fill(HEADLINE_TEXT, *[F.col(c).cast("string") for c in ("total_rows", "total_columns",
                                                               "strong_correlations")]).alias("summary"),
    )


def chart_columns(plan: DataFrame, columns: list[str]) -> DataFrame:
    """``chart_id, position, column`` - the real columns a chart uses
    (column, x, y; distinct; axis labels skipped unless real columns)."""
    real = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    cand = F.array(F.col("column"), F.col("x_axis"), F.col("y_axis"))
    keep = F.filter(
        F.array_distinct(F.array_compact(cand)),
        lambda c: ~c.isin(AXIS_FREQUENCY, AXIS_COUNT) | F.array_contains(real, c),
    )
    return plan.select("chart_id", F.posexplode(keep).alias("position", "column"))


def chart_observations(
    plan: DataFrame, columns: list[str], strong: DataFrame, outliers: DataFrame
) -> DataFrame:
    """``chart_id, rank, text`` - for each chart, the top-2 strong
    correlations (overall) touching one of its columns, then the outlier
    counts of its columns; one "review visually" row when nothing applies."""
    strong, outliers = schema_bounded(strong), schema_bounded(outliers)
    cols = chart_columns(plan, columns)
    top2 = strong.where(F.col("rank") <= OBSERVATION_CORRELATIONS)
    # Two equi-joins (chart column = either side of the pair), then one row
    # per (chart, correlation); top2 has at most 2 rows.
    touching = cols.join(F.broadcast(top2.withColumnRenamed("column_a", "column")), "column").unionByName(
        cols.join(F.broadcast(top2.withColumnRenamed("column_b", "column")), "column"),
        allowMissingColumns=True,
    )
    corr = touching.select(
        "chart_id", F.col("rank").alias("order"),
        F.concat(sentence_case(F.col("description")), F.lit(".")).alias("text"),
    ).distinct()
    out = cols.join(F.broadcast(outliers), "column").select(
        "chart_id", (F.lit(100) + F.col("position")).alias("order"),
        fill(OUTLIER_OBSERVATION_TEXT, F.col("column"), F.col("count").cast("string"),
             F.col("percentage").cast("string")).alias("text"),
    )
    found = corr.unionByName(out)
    fallback = plan.select("chart_id").join(found.select("chart_id").distinct(), "chart_id", "left_anti").select(
        "chart_id", F.lit(0).alias("order"), F.lit(NO_OBSERVATION).alias("text"))
    allrows = found.unionByName(fallback)
    w = Window.partitionBy("chart_id").orderBy("order")
    return allrows.select("chart_id", F.row_number().over(w).alias("rank"), "text")


def follow_ups(
    df: DataFrame,
    plan: DataFrame | None = None,
    strong: DataFrame | None = None,
    outliers: DataFrame | None = None,
) -> DataFrame:
    """up to 5 follow-up charts in rule order:

    1. scatter for each of the top-2 strong pairs;
    2. line: first date column x first numeric column not yet charted;
    3. bar: the first not-yet-charted text column x first numeric column;
    4. box: first column whose outlier share is at least 5 %;
    5. heatmap with 3 or more numeric columns.
    """
    df = canonicalize(df)
    spark = df.sparkSession
    cls = classify(df)
    if plan is None or strong is None or outliers is None:
        plan, strong, outliers = shared_inputs(df)
    charted = plan.select(F.explode(F.array_compact(F.array("column", "x_axis", "y_axis"))).alias("name")).distinct()

    def listed(names: list[str]) -> DataFrame:
        return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")

    r1 = strong.where(F.col("rank") <= FOLLOW_UP_SCATTERS).select(
        F.lit(1).alias("rule"), F.col("rank").alias("sub"), F.lit("scatter").alias("chart_type"),
        F.col("column_a").alias("x_column"), F.col("column_b").alias("y_column"),
        F.lit(None).cast("string").alias("column"),
        fill(SCATTER_TITLE, F.col("column_a"), F.col("column_b")).alias("title"),
        fill(SCATTER_REQUEST, F.col("column_a"), F.col("column_b")).alias("chart_request"),
    )
    parts = [r1]
    if cls.datetime and cls.numeric:
        d = cls.datetime[0]
        first = listed(cls.numeric).join(charted, "name", "left_anti").orderBy("pos").limit(1)
        parts.append(first.select(
            F.lit(2).alias("rule"), F.lit(1).alias("sub"), F.lit("line").alias("chart_type"),
            F.lit(d).alias("x_column"), F.col("name").alias("y_column"), F.lit(None).cast("string").alias("column"),
            fill(LINE_TITLE, F.col("name")).alias("title"),
            fill(LINE_REQUEST, F.lit(d), F.col("name")).alias("chart_request"),
        ))
    if cls.categorical and cls.numeric:
        v = cls.numeric[0]
        first = listed(cls.categorical).join(charted, "name", "left_anti").orderBy("pos").limit(1)
        parts.append(first.select(
            F.lit(3).alias("rule"), F.lit(1).alias("sub"), F.lit("bar").alias("chart_type"),
            F.col("name").alias("x_column"), F.lit(v).alias("y_column"), F.lit(None).cast("string").alias("column"),
            fill(BAR_TITLE, F.lit(v), F.col("name")).alias("title"),
            fill(BAR_REQUEST, F.col("name"), F.lit(v)).alias("chart_request"),
        ))
    if cls.numeric:
        pos = listed(cls.numeric).withColumnRenamed("name", "column")
        heavy = outliers.where(F.col("percentage") >= FOLLOW_UP_OUTLIER_SHARE).join(pos, "column")
        parts.append(heavy.orderBy("pos").limit(1).select(
            F.lit(4).alias("rule"), F.lit(1).alias("sub"), F.lit("box").alias("chart_type"),
            F.lit(None).cast("string").alias("x_column"), F.lit(None).cast("string").alias("y_column"),
            F.col("column"), fill(BOX_TITLE, F.col("column")).alias("title"),
            fill(BOX_REQUEST, F.col("column")).alias("chart_request"),
        ))
    if len(cls.numeric) >= FOLLOW_UP_HEATMAP_COLUMNS:
        parts.append(spark.createDataFrame(
            [(5, 1, "heatmap", None, None, None, HEATMAP_TITLE, HEATMAP_REQUEST)],
            "rule int, sub int, chart_type string, x_column string, y_column string, column string, "
            "title string, chart_request string",
        ))
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    top = allrows.orderBy("rule", "sub").limit(FOLLOW_UP_LIMIT)
    # the rank window sees the five kept rows only
    w = Window.orderBy("rule", "sub")
    return top.select(F.row_number().over(w).alias("rank"), "rule", "chart_type", "x_column", "y_column",
                      "column", "title", "chart_request")
