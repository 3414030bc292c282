"""Which standard charts apply to a table, with their metadata.

One aggregation gathers the facts the choice depends on (non-missing
count per column, distinct count per text column, complete date/value
pairs); the plan itself is then a small frame built from that single row
(its size is bounded by the limits 4/3/1/1/1). The aggregation can ride
along with other per-column facts (see the profile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonicalize, qcol
from ..functions.classes import classify

# How many charts of each kind, and their labels.
HIST_COLUMNS = 4
BAR_COLUMNS = 3
PIE_MIN_VALUES = 2
PIE_MAX_VALUES = 8
CHART_HISTOGRAM = "Histogram"
CHART_BAR = "Bar Chart"
CHART_PIE = "Pie Chart"
CHART_TREND = "Trend Line"
CHART_HEATMAP = "Correlation Heatmap"
AXIS_FREQUENCY = "Frequency"
AXIS_COUNT = "Count"

PLAN_SCHEMA = "chart_id int, chart_type string, x_axis string, y_axis string, column string"


PIE_PROBE = PIE_MAX_VALUES + 1


def plan_aggs(df: DataFrame) -> list:
    """Aggregate expressions the plan depends on (canonical frame):
    non-missing count per column and the complete (first date, numeric)
    pairs per numeric column. (How many distinct values a text column has
    only matters up to 9; see :func:`distinct_up_to`.)"""
    cls = classify(df)
    aggs = [F.count(qcol(c)).alias(f"cp_n{i}") for i, c in enumerate(df.columns)]
    if cls.datetime:
        d = qcol(cls.datetime[0])
        aggs += [F.count_if(d.isNotNull() & qcol(c).isNotNull()).alias(f"cp_p{i}")
                 for i, c in enumerate(cls.numeric)]
    return aggs


def distinct_up_to(top: DataFrame) -> dict[str, int]:
    """Distinct values per text column, exact up to 8 and 9 meaning "more",
    read off a per-column top-9 value frame (``column, value, count,
    rank``): a column with at most 8 rows there has exactly that many
    values."""
    out: dict[str, int] = {}
    for r in top.groupBy("column").count().collect():
        out[r["column"]] = r["count"]
    return out


def plan_rows_from(df: DataFrame, row, distinct: dict[str, int]) -> list[tuple]:
    """The plan as Python rows (bounded by the chart limits)."""
    cls = classify(df)
    cats = cls.categorical
    pos = {c: i for i, c in enumerate(df.columns)}
    numeric = [c for c in cls.numeric if row[f"cp_n{pos[c]}"] > 0]
    cats_ne = [c for c in cats if row[f"cp_n{pos[c]}"] > 0]
    rows: list[tuple] = []
    for c in numeric[:HIST_COLUMNS]:
        rows.append((CHART_HISTOGRAM, c, AXIS_FREQUENCY, c))
    for c in cats_ne[:BAR_COLUMNS]:
        rows.append((CHART_BAR, AXIS_COUNT, c, c))
    for c in cats_ne:
        if PIE_MIN_VALUES <= distinct.get(c, 0) <= PIE_MAX_VALUES:
            rows.append((CHART_PIE, None, None, c))
            break
    if cls.datetime and numeric:
        d, v = cls.datetime[0], numeric[0]
        if row[f"cp_p{cls.numeric.index(v)}"] > 0:
            rows.append((CHART_TREND, d, v, None))
    if len(numeric) >= 2:
        rows.append((CHART_HEATMAP, None, None, None))
    return [(i + 1, *r) for i, r in enumerate(rows)]


def pie_candidates_up_to(df: DataFrame) -> dict[str, int]:
    """:func:`distinct_up_to` for the text columns that can still qualify
    for the pie (a sketched distinct count rules out columns with many
    values); the others count as "more than 8"."""
    from ..operators.charts import columns_with_few_values
    from ..operators.stats import top_values

    cats = classify(df).categorical
    few = columns_with_few_values(df, cats, PIE_MAX_VALUES)
    known = distinct_up_to(top_values(df, few, k=PIE_PROBE)) if few else {}
    return {c: known.get(c, 0) if c in few else PIE_PROBE for c in cats}


def plan_rows(df: DataFrame) -> list[tuple]:
    """The plan rows of a table: one facts aggregation plus the pie probe."""
    df = canonicalize(df)
    return plan_rows_from(df, df.agg(*plan_aggs(df)).first(), pie_candidates_up_to(df))


def plan_frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Plan rows as a small local frame (``PLAN_SCHEMA``)."""
    return df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)


def chart_plan(df: DataFrame) -> DataFrame:
    """``chart_id, chart_type, x_axis, y_axis, column`` for the automatic
    charts of this table."""
    return df.sparkSession.createDataFrame(plan_rows(df), PLAN_SCHEMA)
