"""Question operators (K1-K13, P8): the common question shapes as
parameterised queries. Callers name the columns; no text is parsed.

Every answer is a DataFrame. Group answers partially aggregate before the
shuffle (a hot group is combined map-side); top-1 / top-N answers are
global top-k sorts that keep k rows per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonicalize, qcol
from .frequent import is_text, top_counts
from .quantile import grouped_quantiles

# Result caps.
TABLE_ROWS = 20
RESULT_ROWS = 200
DECIMALS = 4


def total(df: DataFrame, value: str) -> Column:
    """Sum of a column, 0 without values. Integers are summed as
    ``decimal(38,0)``, so no table overflows the total."""
    t = df.schema[value].dataType
    c = qcol(value)
    if isinstance(t, T.IntegralType):
        c, kind = c.cast("decimal(28,0)"), "decimal(38,0)"
    elif isinstance(t, T.DecimalType):
        kind = f"decimal({min(38, t.precision + 10)},{t.scale})"
    else:
        kind = "double"
    return F.coalesce(F.sum(c), F.lit(0).cast(kind))


def _totals(df: DataFrame, group: Column, value: str) -> DataFrame:
    """``_g, _t``: total of a column per group that is not null."""
    df = canonicalize(df)
    return df.where(group.isNotNull()).groupBy(group.alias("_g")).agg(total(df, value).alias("_t"))


def sum_by_group(df: DataFrame, group: str, value: str, limit: int | None = TABLE_ROWS) -> DataFrame:
    """K1: ``[group, value]`` = total of ``value`` per group (an all-missing
    group totals 0), ordered by the group key, first ``limit`` rows."""
    out = _totals(df, qcol(group), value).orderBy("_g")
    out = out.limit(limit) if limit is not None else out
    return out.select(F.col("_g").alias(group), F.col("_t").alias(value))


def count_by_group(df: DataFrame, group: str, limit: int = TABLE_ROWS) -> DataFrame:
    """K2 / K9: ``[group, count]``, most frequent first (ties: key asc)."""
    if is_text(df, group):
        return top_counts(df, [group], limit).orderBy("_rank").select(F.col("_v").alias(group), F.col("_n").alias("count"))
    counts = canonicalize(df).where(qcol(group).isNotNull()).groupBy(qcol(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), F.col("_g").asc()).limit(limit).select(
        F.col("_g").alias(group), F.col("_n").alias("count"))


top_n_values = count_by_group


def argmax_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """K3: the group with the highest total ``value`` (ties: smallest key):
    ``[group, total]``."""
    return _totals(df, qcol(group), value).orderBy(F.col("_t").desc(), F.col("_g").asc()).limit(1).select(
        F.col("_g").alias(group), F.col("_t").alias("total"))


def _scalar(df: DataFrame, expr: Column) -> DataFrame:
    return canonicalize(df).agg(expr.alias("value"))


def avg_col(df: DataFrame, column: str) -> DataFrame:
    """K4: mean of a column (missing skipped)."""
    return _scalar(df, F.avg(qcol(column)))


def max_col(df: DataFrame, column: str) -> DataFrame:
    """K5."""
    return _scalar(df, F.max(qcol(column)))


def min_col(df: DataFrame, column: str) -> DataFrame:
    """K6."""
    return _scalar(df, F.min(qcol(column)))


def row_count(df: DataFrame) -> DataFrame:
    """K7: number of rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows where ``column > threshold`` (missing never counts)."""
    return _scalar(df, F.count_if(qcol(column) > F.lit(threshold))).withColumnRenamed("value", "count")


def rows_above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """P8 as a filter: the rows themselves.

    The comparison is applied to the raw column so it reaches the Parquet
    scan as a pushed filter (row groups skipped by their statistics); NaN,
    which Spark orders above every number, is excluded explicitly since it
    counts as missing."""
    c = qcol(column)
    cond = c > F.lit(threshold)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        cond = cond & ~F.isnan(c)
    return canonicalize(df.where(cond))


def best_month(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """Calendar month (``yyyy-MM``) with the highest total ``value``:
    ``month, total``."""
    month = F.date_format(qcol(date_col), "yyyy-MM")
    return _totals(df, month, value).orderBy(F.col("_t").desc(), F.col("_g").asc()).limit(1).select(
        F.col("_g").alias("month"), F.col("_t").alias("total"))


_AGGS = {
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
    "nunique": lambda c: F.count_distinct(c),
}


def group_agg(df: DataFrame, keys: Sequence[str], value: str, agg: str = "sum") -> DataFrame:
    """``[*keys, value]`` aggregated per key combination (missing keys
    dropped). ``agg`` in sum, mean, min, max, count, median, nunique; the
    median is the exact distributed quantile job."""
    df = canonicalize(df)
    keys = list(keys)
    kept = df
    for k in keys:
        kept = kept.where(qcol(k).isNotNull())
    names = [f"_g{i}" for i in range(len(keys))]
    own = [F.col(n).alias(k) for n, k in zip(names, keys)]
    groups = kept.groupBy(*[qcol(k).alias(n) for k, n in zip(keys, names)])
    if agg == "median":
        q = grouped_quantiles(kept, [value], [0.5], keys)
        present = groups.agg(F.count(F.lit(1)).alias("_n"))
        return present.join(q, names, "left").select(*own, F.col("_q0_0").alias(value))
    if agg != "sum" and agg not in _AGGS:
        raise ValueError(f"Unsupported aggregation: '{agg}'.")
    expr = total(df, value) if agg == "sum" else _AGGS[agg](qcol(value))
    return groups.agg(expr.alias("_a")).select(*own, F.col("_a").alias(value))


def capped(df: DataFrame, order_by: Sequence[str], cap: int = RESULT_ROWS) -> DataFrame:
    """The first ``cap`` rows by ``order_by`` plus ``truncated`` (true
    when more rows exist): ``cap + 1`` rows are taken once and counted."""
    order = [qcol(c) for c in order_by]
    row = F.struct(*[qcol(c).alias(c) for c in df.columns]).alias("_r")
    taken = df.orderBy(*order).limit(cap + 1).select(row, F.row_number().over(Window.orderBy(*order)).alias("_i"))
    # both windows see the cap + 1 rows only
    more = F.count(F.lit(1)).over(Window.partitionBy()) > cap
    return taken.select("_r", "_i", more.alias("_m")).where(F.col("_i") <= cap).select(
        *[F.col("_r").getField(c).alias(c) for c in df.columns], F.col("_m").alias("truncated"))


def shape_result(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Values as the answer shows them: floats rounded, dates and
    timestamps as ``yyyy-MM-dd``, NaN as missing, everything else kept."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.round(F.when(~F.isnan(c), c), decimals).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(F.round(c.cast("double"), decimals).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
