"""Chart data (C1-C11, P4, P5): the aggregates behind each chart.

Drawing is not done here; each function returns the frame a plotting
library would draw. Bin edges, box statistics and shares follow the
conventions of the usual plotting stack (numpy histogram, matplotlib box
statistics), so the numbers are the ones those charts would show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonicalize, qcol
from ..session import written
from .quantile import GROUP_ROWS, grouped_quantiles, quantiles
from .sample import hash_sample
from .stats import correlation_matrix, exact_distinct, top_values, value_counts

# Chart limits.
HIST_MIN_BINS = 5
HIST_MAX_BINS = 30
BAR_TOP = 10
BAR_MEAN_TOP = 15
PIE_TOP = 8
BOX_WHISKER = 1.5


#: A sketched distinct count this many times a limit is certainly above it.
CERTAINLY_MANY = 2


def finite(column: str) -> Column:
    """A column's finite values; infinities have no place on an axis and are
    left out of the bins."""
    v = qcol(column).cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def histograms(df: DataFrame, columns: Sequence[str], bins: int | None = None) -> DataFrame:
    """C1 for several columns at once: ``column, bin, lo, hi, count``.

    Equal-width bins from min to max; ``bins`` defaults to
    ``min(30, max(5, distinct values))``; the last bin is closed; a
    constant column spans value +/- 0.5. Bin placement repeats numpy's
    arithmetic (edge ``i`` = ``i * step + lo``, index estimate then one-step
    correction against the edges), so counts equal ``numpy.histogram``.

    Two jobs for any number of columns: one aggregation for every range and
    distinct count (four numbers per column come back), one pass that bins
    all columns together (partially aggregated; output at most 30 rows per
    column). Empty bins come from the known bin frame.
    """
    df = canonicalize(df)
    cols = list(columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    vals = {c: finite(c) for c in cols}
    # The bin count needs the exact number of distinct values only below 30:
    # the sketch in the range scan tells which columns certainly have more.
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(vals[c]).alias(f"mn{i}"), F.max(vals[c]).alias(f"mx{i}"), F.count(vals[c]).alias(f"n{i}"),
                 F.approx_count_distinct(vals[c]).alias(f"a{i}")]
    row = df.agg(*aggs).first()
    few = [c for i, c in enumerate(cols) if bins is None and row[f"a{i}"] < CERTAINLY_MANY * HIST_MAX_BINS]
    distinct = exact_distinct(df.select(*[vals[c].alias(c) for c in few]), few)
    spec = []  # (column index, lo, hi, nb)
    for i, c in enumerate(cols):
        if not row[f"n{i}"]:
            continue
        lo, hi = row[f"mn{i}"], row[f"mx{i}"]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        if bins is not None:
            nb = int(bins)
        else:
            nb = min(HIST_MAX_BINS, max(HIST_MIN_BINS, distinct.get(c, HIST_MAX_BINS)))
        spec.append((i, lo, hi, nb))
    frame_rows = []
    for i, lo, hi, nb in spec:
        step = (hi - lo) / nb
        for k in range(nb):
            frame_rows.append((i, cols[i], k, k * step + lo, hi if k + 1 == nb else (k + 1) * step + lo))
    frame = df.sparkSession.createDataFrame(
        frame_rows, "cid int, column string, bin int, lo double, hi double")
    if not spec:
        return frame.select("column", "bin", "lo", "hi", F.lit(0).cast("long").alias("count"))
    binned_cols = []
    for i, lo, hi, nb in spec:
        v = vals[cols[i]]
        step = (hi - lo) / nb

        def edge(k: Column, lo=lo, hi=hi, nb=nb, step=step) -> Column:
            return F.when(k == nb, F.lit(hi)).otherwise(k * F.lit(step) + F.lit(lo))

        est = F.least(((v - F.lit(lo)) * F.lit(nb / (hi - lo))).cast("int"), F.lit(nb - 1))
        binned = (
            F.when(v < edge(est), est - 1)
            .when((est != nb - 1) & (v >= edge(est + 1)), est + 1)
            .otherwise(est)
        )
        binned_cols.append((i, binned.alias(f"_b{i}")))
    # bins first as plain projected columns (code generated, shared
    # sub-expressions), then one small (column, bin) row per value
    projected = df.select(*[b for _, b in binned_cols])
    items = [F.when(F.col(f"_b{i}").isNotNull(), F.struct(F.lit(i).alias("cid"), F.col(f"_b{i}").alias("bin")))
             for i, _ in binned_cols]
    counts = (
        projected.select(F.inline(F.array(*items))).where(F.col("cid").isNotNull())
        .groupBy("cid", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    # ``frame`` has at most 30 rows per column (or the requested bins).
    return F.broadcast(frame).join(counts, ["cid", "bin"], "left").select(
        "column", F.col("bin").cast("int").alias("bin"), "lo", "hi",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """``bin, lo, hi, count`` for one column (see :func:`histograms`)."""
    return histograms(df, [column], bins).drop("column")


def bar_counts(df: DataFrame, column: str, k: int = BAR_TOP) -> DataFrame:
    """``value, count, rank`` for the k most frequent values."""
    return value_counts(df, column, k)


def bar_mean_by_category(df: DataFrame, x: str, y: str, k: int = BAR_MEAN_TOP, decimals: int | None = 4) -> DataFrame:
    """Mean of ``y`` per ``x`` value (missing keys dropped), the ``k``
    highest: ``x, mean_y, rank``. A group whose ``y`` is all missing has no
    mean and sorts last."""
    df = canonicalize(df)
    g = df.where(qcol(x).isNotNull()).groupBy(qcol(x).alias("_x")).agg(F.avg(qcol(y)).alias("_m"))
    order = [F.col("_m").desc_nulls_last(), F.col("_x").asc()]
    top = g.orderBy(*order).limit(k)
    # a window over the k kept rows only
    w = Window.orderBy(*order)
    m = F.round("_m", decimals) if decimals is not None else F.col("_m")
    return top.select(F.col("_x").alias(x), m.alias("mean_y"), F.row_number().over(w).alias("rank"))


def pie_shares(df: DataFrame, column: str, k: int = PIE_TOP) -> DataFrame:
    """C4: ``value, count, share, rank``; share (1 decimal, percent) is over
    the kept slices only (the automatic pie only picks columns with at most
    8 values, so ``k=8`` keeps all of them)."""
    vc = value_counts(df, column, k)
    total = vc.agg(F.sum("count")).scalar()
    return vc.select("value", "count", F.round(F.col("count") * 100.0 / total, 1).alias("share"), "rank")


def columns_with_few_values(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """The columns that may hold at most ``limit`` distinct values: those
    whose sketched number (one aggregation) is not certainly above it."""
    if not columns:
        return []
    row = canonicalize(df).agg(*[F.approx_count_distinct(qcol(c)).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] <= CERTAINLY_MANY * limit + 2]


def auto_pie_column(df: DataFrame, categorical: Sequence[str]) -> str | None:
    """First text column with 2..8 distinct values. Read off a per-column
    top-9 of the values (exact up to 8, "more" at 9), so no column's
    distinct values are counted in full."""
    if not categorical:
        return None
    few = columns_with_few_values(df, categorical, PIE_TOP)
    if not few:
        return None
    top9 = top_values(df, few, k=PIE_TOP + 1)
    seen = {r["column"]: r["count"] for r in top9.groupBy("column").count().collect()}
    for c in categorical:
        if 2 <= seen.get(c, 0) <= PIE_TOP:
            return c
    return None


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y`` complete cases."""
    df = canonicalize(df)
    return df.select(qcol(x), qcol(y)).where(qcol(x).isNotNull() & qcol(y).isNotNull())


def line_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) pairs sorted by x (a range-partitioned
    sort; no single-task ordering)."""
    return pairs(df, x, y).orderBy(qcol(x))


trend_series = line_series
area_series = line_series


def scatter_pairs(df: DataFrame, x: str, y: str, sample_rows: int | None = None, sample_fraction: float | None = None,
                  key: Sequence[str] | None = None) -> DataFrame:
    """(x, y) as they are (missing values kept, as the scatter
    call receives them). For display of a large table, ``sample_rows`` or
    ``sample_fraction`` takes a repeatable sample by the hash of ``key``
    (columns that identify a row; default x and y)."""
    df = canonicalize(df)
    if sample_rows is not None or sample_fraction is not None:
        df = hash_sample(df, key or [x, y], sample_rows, sample_fraction)
    return df.select(qcol(x), qcol(y))


def _beside_quartiles(base: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Each row beside the quartiles of its group ``_k``. The quartiles of
    groups above ``GROUP_ROWS`` rows are broadcast (there is at most one such
    group for so many rows): a shuffle by key would bring all rows of a group
    into one task's sort. Only the rows of smaller groups are dealt by key."""
    quartiles = written(quartiles, "quartiles")
    sizes = quartiles.agg(F.count_if(F.col("_rows") > GROUP_ROWS).alias("large"), F.count(F.lit(1)).alias("all")).first()
    large = F.broadcast(quartiles.where(F.col("_rows") > GROUP_ROWS).drop("_rows"))
    small = quartiles.where(F.col("_rows") <= GROUP_ROWS).drop("_rows")
    same = F.col("_g0") == F.col("_k")
    if sizes["large"] == 0:
        return base.join(small, same)
    if sizes["large"] == sizes["all"]:
        return base.join(large, same)
    return base.join(large, same).unionByName(base.join(large, same, "left_anti").join(small, same))


def box_summary(df: DataFrame, column: str, by: str | None = None, decimals: int | None = 4,
                exact: bool = True) -> DataFrame:
    """``[by], n, q1, median, q3, whisker_lo, whisker_hi, fliers``.

    Whiskers sit at the furthest values within 1.5 IQR of the box (never
    inside the box); fliers are values beyond the whiskers, which are
    exactly the values beyond the 1.5 IQR fences. Pass 1 is the exact
    quartile job (per group when ``by`` is set); pass 2 is ONE aggregation:
    without groups the three quartiles are collected and used as literals,
    with groups they meet the rows by group key (:func:`_beside_quartiles`).
    """
    df = canonicalize(df)
    probs = [0.25, 0.5, 0.75]
    # internal names carry no names of the table
    base = df.select(*([qcol(by).alias("_g0")] if by else []), qcol(column).cast("double").alias("_v"))
    base = base.where(F.col("_v").isNotNull())
    v = F.col("_v")
    if by:
        base = base.where(F.col("_g0").isNotNull())
        if exact:
            qw = grouped_quantiles(base, ["_v"], probs, ["_g0"]).select(
                F.col("_g0").alias("_k"), F.col("_n0").alias("_rows"),
                *[F.col(f"_q0_{j}").alias(n) for j, n in enumerate(("_a", "_m", "_z"))])
        else:
            qw = base.groupBy(F.col("_g0").alias("_k")).agg(
                F.count("_v").alias("_rows"), F.percentile_approx("_v", probs).alias("_q")).select(
                "_k", "_rows", *[F.col("_q")[j].alias(n) for j, n in enumerate(("_a", "_m", "_z"))])
        joined = _beside_quartiles(base, qw)
        keys = ["_g0", "_a", "_m", "_z"]
    else:
        # three values: read them and use them as literals
        q = {r["p"]: r["value"] for r in quantiles(base, ["_v"], probs, exact=exact).collect()}
        if not q:
            return df.sparkSession.createDataFrame(
                [], "n bigint, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, "
                    "fliers bigint")
        joined = base.select("_v", *[F.lit(q[p]).alias(n) for p, n in zip(probs, ("_a", "_m", "_z"))])
        keys = ["_a", "_m", "_z"]
    iqr = F.col("_z") - F.col("_a")
    lov, hiv = F.col("_a") - BOX_WHISKER * iqr, F.col("_z") + BOX_WHISKER * iqr
    agg = joined.groupBy(*keys).agg(
        F.count(v).alias("_n"),
        F.max(F.when(v <= hiv, v)).alias("_hi"),
        F.min(F.when(v >= lov, v)).alias("_lo"),
        F.count_if((v < lov) | (v > hiv)).alias("_f"),
    )
    wl = F.when(F.col("_lo").isNull() | (F.col("_lo") > F.col("_a")), F.col("_a")).otherwise(F.col("_lo"))
    wh = F.when(F.col("_hi").isNull() | (F.col("_hi") < F.col("_z")), F.col("_z")).otherwise(F.col("_hi"))
    r = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    return agg.select(
        *([F.col("_g0").alias(by)] if by else []), F.col("_n").alias("n"),
        r(F.col("_a")).alias("q1"), r(F.col("_m")).alias("median"), r(F.col("_z")).alias("q3"),
        r(wl).alias("whisker_lo"), r(wh).alias("whisker_hi"), F.col("_f").alias("fliers"),
    )


def heatmap(df: DataFrame, decimals: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """C11: the correlation matrix, unrounded by default. The automatic
    heatmap uses the non-empty numeric columns; pass ``columns`` to keep
    others (the on-request heatmap keeps every numeric column)."""
    return correlation_matrix(df, decimals=decimals, columns=columns)
