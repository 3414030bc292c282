"""Statistical operators.

Layout of the work:

* column-wise moments (count, mean, std, min, max) for every numeric
  column come from ONE wide aggregation;
* exact quantiles (median, quartiles) come from the distributed selection
  job in :mod:`.quantile` (bounded state per task);
* correlations are pairwise-complete Pearson coefficients from sums of
  centred columns, many pairs per aggregation; from ``WIDE_COLUMNS`` columns
  on, from Gram matrices of blocks of columns (:mod:`.gram`);
* the most frequent values are counted by short keys, only candidates of a
  frequent-items sketch where it can prove them (:mod:`.frequent`), with a
  top-k that Spark pre-limits on the map side (WindowGroupLimit).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonicalize, qcol
from ..functions.classes import classify
from ..functions.text import fill, fixed2
from ..session import written
from . import gram
from .frequent import is_text, top_counts
from .quantile import exact_quantiles, quantiles as _quantiles

# Fixed values used by the reference semantics.
STRONG_CORRELATION = 0.6
CORRELATION_TEXT = "{} is {} correlated with {} ({})"
DIRECTION_POSITIVE = "positively"
DIRECTION_NEGATIVE = "negatively"
ROLE_NUMERIC_TEXT = "A numeric measure ranging from {} to {}."
ROLE_DATETIME_TEXT = "A date/time field used to track values over time."
ROLE_CATEGORICAL_TEXT = "A categorical field with {} distinct value(s)."
OUTLIER_WHISKER = 1.5
OUTLIER_MIN_VALUES = 4
TOP_VALUES_PROFILE = 5
PAIRS_PER_AGGREGATION = 500
#: From here on pairs come from blocks of columns; the results are the same.
WIDE_COLUMNS = 64
#: Up to here pairs are written where one reader may come; more are computed as
#: they are read.
PAIRS_WRITTEN = 20_000_000
#: More than rounding to three decimals can add to |r|.
ROUNDING = 0.001
#: Spread below this share of the mean square is rounding: the column is
#: constant on the pair's rows.
CONSTANT = 1e-12


def _long_from_wide(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*structs)))


def moment_aggs(cols: Sequence[str]) -> list[Column]:
    """Aggregate expressions behind :func:`moments` (canonical frame)."""
    aggs = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        aggs += [
            F.count(v).alias(f"mo_n{i}"), F.avg(v).alias(f"mo_m{i}"), F.stddev_samp(v).alias(f"mo_s{i}"),
            F.min(v).alias(f"mo_lo{i}"), F.max(v).alias(f"mo_hi{i}"),
        ]
    return aggs


def moments_from_row(df: DataFrame, cols: Sequence[str], row) -> DataFrame:
    """The moments frame built from an aggregation row holding
    :func:`moment_aggs`."""
    pos = {c: i for i, c in enumerate(df.columns)}
    rows = []
    for i, c in enumerate(cols):
        n = row[f"mo_n{i}"]
        rows.append((pos[c], c, n, row[f"mo_m{i}"], (row[f"mo_s{i}"] if n > 1 else 0.0),
                     row[f"mo_lo{i}"], row[f"mo_hi{i}"]))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, n bigint, mean double, std double, min double, max double")


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``position, column, n, mean, std, min, max`` (unrounded) for numeric
    columns from ONE wide aggregation, as a local relation (one row per
    column). ``std`` is the sample deviation, 0.0 for a single value."""
    df = canonicalize(df)
    cols = list(columns) if columns is not None else classify(df).numeric
    if not cols:
        return moments_from_row(df, [], None)
    return moments_from_row(df, cols, df.agg(*moment_aggs(cols)).first())


def describe(df: DataFrame, decimals: int = 4, quantiles: DataFrame | None = None,
             moment_frame: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """A1-A5: ``column, n, mean, median, std, min, max`` for every non-empty
    numeric column, rounded to ``decimals``. ``quantiles`` (column, p,
    value with p = 0.5) and ``moment_frame`` may be passed in when already
    computed."""
    df = canonicalize(df)
    num = classify(df).numeric
    if not num:
        return df.sparkSession.createDataFrame(
            [], "column string, n bigint, mean double, median double, std double, min double, max double"
        )
    if moment_frame is None:
        moment_frame = moments(df, num)
    mom = moment_frame.where(F.col("n") > 0)
    if quantiles is None:
        quantiles = (exact_quantiles(df, num, [0.5]) if exact
                     else _quantiles(df, num, [0.5], exact=False))
    q = quantiles
    med = q.where(F.col("p") == 0.5).select("column", F.col("value").alias("median"))
    r = lambda c: F.round(c, decimals)
    # ``med`` has one row per numeric column: bounded by the schema.
    return mom.join(F.broadcast(med), "column").select(
        "column", "n", r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"),
        r(F.col("std")).alias("std"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"),
    )


def _varies(low: Column, high: Column) -> Column:
    """More than one value, all finite."""
    return (high > low) & (F.abs(low) < F.lit(math.inf)) & (F.abs(high) < F.lit(math.inf))


def column_fact_aggs(cols: Sequence[str]) -> list[Column]:
    """Aggregate expressions behind :func:`_column_facts`."""
    return [
        F.count(F.lit(1)).alias("pf_n"),
        *[F.count(qcol(c)).alias(f"pf_c{i}") for i, c in enumerate(cols)],
        *[F.avg(qcol(c).cast("double")).alias(f"pf_m{i}") for i, c in enumerate(cols)],
        *[_varies(F.min(qcol(c).cast("double")), F.max(qcol(c).cast("double"))).alias(f"pf_v{i}")
          for i, c in enumerate(cols)],
    ]


def column_facts_from_row(cols: Sequence[str], row) -> tuple:
    """(rows, non-missing counts, means, varies) from :func:`column_fact_aggs`."""
    return (row["pf_n"], {c: row[f"pf_c{i}"] for i, c in enumerate(cols)},
            {c: row[f"pf_m{i}"] for i, c in enumerate(cols)},
            {c: bool(row[f"pf_v{i}"]) for i, c in enumerate(cols)})


def column_facts_from_moments(cols: Sequence[str], row, n_rows: int) -> tuple:
    """The correlation centring facts read off the moments aggregation
    (count, mean, min < max), so a fused scan need not repeat them."""
    return (n_rows, {c: row[f"mo_n{i}"] for i, c in enumerate(cols)},
            {c: row[f"mo_m{i}"] for i, c in enumerate(cols)},
            {c: row[f"mo_lo{i}"] is not None and -math.inf < row[f"mo_lo{i}"] < row[f"mo_hi{i}"] < math.inf for i, c in enumerate(cols)})


def _column_facts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int], dict[str, float], dict[str, bool]]:
    """Row count, non-missing count, mean and "varies" (min < max) per
    column: one small aggregation, one row of 3N+1 values back."""
    return column_facts_from_row(cols, df.agg(*column_fact_aggs(cols)).first())


def _pair_stats(df: DataFrame, pairs: list[tuple[str, str]], facts=None) -> tuple[DataFrame, dict[str, bool]]:
    """Pearson r for each pair over the rows where both values are present.

    Plain sums of shifted values (each column centred on its mean, so the
    sums do not cancel catastrophically): per column sum and sum of
    squares, per pair sum of products. Only pairs touching a column with
    missing values need their own masked sums. All of it is one
    aggregation of simple ``sum``s per chunk of pairs - cheap,
    code-generated, partially aggregated on every partition.
    """
    cols = sorted({c for p in pairs for c in p}, key=lambda c: df.columns.index(c))
    n_rows, nn, mean, varies = facts if facts is not None else _column_facts(df, cols)
    full = {c for c in cols if nn[c] == n_rows}
    idx = {c: i for i, c in enumerate(cols)}
    # centred copies of the columns, projected once; the aggregates below are
    # SQL expressions over them (one JVM call each, not one per operator)
    centred = df.select(*[
        (qcol(c).cast("double") - F.lit(float(mean[c]) if mean[c] is not None and math.isfinite(mean[c]) else 0.0)).alias(f"_x{idx[c]}")
        for c in cols
    ])

    def sq(name: str) -> str:
        return name.replace("'", "\\'")

    parts = []
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATION):
        chunk = pairs[start:start + PAIRS_PER_AGGREGATION]
        aggs: dict[str, str] = {"n_all": "count(1)"}
        items = []
        for i, (a, b) in enumerate(chunk):
            x, y = f"_x{idx[a]}", f"_x{idx[b]}"
            if a in full and b in full:
                n, sx, sy, qx, qy = "n_all", f"s{idx[a]}", f"s{idx[b]}", f"q{idx[a]}", f"q{idx[b]}"
                aggs[sx], aggs[sy] = f"sum({x})", f"sum({y})"
                aggs[qx], aggs[qy] = f"sum({x} * {x})", f"sum({y} * {y})"
            else:
                both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
                n, sx, sy, qx, qy = f"pn{i}", f"psx{i}", f"psy{i}", f"pqx{i}", f"pqy{i}"
                aggs[n] = f"count_if({both})"
                aggs[sx], aggs[sy] = f"sum(IF({both}, {x}, NULL))", f"sum(IF({both}, {y}, NULL))"
                aggs[qx] = f"sum(IF({both}, {x} * {x}, NULL))"
                aggs[qy] = f"sum(IF({both}, {y} * {y}, NULL))"
            aggs[f"p{i}"] = f"sum({x} * {y})"
            cov = f"(p{i} - {sx} * {sy} / {n})"
            vx, vy = f"({qx} - {sx} * {sx} / {n})", f"({qy} - {sy} * {sy} / {n})"
            # an infinite value makes sums NaN, which Spark orders above all numbers: no coefficient
            r = (f"nullif(IF({n} > 1 AND {vx} > {CONSTANT} * {qx} AND {vy} > {CONSTANT} * {qy}, "
                 f"{cov} / sqrt({vx} * {vy}), CAST(NULL AS DOUBLE)), CAST('NaN' AS DOUBLE))")
            items.append(f"named_struct('column_a', '{sq(a)}', 'column_b', '{sq(b)}', 'r', {r})")
        wide = centred.agg(*[F.expr(f"{e} AS {k}") for k, e in aggs.items()])
        parts.append(wide.selectExpr(f"inline(array({', '.join(items)}))"))
    out = parts[0] if parts else centred.sparkSession.createDataFrame(
        [], "column_a string, column_b string, r double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, varies


def pair_correlations(df: DataFrame | gram.Pivoted, columns: Sequence[str] | None = None,
                      facts: tuple | None = None, once: bool = False,
                      least: float | None = None) -> tuple[DataFrame, list[str], dict]:
    """Unrounded r for every column pair (i < j) of the non-empty numeric
    columns, as a local relation (one row per pair: bounded by the schema),
    or for wide tables as a written one, with the column list and which
    columns vary. Shared by the correlation matrix, the heatmap and the
    strong-correlation list. Who reads the pairs ``once`` gets very many
    unwritten; pairs with ``|r| < least`` or without r may be left out."""
    packed = None
    if isinstance(df, gram.Pivoted):
        packed = df.packed()
        spark = packed.rows.sparkSession
        cand = list(columns) if columns is not None else packed.cols
        facts = facts or gram.column_facts(packed)
    else:
        raw, df = df, canonicalize(df)
        spark = df.sparkSession
        cand = list(columns) if columns is not None else classify(df).numeric
        if facts is None:
            if len(cand) >= WIDE_COLUMNS:
                packed = gram.Packed.of(raw, cand)
                facts = gram.column_facts(packed)
            else:
                facts = _column_facts(df, cand) if cand else (0, {}, {}, {})
    # named columns are all kept (an empty one gets missing coefficients);
    # the automatic choice is the non-empty numeric columns
    cols = cand if columns is not None else [c for c in cand if facts[1][c] > 0]
    if len(cols) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, r double"), cols, {}
    if isinstance(df, gram.Pivoted) or len(cols) >= WIDE_COLUMNS and facts[0]:
        out = gram.pair_frame(packed or gram.Packed.of(raw, cols), cols, facts, CONSTANT, least)
        unwritten = once and len(cols) * (len(cols) - 1) // 2 > PAIRS_WRITTEN
        return out if unwritten else written(out, "pairs"), cols, facts[3]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    upper, varies = _pair_stats(df, pairs, facts)
    return spark.createDataFrame(upper.collect(), upper.schema), cols, varies


def matrix_from_pairs(pairs: tuple[DataFrame, list[str], dict], decimals: int | None = 3) -> DataFrame:
    """Both orientations plus the diagonal (1 for a column that varies,
    missing otherwise)."""
    upper, cols, varies = pairs
    spark = upper.sparkSession
    if len(cols) < 2:
        return upper
    if decimals is not None:
        upper = upper.withColumn("r", F.round("r", decimals))
    # both orientations from one read of the pairs
    both = upper.select(F.inline(F.array(
        F.struct("column_a", "column_b", "r"),
        F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"))))
    diag = spark.createDataFrame([(c, c, 1.0 if varies[c] else None) for c in cols],
                                 "column_a string, column_b string, r double")
    return both.unionByName(diag)


def strong_from_pairs(pairs: tuple[DataFrame, list[str], dict], threshold: float = STRONG_CORRELATION) -> DataFrame:
    """Strong pairs from :func:`pair_correlations` (see
    :func:`strong_correlations`)."""
    upper, cols, _ = pairs
    if len(cols) < 2:
        return upper.sparkSession.createDataFrame(
            [], "rank int, column_a string, column_b string, r double, direction string, description string"
        )
    r = upper.withColumn("r", F.round("r", 3))
    strong = r.where(F.abs("r") >= threshold)
    # a row a column, not an expression a column
    places = upper.sparkSession.createDataFrame(list(enumerate(cols)), "_at int, _of string")
    for side in ("a", "b"):
        at = places.select(F.col("_at").alias(f"_{side}"), F.col("_of").alias(f"column_{side}"))
        strong = strong.join(F.broadcast(at), f"column_{side}")
    direction = F.when(F.col("r") > 0, F.lit(DIRECTION_POSITIVE)).otherwise(F.lit(DIRECTION_NEGATIVE))
    # a window over at most one row per column pair
    w = Window.orderBy(F.abs("r").desc(), "_a", "_b")
    return strong.select(
        F.row_number().over(w).alias("rank"), "column_a", "column_b", "r",
        direction.alias("direction"),
        fill(CORRELATION_TEXT, F.col("column_a"), direction, F.col("column_b"), fixed2(F.col("r"))
             ).alias("description"),
    )


def correlation_matrix(df: DataFrame | gram.Pivoted, decimals: int | None = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_a, column_b, r`` in both orientations plus the
    diagonal, over the non-empty numeric columns; empty with fewer than two.
    ``decimals=None`` keeps r unrounded (heatmap)."""
    return matrix_from_pairs(pair_correlations(df, columns, once=True), decimals)


def strong_correlations(df: DataFrame | gram.Pivoted, threshold: float = STRONG_CORRELATION) -> DataFrame:
    """A7 + F6: unordered pairs with ``|round(r,3)| >= threshold``.

    ``rank, column_a, column_b, r, direction, description``; rank orders by
    |r| descending, ties in column order (the pair enumeration order).
    The frame has at most one row per column pair (bounded by the schema).
    """
    return strong_from_pairs(pair_correlations(df, once=True, least=threshold - ROUNDING), threshold)


def quartiles(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``column, q1, median, q3`` - exact (linear interpolation) by
    default, ``exact=False`` for the bounded-memory sketch."""
    df = canonicalize(df)
    cols = list(columns) if columns is not None else classify(df).numeric
    q = _quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    return q.groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, only_found: bool = True,
                 quantiles: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """``column, count, percentage, lower, upper`` with the 1.5·IQR rule.

    Columns need at least 4 values and a non-zero IQR. Pass 1 is the
    quartile job; its two values a column are collected, and pass 2 counts
    the values outside the bounds for every column in one aggregation.
    """
    df = canonicalize(df)
    cols = list(columns) if columns is not None else classify(df).numeric
    empty = df.sparkSession.createDataFrame(
        [], "column string, count bigint, percentage double, lower double, upper double"
    )
    if not cols:
        return empty
    q = quantiles if quantiles is not None else _quantiles(df, cols, [0.25, 0.75], exact=exact)
    # The quartiles are (columns x 2) values: read them once and use them
    # as literals in the single counting pass.
    qv = {(r["column"], r["p"]): r["value"] for r in q.collect()}
    aggs, structs = [], []
    for i, c in enumerate(cols):
        if (c, 0.25) not in qv:
            continue
        v = qcol(c).cast("double")
        q1, q3 = qv[(c, 0.25)], qv[(c, 0.75)]
        iqr = q3 - q1
        lo, hi = q1 - OUTLIER_WHISKER * iqr, q3 + OUTLIER_WHISKER * iqr
        aggs += [F.count(v).alias(f"n{i}"), F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}")]
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("count"),
            F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.lit(iqr).alias("iqr"),
        ))
    if not aggs:
        return empty
    wide = df.agg(*aggs)
    out = _long_from_wide(wide, structs).where(
        (F.col("n") >= OUTLIER_MIN_VALUES) & (F.col("iqr") != 0)
    ).select(
        "column", "count",
        F.round(F.col("count") / F.col("n") * 100, 2).alias("percentage"),
        F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
    )
    if only_found:
        out = out.where(F.col("count") > 0)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """A10: ``column, distinct`` (missing excluded). Exact distinct counts
    are a two-phase distributed aggregation; ``exact=False`` uses HLL++."""
    df = canonicalize(df)
    cols = list(columns) if columns is not None else [
        c for c in df.columns if classify(df).of(c) != "other"
    ]
    if exact:
        found = exact_distinct(df, cols)
        return df.sparkSession.createDataFrame([(c, found[c]) for c in cols], "column string, distinct bigint")
    wide = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return _long_from_wide(wide, [
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("long").alias("distinct"))
        for i, c in enumerate(cols)
    ])


def _distinct_key(df: DataFrame, c: str) -> Column:
    """A short key that two values share exactly if they are equal: their
    text, or its SHA-256 where that is shorter (no long text is shuffled);
    -0.0 counts as 0.0."""
    t = df.schema[c].dataType.typeName()
    v = qcol(c) + F.lit(0.0) if t in ("float", "double") else qcol(c)
    if t in ("array", "map", "struct", "variant"):
        v = F.to_json(v)
    elif t == "binary":
        v = F.hex(v)
    v = v.cast("string")
    return F.when(F.length(v) > 32, F.unhex(F.sha2(v.cast("binary"), 256))).otherwise(v.cast("binary"))


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values of each column (missing excluded). Whole numbers and
    dates that lie densely set bits: a 4 KB bit map a range of 32,768 values
    crosses the shuffle, not a row a value. The others are one row a
    (column, key), partially aggregated, then counted by column."""
    if not columns:
        return {}
    dense = _dense(df, columns)
    found = _counted_bits(df, dense)
    rest = [c for c in columns if c not in dense]
    return found | (_counted_keys(df, rest) if rest else {})


WHOLE_NUMBERS = ("byte", "short", "integer", "long", "date")
#: Values of a bit map, and its bytes.
MAP_VALUES, MAP_BYTES = 32_768, 4_096


def _whole_number(df: DataFrame, c: str) -> Column:
    return F.unix_date(qcol(c)).cast("long") if df.schema[c].dataType.typeName() == "date" else qcol(c).cast("long")


def _dense(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose bit maps are smaller than their distinct values as rows
    (about 16 bytes each), by range and sketched number."""
    whole = [c for c in columns if df.schema[c].dataType.typeName() in WHOLE_NUMBERS]
    if not whole:
        return []
    row = df.agg(*[f(_whole_number(df, c)).alias(f"{n}{i}") for i, c in enumerate(whole)
                   for n, f in (("lo", F.min), ("hi", F.max), ("d", F.approx_count_distinct))]).first()
    return [c for i, c in enumerate(whole) if row[f"lo{i}"] is not None
            and ((row[f"hi{i}"] - row[f"lo{i}"]) // MAP_VALUES + 2) * MAP_BYTES <= 16 * max(row[f"d{i}"], 1_000)]


def _counted_bits(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    items = [F.when(qcol(c).isNotNull(), F.struct(
        F.lit(i).alias("_c"), F.bitmap_bucket_number(_whole_number(df, c)).alias("_b"),
        F.bitmap_bit_position(_whole_number(df, c)).alias("_p"))) for i, c in enumerate(columns)]
    maps = (df.select(F.inline(F.array_compact(F.array(*items)))).groupBy("_c", "_b")
            .agg(F.bitmap_count(F.bitmap_construct_agg("_p")).alias("_n")))
    found = dict(maps.groupBy("_c").agg(F.sum("_n")).collect())  # a row a column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def _counted_keys(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    items = [F.when(qcol(c).isNotNull(), F.struct(F.lit(i).alias("_c"), _distinct_key(df, c).alias("_k")))
             for i, c in enumerate(columns)]
    keys = df.select(F.inline(F.array_compact(F.array(*items)))).distinct()
    found = dict(keys.groupBy("_c").agg(F.count(F.lit(1))).collect())  # a row a column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """A11 for one column, typed: ``value, count, rank`` - the ``k`` most
    frequent values, count desc then value asc.

    Text goes through :func:`~.frequent.top_counts`. Other types: partial
    aggregation per value, then a global top-k (TakeOrderedAndProject keeps
    k rows per partition); the rank window runs over those k rows only.
    """
    if is_text(df, column):
        return top_counts(df, [column], k).select(F.col("_v").alias("value"), F.col("_n").alias("count"), F.col("_rank").alias("rank"))
    c = qcol(column)
    counts = canonicalize(df).where(c.isNotNull()).groupBy(c.alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    top = counts.orderBy(F.col("count").desc(), F.col("value").asc()).limit(k)
    # the rank window sees the k kept rows only
    w = Window.orderBy(F.col("count").desc(), F.col("value").asc())
    return top.select("value", "count", F.row_number().over(w).alias("rank"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES_PROFILE) -> DataFrame:
    """A11 for many columns in one count: ``column, value, count, rank``.

    Values are compared as text (one common type for all columns) and
    counted by short keys (:func:`~.frequent.top_counts`). The rank filter
    lets Spark insert a partial WindowGroupLimit before the shuffle, so
    each column's window sees at most k rows per upstream partition.
    """
    df = canonicalize(df)
    cols = list(columns) if columns is not None else classify(df).categorical
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    names = F.array(*map(F.lit, cols))
    return top_counts(df, cols, k).select(F.get(names, F.col("_c")).alias("column"), F.col("_v").alias("value"),
                                          F.col("_n").alias("count"), F.col("_rank").alias("rank"))


def column_roles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, class, min, max, distinct, description`` for each
    column; numeric range, date role, or number of distinct values.

    Booleans count as numeric here (as the reference's role test does).
    """
    df = canonicalize(df)
    cls = classify(df)
    cols = list(columns) if columns is not None else df.columns
    aggs, structs = [], []
    text = [c for c in cols if cls.of(c) not in ("numeric", "datetime") and df.schema[c].dataType.typeName() != "boolean"]
    distinct = exact_distinct(df, text)
    for i, c in enumerate(cols):
        kind = cls.of(c)
        is_bool = df.schema[c].dataType.typeName() == "boolean"
        if kind == "numeric" or is_bool:
            v = qcol(c).cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            desc = fill(ROLE_NUMERIC_TEXT, fixed2(F.col(f"lo{i}")), fixed2(F.col(f"hi{i}")))
            structs.append(F.struct(
                F.lit(c).alias("column"), F.lit("numeric").alias("class"),
                F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                F.lit(None).cast("long").alias("distinct"), desc.alias("description")))
        elif kind == "datetime":
            structs.append(F.struct(
                F.lit(c).alias("column"), F.lit("datetime").alias("class"),
                F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                F.lit(None).cast("long").alias("distinct"),
                F.lit(ROLE_DATETIME_TEXT).alias("description")))
        else:
            n = F.lit(distinct[c])
            structs.append(F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("class"),
                F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                n.cast("long").alias("distinct"),
                fill(ROLE_CATEGORICAL_TEXT, n.cast("string")).alias("description")))
    wide = df.agg(*aggs) if aggs else df.sparkSession.range(1).select(F.lit(1).alias("_"))
    return _long_from_wide(wide, structs)
