"""Exact quantiles (linear interpolation) with bounded state per task.

Spark's exact ``percentile`` merges a value -> count map per group in one
task; for a column or group with many values that task holds them all. The
jobs here give the same answers without it:

* **Whole table** (:func:`exact_quantiles` without groups), two reads. The
  first keeps one mergeable KLL sketch a column, which serves every rank: the
  sketched values a few rank errors to both sides of a wanted rank bracket it.
  The second counts the rows below each bracket (``observe``) and keeps the
  values inside, about one row in a hundred, each value once with its count.
  They hold the wanted rank, which the counts prove; a bracket that missed is
  done again without bounds.
* **By group** (:func:`grouped_quantiles`). Groups of at most ``GROUP_ROWS``
  rows take Spark's ``percentile``, whose map is bounded by them. Larger groups
  get a sketch each and brackets as above, joined to their rows on the keys.
* **Rank selection** (:func:`_pick`). Few values inside are ordered by one
  window. More are range-partitioned by (group, value): prefix sums of the
  partitions' counts name the partition that holds a rank, and only that one is
  ordered. So a hot group spreads over as many tasks as its values ask for, and
  a hot value is one row.

Ranks are 0-based ``floor((n - 1) p)`` and the next one, as in pandas,
DuckDB's ``quantile_cont`` and Spark's ``percentile``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.canon import qcol
from ..session import written

#: Size of a column's KLL sketch, and of a large group's.
SKETCH, GROUP_SKETCH = 2_000, 1_000
#: Brackets reach this many rank errors to both sides.
MARGIN = 2.0
#: Values inside a bracket that one window orders.
FINAL_ROWS = 200_000
#: Rows of a group up to which Spark's ``percentile`` holds its values.
GROUP_ROWS = 50_000


def _value(name: str) -> Column:
    v = qcol(name).cast("double")
    return F.when(~F.isnan(v), v)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = (),
                    final_rows: int = FINAL_ROWS, sketch: int = SKETCH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``[*group_cols], column, p, value``: one row per (group, column, p)
    for every column with a value. Group columns named ``column``, ``p`` or
    ``value`` need :func:`grouped_quantiles`."""
    if not columns or not probs:
        raise ValueError("need at least one column and one probability")
    if not group_cols:
        return _whole_table(df, list(columns), [float(p) for p in probs], final_rows, sketch)
    wide = grouped_quantiles(df, columns, probs, group_cols, final_rows, min(sketch, GROUP_SKETCH), group_rows)
    items = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.col(f"_q{i}_{j}").alias("value"))
             for i, c in enumerate(columns) for j, p in enumerate(probs)]
    named = [F.col(f"_g{i}").alias(g) for i, g in enumerate(group_cols)]
    return wide.select(*named, F.inline(F.array(*items))).where(F.col("value").isNotNull())


def rank_error(sketch: int) -> float:
    """Share of the rows by which a KLL sketch of this size may misplace a
    rank (with 99 % confidence)."""
    return 2.296 / sketch ** 0.9021


def _sketched(v: Column, probs: Sequence[float], sketch: int) -> Column:
    """Lower and upper ends of every probability's bracket, one after another
    (an end beyond the values is infinite); null without a value."""
    near = MARGIN * rank_error(sketch)
    ends = [x for p in probs for x in (max(0.0, p - near), min(1.0, p + near))]
    got = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, F.lit(sketch)), F.array(*map(F.lit, ends)))
    fixed = [F.lit(-math.inf) if x == 0.0 else F.lit(math.inf) if x == 1.0 else got[i] for i, x in enumerate(ends)]
    return F.when(F.count(v) > 0, F.array(*fixed))


def _whole_table(df: DataFrame, columns: list[str], probs: list[float], final_rows: int, sketch: int) -> DataFrame:
    spark = df.sparkSession
    vals = df.select(*[_value(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    row = vals.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"_v{i}").alias(f"n{i}") for i in range(len(columns))],
                   *[_sketched(F.col(f"_v{i}"), probs, sketch).alias(f"s{i}") for i in range(len(columns))]).first()
    brackets = {(i, j): (row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1])
                for i in range(len(columns)) for j in range(len(probs)) if row[f"n{i}"]}
    near = MARGIN * rank_error(sketch)
    for i, j in brackets:
        if row[f"n{i}"] * near < 2:  # so few values that a bracket may end between two neighbours
            brackets[i, j] = (-math.inf, math.inf)
    found = _inside(vals, brackets, probs, row, 2 * near * row["rows"] > final_rows, final_rows)
    if missed := {k: (-math.inf, math.inf) for k in brackets if k not in found}:
        found.update(_inside(vals, missed, probs, row, row["rows"] > final_rows, final_rows))
    return spark.createDataFrame([(columns[i], probs[j], found[i, j]) for i, j in brackets],
                                 "column string, p double, value double")


def _inside(vals: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]], probs: list[float], facts, large: bool,
            final_rows: int) -> dict[tuple[int, int], float]:
    """One read: the quantiles whose brackets hold their ranks."""
    if not brackets:
        return {}
    spark = vals.sparkSession
    keys, ranges = list(brackets), {}
    for i, j in keys:  # equal ranges of a column are counted once
        ranges.setdefault((i, *brackets[i, j]), len(ranges))
    v = {r: F.col(f"_v{i}") for (i, _, _), r in ranges.items()}
    inside = {r: (v[r] >= F.lit(lo)) & (v[r] <= F.lit(hi)) for (_, lo, hi), r in ranges.items()}
    below = {f"b{r}": F.count_if(v[r] < F.lit(lo)) for (_, lo, _), r in ranges.items()}
    seen = Observation()
    any_inside = F.lit(False)
    for r in inside:
        any_inside = any_inside | F.coalesce(inside[r], F.lit(False))
    items = [F.when(inside[r], F.struct(F.lit(r).alias("_r"), (v[r] + F.lit(0.0)).alias("_v"))) for r in inside]
    observed = vals.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in below.items()])
    counts = written(observed.where(any_inside).select(F.inline(F.array_compact(F.array(*items))))
                     .groupBy("_r", "_v").agg(F.count(F.lit(1)).alias("_k")), "inside")
    less = seen.get
    if less["rows"] != facts["rows"]:  # a task ran twice and counted its rows twice
        less = vals.agg(*[c.alias(n) for n, c in below.items()]).first().asDict()
    # each wanted quantile is a group of its own: its range's values after one row for all below
    wanted = spark.createDataFrame([(q, ranges[(i, *brackets[i, j])], facts[f"n{i}"], probs[j]) for q, (i, j) in enumerate(keys)],
                                   "_q int, _r int, _n long, _p double")
    start = spark.createDataFrame([(r, None, less[f"b{r}"], False) for r in ranges.values()], "_r int, _v double, _k long, _in boolean")
    parts = max(1, counts.count() // final_rows) if large else 0
    picked = _pick(counts.withColumn("_in", F.lit(True)).unionByName(start).join(F.broadcast(wanted), "_r").drop("_r"), ["_q"], parts)
    return {keys[r["_q"]]: r["_x"] for r in picked.collect() if r["_x"] is not None}


def _pick(counts: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``*keys, _n, _p, _x``: the ``_p`` quantile of each group from its values
    ``_v`` with counts ``_k``, in order of ``_in`` (rows below a bracket first,
    as one) and value; null where its ranks are not among them. ``parts`` > 0
    orders by that many range partitions instead of a window a group."""
    h = (F.col("_n") - 1) * F.col("_p")
    k0 = F.floor(h)
    k1 = F.ceil(h)

    def covers(k: Column) -> Column:
        return (F.col("_to") - F.col("_k") <= k) & (k < F.col("_to"))

    def running(*by: str):
        return F.sum("_k").over(Window.partitionBy(*by).orderBy("_in", "_v").rowsBetween(Window.unboundedPreceding, 0))

    if parts:
        ranged = written(counts.repartitionByRange(parts, *keys, "_in", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
        totals = ranged.groupBy(*keys, "_part").agg(F.sum("_k").alias("_k"), F.first("_n").alias("_n"), F.first("_p").alias("_p"))
        upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        held = totals.withColumn("_to", upto).where(covers(k0) | covers(k1))
        held = held.select(*keys, "_part", (F.col("_to") - F.col("_k")).alias("_before"))
        ordered = ranged.join(held, [*keys, "_part"]).withColumn("_to", F.col("_before") + running(*keys, "_part"))
    else:
        ordered = counts.withColumn("_to", running(*keys))
    hit = ordered.where(F.col("_in")).groupBy(*keys, "_n", "_p").agg(
        F.max(F.when(covers(k0), F.col("_v"))).alias("_lo"), F.max(F.when(covers(k1), F.col("_v"))).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return hit.select(*keys, "_n", "_p", F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo)).alias("_x"))


def grouped_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str],
                      final_rows: int = FINAL_ROWS, sketch: int = GROUP_SKETCH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per group: ``_g<i>`` the keys, ``_n<c>`` the number of values
    and ``_q<c>_<p>`` the quantiles, numbered in the order given (names of
    the table cannot clash). Rows with a null key do not count."""
    probs = [float(p) for p in probs]
    keys = [f"_g{i}" for i in range(len(group_cols))]
    numbers = range(len(columns))
    base = df.select(*[qcol(g).alias(k) for g, k in zip(group_cols, keys)],
                     *[(_value(c) + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(columns)])
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    counted = [F.count(f"_v{i}").alias(f"_n{i}") for i in numbers]
    most = F.greatest(*[F.col(f"_n{i}") for i in numbers], F.lit(0))
    hot = base.groupBy(*keys).agg(*counted).where(most > group_rows)
    largest = hot.agg(F.count(F.lit(1)), F.max(most)).first()
    plist = F.array(*map(F.lit, probs))
    if largest[0]:
        hot = F.broadcast(written(hot.select(*keys), "hot-groups"))  # at most one for so many rows
    few = base.join(hot, keys, "left_anti") if largest[0] else base
    small = few.groupBy(*keys).agg(*counted, *[F.percentile(f"_v{i}", plist).alias(f"_p{i}") for i in numbers]).select(
        *keys, *[f"_n{i}" for i in numbers], *[F.col(f"_p{i}")[j].alias(f"_q{i}_{j}") for i in numbers for j in range(len(probs))])
    if not largest[0]:
        return small
    many = base.join(hot, keys, "left_semi")
    return small.unionByName(_hot_groups(many, keys, len(columns), probs, largest[1], final_rows, sketch))


def _hot_groups(rows: DataFrame, keys: list[str], columns: int, probs: list[float], largest: int, final_rows: int,
                sketch: int) -> DataFrame:
    """Quantiles of groups too large for one task: sketched brackets, rank
    selection among the values inside. Every (column, probability) of a group
    is a group of its own, ``_r``."""
    cells = [(i, j) for i in range(columns) for j in range(len(probs))]
    sketches = written(rows.groupBy(*keys).agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in range(columns)],
                                               *[_sketched(F.col(f"_v{i}"), probs, sketch).alias(f"_s{i}") for i in range(columns)]),
                       "sketches")

    def chosen(brackets: DataFrame, share: float) -> DataFrame:
        """``brackets``: the keys, and ``_s<column>`` as sketched."""
        items = []
        for r, (i, j) in enumerate(cells):
            v, lo, hi = F.col(f"_v{i}"), F.col(f"_s{i}")[2 * j], F.col(f"_s{i}")[2 * j + 1]
            items.append(F.when(v <= hi, F.struct(
                F.lit(r).alias("_r"), F.col(f"_n{i}").alias("_n"), F.lit(probs[j]).alias("_p"), (v >= lo).alias("_in"),
                F.when(v >= lo, v).alias("_v"))))
        counts = (rows.join(F.broadcast(brackets), keys).select(*keys, F.inline(F.array_compact(F.array(*items))))
                  .groupBy(*keys, "_r", "_n", "_p", "_in", "_v").agg(F.count(F.lit(1)).alias("_k")))
        inside = share * largest
        return _pick(counts, [*keys, "_r"], int(inside // final_rows) + 2 if inside > final_rows else 0)

    found = written(chosen(sketches, min(1.0, 2 * MARGIN * rank_error(sketch))), "found")
    missed = found.where(F.col("_x").isNull() & (F.col("_n") > 0)).select(*keys).distinct()
    lost = sketches.join(found.where(F.col("_x").isNotNull()).groupBy(*keys).count(), keys, "left").where(
        F.coalesce("count", F.lit(0)) < sum([F.when(F.col(f"_n{i}") > 0, len(probs)).otherwise(0) for i in range(columns)], F.lit(0)))
    missed = missed.unionByName(lost.select(*keys)).distinct()
    if not missed.isEmpty():  # without bounds nothing can be missed
        open_ends = F.array(*[F.lit(x) for _ in probs for x in (-math.inf, math.inf)])
        again = sketches.join(missed, keys, "left_semi").select(
            *keys, *[f"_n{i}" for i in range(columns)], *[open_ends.alias(f"_s{i}") for i in range(columns)])
        found = found.join(missed, keys, "left_anti").unionByName(chosen(again, 1.0))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == r, F.col("_x"))).alias(f"_q{i}_{j}") for r, (i, j) in enumerate(cells)])
    return sketches.select(*keys, *[f"_n{i}" for i in range(columns)]).join(wide, keys, "left")


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     group_cols: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles (``percentile_approx``, a bounded sketch per
    group; rank error at most n / accuracy). Same output as
    :func:`exact_quantiles`. Note that the sketch returns data values
    rather than interpolating between them."""
    keys = [qcol(g).alias(f"_g{i}") for i, g in enumerate(group_cols)]
    plist = [float(p) for p in probs]
    wide = df.select(*keys, *[_value(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    names = [f"_g{i}" for i in range(len(group_cols))]
    q = wide.groupBy(*names).agg(*[
        F.percentile_approx(f"_v{i}", plist, accuracy).alias(f"_q{i}") for i in range(len(columns))])
    items = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.col(f"_q{i}")[j].alias("value"))
             for i, c in enumerate(columns) for j, p in enumerate(plist)]
    return q.select(*[F.col(k).alias(g) for k, g in zip(names, group_cols)],
                    F.inline(F.array(*items))).where(F.col("value").isNotNull())


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = (),
              exact: bool = True, **kw) -> DataFrame:
    """Exact (default) or approximate quantiles."""
    if exact:
        return exact_quantiles(df, columns, probs, group_cols, **kw)
    return approx_quantiles(df, columns, probs, group_cols)
