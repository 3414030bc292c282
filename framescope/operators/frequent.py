"""The most frequent values of text columns (A11, K2, K9, C2, C4), exact.

One read keeps a frequent-items sketch a column (bounded, merged over tasks):
its candidates come with a bound on the count of any value that is not among
them. Where the k-th candidate's least possible count is above that bound, only
candidates are counted; no row of another value leaves its task. Columns without
such frequent values count all of theirs.

Values are counted by a short key, their first :data:`HEAD` characters and, for
longer ones, their SHA-256, so no long text is shuffled. The texts of the winners
alone are fetched by a second read, and only where a winner is that long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import qcol
from ..session import written

#: Characters of a value that its key holds.
HEAD = 64
#: Values a sketch tracks. A count is off by at most ``3.5 / TRACKED`` of the
#: rows, and a value that the sketch does not report by twice that.
TRACKED = 10_000
#: Candidates of a column that are counted.
CANDIDATES = 200
#: Winners up to which their keys are sent to every task.
SENT = 10_000


def _key(v: Column) -> list[Column]:
    return [F.substring(v, 1, HEAD).alias("_s"), F.when(F.length(v) > HEAD, F.unhex(F.sha2(v.cast("binary"), 256))).alias("_h")]


def _proven(listed: list, rows: int, k: int) -> list[int] | None:
    """Hashes of the candidates that hold the k most frequent values, ties with
    the k-th included; None where the sketch cannot prove it."""
    shown = listed[:CANDIDATES]
    if len(shown) == len(listed) and sum(x["count"] for x in shown) == rows:
        return [x["item"] for x in shown]  # every row's value is listed
    error = 3.5 * rows / TRACKED
    missing = max([2 * error] + [x["count"] for x in listed[CANDIDATES:CANDIDATES + 1]])
    if len(shown) >= k and shown[k - 1]["count"] - error > missing:
        return [x["item"] for x in shown]
    return None


def top_counts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``_c`` (number of the column), ``_v`` (value as text), ``_n`` (count),
    ``_rank``: the ``k`` most frequent values of each column, count desc then
    value asc. Missing values do not count (canonical frame)."""
    text = [qcol(c).cast("string") for c in columns]
    facts = df.agg(*[F.count(t).alias(f"n{i}") for i, t in enumerate(text)],
                   *[F.coalesce(F.max(F.length(t)), F.lit(0)).alias(f"l{i}") for i, t in enumerate(text)],
                   *[F.call_function("approx_top_k_accumulate", F.when(t.isNotNull(), F.xxhash64(t)), F.lit(TRACKED)).alias(f"t{i}")
                     for i, t in enumerate(text)])
    row = facts.select("*", *[F.call_function("approx_top_k_estimate", F.col(f"t{i}"), F.lit(CANDIDATES + 1)).alias(f"e{i}")
                              for i in range(len(text))]).first()
    items, long = [], False
    for i, t in enumerate(text):
        listed = [x for x in row[f"e{i}"] if x["item"] is not None]
        chosen = _proven(listed, row[f"n{i}"], k)
        wanted = t.isNotNull() if chosen is None else F.xxhash64(t).isin(chosen) & t.isNotNull()
        items.append(F.when(wanted, F.struct(F.lit(i).alias("_c"), *_key(t))))
        long = long or row[f"l{i}"] > HEAD
    counts = (df.select(F.inline(F.array_compact(F.array(*items)))).groupBy("_c", "_s", "_h")
              .agg(F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy("_c").orderBy(F.col("_n").desc(), F.col("_s").asc())
    if not long:  # the key's head is the value
        return counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).select(
            "_c", F.col("_s").alias("_v"), "_n", "_rank")
    kept = written(counts.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= k).drop("_rank"), "winners")
    winners = kept.where(F.col("_h").isNotNull()).select("_c", "_s", "_h")
    if winners.limit(SENT + 1).count() <= SENT:
        winners = F.broadcast(winners)
    whole = [F.when(F.length(t) > HEAD, F.struct(F.lit(i).alias("_c"), *_key(t), t.alias("_v"))) for i, t in enumerate(text)]
    found = (df.select(F.inline(F.array_compact(F.array(*whole)))).join(winners, ["_c", "_s", "_h"], "left_semi")
             .groupBy("_c", "_s", "_h").agg(F.first("_v").alias("_v")))
    named = kept.join(found.select("_c", "_h", "_v"), ["_c", "_h"], "left").withColumn("_v", F.coalesce("_v", "_s"))
    last = Window.partitionBy("_c").orderBy(F.col("_n").desc(), F.col("_v").asc())
    return named.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= k).select("_c", "_v", "_n", "_rank")


def is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "varchar", "char")
