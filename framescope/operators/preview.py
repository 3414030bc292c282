"""Preview (P9) and sample values per column (P10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonicalize, qcol
from ..session import written

PREVIEW_ROWS = 50
SAMPLE_VALUES = 3
#: Rows in which the samples of all columns are looked for at once.
HEAD_ROWS = 200


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by an explicit order key (a frame has no
    file order); a top-k sort keeping n rows per partition."""
    return df.orderBy(*[qcol(c) for c in order_by]).limit(n)


def sample_values(df: DataFrame, order_by: Sequence[str], k: int = SAMPLE_VALUES) -> DataFrame:
    """P10: ``position, column, dtype, samples`` - the first ``k`` non-missing
    values of each column (as text) by the order key.

    The first ``HEAD_ROWS`` rows hold them for every column with ``k`` values
    there. Each other column takes a top-k of its own over its non-missing
    rows. Both are top-k sorts, whose tasks hold no more rows than they keep.
    """
    df = canonicalize(df)
    key = [qcol(c) for c in order_by]
    fields = df.schema.fields
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 (F.to_json(qcol(f.name)) if f.dataType.typeName() in ("map", "struct", "array")
                  else qcol(f.name).cast("string")).alias("value"))
        for i, f in enumerate(fields)
    ]
    in_order = F.row_number().over(Window.orderBy(*key))  # over rows that a top-k kept

    def long(rows: DataFrame, some: list) -> DataFrame:
        return rows.select(in_order.alias("at"), F.array(*some).alias("items")).select("at", F.inline("items")).where(
            F.col("value").isNotNull())

    size = max(k, HEAD_ROWS)
    found = written(long(df.orderBy(*key).limit(size), items), "head")
    held = dict(found.groupBy("position").agg(F.count(F.lit(1))).collect())  # a row a column
    short = [i for i in range(len(fields)) if held.get(i, 0) < k]
    if short:
        found = found.where(~F.col("position").isin(short))
        for i in short:
            there = df.where(items[i]["value"].isNotNull()).orderBy(*key).limit(k)
            found = found.unionByName(long(there, [items[i]]))
    w = Window.partitionBy("position").orderBy("at")
    firsts = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return firsts.groupBy("position", "column", "dtype").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("samples")
    )
