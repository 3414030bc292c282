"""Result sinks (S6): write a result frame, or hand a bounded payload to a
caller (``columns`` + ``rows``), never collecting more than asked for."""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ask import RESULT_ROWS, shape_result


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result frame with Spark's writer (parquet, json, csv, orc).
    CSV has a header, doubles quotes (RFC 4180) and keeps spaces at the ends,
    so that :func:`~.files.load_dataset` reads the same texts back."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
                  .option("ignoreTrailingWhiteSpace", False))
    writer.format(fmt).save(path)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.strftime("%Y-%m-%d")
    return v


def answer_kind(df: DataFrame, keys: int = 0) -> DataFrame:
    """How an answer is shown, as one row ``kind, columns``: ``table``, or
    ``scalar`` for one value (a single row with one column besides its
    ``keys``), or ``none`` without rows. At most two rows are looked at."""
    rows = df.limit(2).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(len(df.columns) - keys == 1)
    kind = F.when(F.col("n") == 0, "none").when((F.col("n") == 1) & one, "scalar").otherwise("table")
    return rows.select(kind.alias("kind"), F.lit(len(df.columns)).alias("columns"))


def to_answer(df: DataFrame, keys: int = 0, cap: int = RESULT_ROWS) -> dict:
    """The value of a one-value answer as ``{"scalar"}`` (None without rows),
    else the table of :func:`to_payload` as ``{"table"}``."""
    table = to_payload(df, cap)
    if not table["rows"]:
        return {"scalar": None}
    if len(table["rows"]) == 1 and len(table["columns"]) - keys == 1:
        return {"scalar": table["rows"][0][keys]}
    return {"table": table}


def to_payload(df: DataFrame, cap: int = RESULT_ROWS) -> dict:
    """``{"columns", "rows", "truncated"}`` with at most ``cap`` rows; one
    extra row is fetched to know whether more exist."""
    rows = shape_result(df).limit(cap + 1).collect()
    return {
        "columns": list(df.columns),
        "rows": [[_plain(v) for v in r] for r in rows[:cap]],
        "truncated": len(rows) > cap,
    }
