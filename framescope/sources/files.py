"""Sources (S1-S5): load a table the way the reference's loader does.

* CSV with a header row and inferred types (RFC-4180 quoting, quoted line
  breaks included);
* encoding fallback: UTF-8, else ISO-8859-1 (Spark never fails on bad
  bytes; it substitutes U+FFFD, so validity is tested explicitly);
* the usual text null tokens (``NA``, ``N/A``, ``null``...) read as missing,
  with types inferred after the tokens are removed;
* missing file -> ``FileNotFoundError``; unsupported suffix -> ``ValueError``.

Everything runs as Spark reads and projections; type inference after the
null tokens is one extra aggregation over the text columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import qcol
from .records import csv_records

# File suffixes and the text tokens read as missing.
CSV_SUFFIXES = (".csv",)
TABLE_SUFFIXES = (".parquet", ".orc", ".json")
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FALLBACK_ENCODING = "ISO-8859-1"


# Full forms of the values that a text column may be read as; the casts
# alone would also take "10D" for a number and "12:30" for a time of today.
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity|INF|INFINITY)$"
BOOLEAN = r"^([tT]rue|[fF]alse|TRUE|FALSE)$"
MOMENT = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")


def _exists(spark: SparkSession, path: str) -> bool:
    """A path or glob that the session's file systems know (a path without a
    scheme lies on the default one)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    found = files.globStatus(hpath)
    return found is not None and len(found) > 0


def csv_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether quoted fields may span lines, from one read of
    the raw lines (split across tasks): a line that is not valid UTF-8 means
    the fallback encoding, and a quoted line break leaves a line with an odd
    number of quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken")).first()
    return FALLBACK_ENCODING if row["utf8"] is False else "UTF-8", bool(row["broken"])


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, infer_types: bool = True,
             null_tokens: tuple[str, ...] = NULL_TOKENS, infer_dates: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """Header CSV, encoding fallback, null tokens, inferred types.

    Files with quoted line breaks are found and split too, into records
    (:func:`~.records.csv_records`); only those that do not quote by the
    rules are read whole, one task a file. ``encoding`` and ``multi_line``
    may be given instead of being found."""
    if encoding is None or multi_line is None:
        found = csv_layout(spark, path)
        encoding = encoding or found[0]
        multi_line = found[1] if multi_line is None else multi_line
    text = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("multiLine", multi_line).option("escape", '"').option("encoding", encoding)
        .csv(path)
    )
    if multi_line and (records := csv_records(spark, path, encoding)) is not None:
        options = {"escape": '"', "multiLine": "true"}
        parsed = F.from_csv(F.col("record"), ", ".join(f"c{i} STRING" for i in range(len(text.columns))), options)
        text = records.select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(text.columns)])
    tokens = F.array(*[F.lit(t) for t in null_tokens])
    cleaned = text.select(*[
        F.when(~F.array_contains(tokens, qcol(c)), qcol(c)).alias(c) for c in text.columns
    ])
    return infer_column_types(cleaned, infer_dates) if infer_types else cleaned


def infer_column_types(df: DataFrame, infer_dates: bool = True) -> DataFrame:
    """Per text column, the narrowest of bigint / double / boolean /
    timestamp whose full form every non-missing value has (and that the cast
    accepts), else text; a column with no value at all becomes double, as a
    numeric reader would type it. One aggregation decides all columns; the
    result is a lazy projection."""
    forms = {"bigint": INTEGER, "double": NUMBER, "boolean": BOOLEAN} | ({"timestamp": MOMENT} if infer_dates else {})
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(qcol(c))
        for t, form in forms.items():
            ok = v.rlike(form) & v.try_cast(t).isNotNull()
            aggs.append(F.count_if(v.isNotNull() & ~ok).alias(f"bad_{t}_{i}"))
        aggs.append(F.count(v).alias(f"n_{i}"))
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        fits = [t for t in forms if row[f"bad_{t}_{i}"] == 0]
        chosen = "double" if row[f"n_{i}"] == 0 else next(iter(fits), None)
        out.append(F.trim(qcol(c)).try_cast(chosen).alias(c) if chosen else qcol(c))
    return df.select(*out)


def load_dataset(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on the suffix; errors like the reference's loader."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    lower = path.lower().rstrip("/")
    if lower.endswith(CSV_SUFFIXES):
        return read_csv(spark, path, **kw)
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith(".orc"):
        return spark.read.orc(path)
    if lower.endswith(".json"):
        return spark.read.json(path)
    raise ValueError(f"Unsupported file type: {os.path.splitext(path)[1] or path}")
