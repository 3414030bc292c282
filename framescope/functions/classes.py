"""Column classes (numeric / categorical / datetime / other), dataset shape
and column validation.

Classes are decided from the schema alone (no job), in schema order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType, T.CharType, T.VarcharType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, CATEGORICAL_TYPES):
        return "categorical"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    return "other"


@dataclass(frozen=True)
class ColumnClasses:
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    other: list[str]

    def of(self, name: str) -> str:
        for kind in ("numeric", "categorical", "datetime", "other"):
            if name in getattr(self, kind):
                return kind
        raise KeyError(name)


def classify(df: DataFrame) -> ColumnClasses:
    """Column lists per class, schema order."""
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        groups[column_class(f.dataType)].append(f.name)
    return ColumnClasses(**groups)


class ColumnNotFoundError(ValueError):
    def __init__(self, column: str, available: list[str]):
        super().__init__(f"Column '{column}' not found. Available columns: {', '.join(available)}")
        self.column = column
        self.available = available


def validate_columns(df: DataFrame, *names: str | None) -> None:
    """Every named column must exist; the first offender is reported."""
    cols = df.columns
    for name in names:
        if name and name not in cols:
            raise ColumnNotFoundError(name, cols)


def shape_frame(df: DataFrame) -> DataFrame:
    """P1 + P2 as one row: rows, columns and the column count per class.

    The row count is a distributed ``count(*)``; the schema facts are
    literals, so the plan is one scan with no columns read.
    """
    cls = classify(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(cls.numeric)).alias("numeric_columns"),
        F.lit(len(cls.categorical)).alias("categorical_columns"),
        F.lit(len(cls.datetime)).alias("datetime_columns"),
    )


def schema_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type and class (no job)."""
    rows = [
        (i, f.name, f.dataType.simpleString(), column_class(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "position int, column string, dtype string, class string"
    )
