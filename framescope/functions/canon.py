"""Canonical form of an input frame and column addressing.

"Missing" means null *or* NaN, as in pandas' ``isnull``. Spark keeps NaN as
an ordinary value (``max`` returns NaN, ``NaN > 5`` is true), so every float
column is rewritten ``NaN -> null`` once, up front; afterwards every built-in
aggregate skips missing values the same way pandas does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column's exact name in an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """Column by exact name; dots, spaces and backticks are quoted."""
    return F.col(quoted(name))


def check_unique_names(names: Sequence[str], case_sensitive: bool = False) -> None:
    """Spark resolves names case-insensitively by default; refuse frames whose
    names would be ambiguous."""
    seen: dict[str, str] = {}
    for name in names:
        key = name if case_sensitive else name.lower()
        if key in seen:
            raise ValueError(f"Columns '{seen[key]}' and '{name}' differ only by case.")
        seen[key] = name


def canonicalize(df: DataFrame) -> DataFrame:
    """NaN -> null for every float/double column; other columns untouched.
    Names that Spark could not tell apart are an error here, not later.

    A pure projection: Catalyst folds it into the scan stage and prunes
    unused columns through it.
    """
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        check_unique_names(df.columns)
    float_types = (T.FloatType, T.DoubleType)
    if not any(isinstance(f.dataType, float_types) for f in df.schema.fields):
        return df
    out = []
    for f in df.schema.fields:  # texts: a few calls to the JVM a column take minutes on thousands of them
        c = quoted(f.name)
        out.append(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" if isinstance(f.dataType, float_types) else c)
    return df.selectExpr(*out)
