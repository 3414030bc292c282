"""Text assembly on the Spark side: a template with ``{}`` slots filled
with columns (``concat``), and Python-style ``.2f`` number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, *parts: Column) -> Column:
    """``fill("{} is {}", a, b)`` -> ``concat(a, ' is ', b)``; missing when
    any part is missing."""
    pieces = template.split("{}")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"template {template!r} needs {len(pieces) - 1} parts")
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if i < len(parts):
            out.append(parts[i])
    return F.concat(*out)


def fixed2(c: Column) -> Column:
    """Two decimals as Python's ``f"{x:.2f}"`` writes them (rounding on the
    exact binary value, no thousands separators)."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")
