"""Samples by hash: the same rows for any partitioning of a table.

A row's place in the sample is the MD5 of its key, so a sample can be taken again
(after a retry, on another cluster) and two samples of one key are nested. No row
is moved for a fraction; a number of rows keeps that many per partition before
the one merge (bottom-k).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import qcol


def key_hash(key: Sequence[str]) -> Column:
    """MD5 (hex) of the key columns' texts, joined by ``:`` (missing: empty)."""
    return F.md5(F.concat_ws(":", *[F.coalesce(qcol(c).cast("string"), F.lit("")) for c in key]))


def hash_sample(df: DataFrame, key: Sequence[str], rows: int | None = None, fraction: float | None = None) -> DataFrame:
    """The ``rows`` rows with the least hashes of ``key`` (ties by the key), or
    those whose hash lies in the first ``fraction`` of all hashes."""
    if (rows is None) == (fraction is None):
        raise ValueError("give either rows or fraction")
    if rows is not None:
        return df.orderBy(key_hash(key), *[qcol(c) for c in key]).limit(rows)
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    if fraction == 1:
        return df
    return df.where(F.substring(key_hash(key), 1, 8) < F.lit(f"{int(fraction * 2 ** 32):08x}"))
