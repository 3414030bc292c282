"""Helpers shared by the corpus operators: native word splitting, row keys,
the held-out remainder, and scratch space every executor can reach."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+`` words.
SPACES = " \t\n\x0b\f\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: as a lambda variable it
    cannot be inlined into every element of the body's own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    lowered = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def text_key(text: Column) -> Column:
    """Sets rows with the same id but other texts apart in joins on the id."""
    return F.xxhash64(text)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, so that very long texts fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, size: int = 8 << 20):
    """Arrow batches of at most about ``size`` bytes for the jobs that run
    inside the block; the session's own settings come back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI) below the session's checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its rows outlive
    lost executors and later passes do not compute them again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_files(uri: str):
    """File system and path of a shared folder, for Python tasks that write
    or read binary files there (local mounts, or any store pyarrow knows)."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, data_writer) -> str:
    """Write one file of a shared folder under its final name only when it is
    whole, so that a repeated or speculative task does no harm."""
    files, base = shared_files(uri)
    files.create_dir(base, recursive=True)
    part, final = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"
    with files.open_output_stream(part, compression=None) as out:
        data_writer(out)
    files.move(part, final)
    return final


def local_copy(uri: str, name: str) -> str:
    """A path that can be memory-mapped: the shared file itself when the
    folder is mounted, else a copy in the worker's own folder."""
    files, base = shared_files(uri)
    if files.type_name == "local":
        return f"{base}/{name}"
    target = os.path.join(tempfile.gettempdir(), uri.rsplit("/", 1)[1] + "-" + name)
    if not os.path.exists(target):
        with files.open_input_stream(f"{base}/{name}") as src, open(f"{target}.{os.getpid()}", "wb") as out:
            while block := src.read(1 << 20):
                out.write(block)
        os.replace(f"{target}.{os.getpid()}", target)
    return target
