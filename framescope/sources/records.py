"""CSV records of files whose quoted fields span lines, read in parallel.

A line break ends a record exactly if an even number of quotes lies before it in
its file (a doubled quote counts twice). So the quotes of every byte range are
counted first, modulo 2, and a prefix sum over the ranges of a file says whether a
range begins inside a quoted field. Then every range puts its lines together on its
own; only a record that crosses ranges is joined from its pieces, at most two a
range.

This holds for files that quote as RFC 4180 says. Each record is checked for that;
a file with quotes elsewhere, lone carriage returns or mixed line ends is left to
the sequential reader (``None``), whose rules decide there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
WELL_FORMED = re.compile(rf"{_FIELD}(?:,{_FIELD})*")
#: Pieces of records that cross ranges: the end of one, all of a range, the start of one.
WHOLE, HEADER, END, MIDDLE, START = range(5)
#: Byte ranges up to which their parities are sent to every task.
RANGES = 1_000_000


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines with the byte range they come from, in order within a range."""
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), value.alias("value"))


def open_ranges(lines: DataFrame) -> dict[tuple[str, int, int], bool] | None:
    """For each byte range whether it begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start", "length").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("odd", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0))).limit(RANGES + 1).collect()
    return {(r["file"], r["start"], r["length"]): r["odd"] == 1 for r in rows} if len(rows) <= RANGES else None


def _pieces(begins_open: dict[tuple[str, int, int], bool]):
    """Lines to records and pieces: ``file, start, kind, record, fits, cr``."""
    def range_pieces(lines: Iterator[str], start: int, inside: bool) -> Iterator[tuple[int, str]]:
        held, first, kind = [], start == 0, MIDDLE if inside else START
        for line in lines:
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                record = "\n".join(held)
                yield (END if kind == MIDDLE else HEADER if first else WHOLE), record
                held, first, kind = [], False, START
        if held:
            yield kind, "\n".join(held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[tuple[str, int, int], str]]:
            for batch in batches:
                file, start, length, value = (c.to_pylist() for c in batch.columns)
                yield from zip(zip(file, start, length), value)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 4
            types = (pa.string(), pa.int64(), pa.int32(), pa.string())
            file, start, kind, record = (pa.array(c, t) for c, t in zip(columns, types))
            fits = [fitting(r) for r in record.to_pylist()]
            return pa.RecordBatch.from_arrays([file, start, kind, record, pa.array([f for f, _ in fits], pa.bool_()),
                                               pa.array([c for _, c in fits], pa.bool_())],
                                              names=["file", "start", "kind", "record", "fits", "cr"])

        lines, rows, size = runs(), [], 0
        following = next(lines, None)
        while following is not None:
            at = following[0]
            if at not in begins_open:
                raise RuntimeError("byte ranges changed between two reads of a file")

            def own() -> Iterator[str]:
                nonlocal following
                while following is not None and following[0] == at:
                    yield following[1]
                    following = next(lines, None)

            for kind, record in range_pieces(own(), at[1], begins_open[at]):
                rows.append((at[0], at[1], kind, record))
                size += len(record)
                if size > 1 << 22:
                    yield emit(rows)
                    rows, size = [], 0
        yield emit(rows)

    return task


def fitting(record: str) -> tuple[bool, bool]:
    """Whether a record is quoted by the rules, and ends with a carriage
    return (of its line end)."""
    cr = record.endswith("\r")
    body = record[:-1] if cr else record
    return ('"' not in body and "\r" not in body) or WELL_FORMED.fullmatch(body) is not None, cr


def csv_records(spark: SparkSession, path: str, encoding: str) -> DataFrame | None:
    """One row ``record`` for each record after its file's header, written; or
    ``None`` where only a sequential reader can tell the records apart."""
    lines = _lines(spark, path, encoding)
    begins_open = open_ranges(lines)
    if begins_open is None:
        return None
    pieces = written(lines.mapInArrow(_pieces(begins_open), "file string, start long, kind int, record string, fits boolean, cr boolean"),
                     "records")
    torn = pieces.where(F.col("kind") >= END)
    # a START opens a record; MIDDLE ranges and one END follow it
    number = F.sum((F.col("kind") == START).cast("long")).over(
        Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    joined = torn.withColumn("number", number).groupBy("file", "number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.max((F.col("kind") == END).cast("int")).alias("ended"), F.min((F.col("start") == 0).cast("int")).alias("header"))
    checked = joined.withColumn("kind", F.lit(WHOLE)).withColumn("cr", F.endswith("record", F.lit("\r")))
    body = F.when(F.col("cr"), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    checked = checked.withColumn("fits", (F.col("ended") == 1) & body.rlike(f"\\A{WELL_FORMED.pattern}\\z"))
    whole = pieces.where(F.col("kind") < END).select("kind", "record", "fits", "cr").unionByName(
        checked.select("kind", "record", "fits", "cr"))
    files = {file for file, _, _ in begins_open}
    facts = whole.where(F.col("record") != "").agg(
        F.count_if(~F.col("fits")).alias("odd"), F.count_if("cr").alias("cr"), F.count_if(~F.col("cr")).alias("plain"),
        F.count_if(F.col("kind") == HEADER).alias("headers")).first()
    mixed = facts["cr"] and facts["plain"] > len(files)  # a file's last line may have no end
    if facts["odd"] or mixed or facts["headers"] != len(files):
        return None
    if facts["cr"]:  # the file's line end is a line feed inside fields, too
        body = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    return whole.where((F.col("kind") == WHOLE) & ~F.col("record").isin("", "\r")).select(body.alias("record"))
