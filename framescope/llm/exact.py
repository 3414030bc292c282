"""Exact duplicates by Grace hash deduplication.

Texts are equal when they are identical after lower-casing A-Z. Three passes:

1. **Combine** (:func:`combined`): each task keeps an open-addressing table of
   the texts it reads and writes each different text once, with the ids of its
   rows. A text that a third of all rows repeat leaves every task as one row.
2. **Buckets** (:func:`classes`): these rows are dealt by hash to as many
   buckets as their bytes ask for. A bucket fills an open-addressing table that
   compares hashes first and then every byte. One whose different texts take
   more than ``CONTENT`` bytes is cut by another hash into ``FAN`` spill files
   in the shared folder, and each of them is a bucket again, until they fit. A
   bucket keeps one copy of a text and a number for each row of pass 1.
3. **Rows** (:func:`deduplicated`): the classes meet the ids of pass 1 on the
   row number, so a large class is as many small rows as tasks held it.

Defined results: a null text equals an empty one; a null id is below every
other; of rows that tie on the largest id one stays (the first of its task's
rows, the lowest task first); repeated rows count one by one; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import bounded_batches, shared_files, shared_folder, written

#: Bytes of different texts that one table holds (more is cut again).
CONTENT = 64 << 20
#: Bytes of text dealt to a bucket, about.
BUCKET = 32 << 20
#: Spill files that a bucket is cut into.
FAN = 16
#: Ids that one row of pass 1 carries at most, and bytes of an Arrow batch.
IDS, BATCH = 500_000, 4 << 20

RECORD = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("rep", pa.list_(pa.int64())),
                    ("n", pa.list_(pa.int64())), ("top", pa.list_(pa.int64()))])
LOCAL = pa.schema([("h", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("ids", pa.list_(pa.int64()))])
CLASS = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keeper", pa.bool_()),
                   ("text_sha256", pa.string())])


class ContentTable:
    """Open addressing with linear probing over whole contents."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        """Number of the content's class; a new content gets the next one."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        self.slots[at] = k = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased (``bytes.lower`` is ASCII's)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def content_hash(content: bytes, seed: int = 0) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(content, seed)
    return h - (1 << 64) if h >> 63 else h


def batched(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``BATCH`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _combine(limit: int):
    """Rows (id, text) to one row for each different text of the task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table, ids, held = ContentTable(), [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = normalised(text.as_py())
                k = table.place(content_hash(content), content)
                if k == len(ids):
                    ids.append([])
                ids[k].append(i)
                held += 1
                if table.bytes > limit or held >= IDS:
                    yield from ((h, len(c), c, x) for h, c, x in zip(table.hashes, table.contents, ids))
                    table, ids, held = ContentTable(), [], 0
        yield from ((h, len(c), c, x) for h, c, x in zip(table.hashes, table.contents, ids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), LOCAL, lambda r: r[1] + 8 * len(r[3]) + 32)

    return task


def combined(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Different texts of each task, once each: ``h``, ``size``, ``content``,
    ``ids`` and the row's number ``rep``, written."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = rows.mapInArrow(_combine(limit or CONTENT), "h long, size long, content binary, ids array<long>")
    with bounded_batches(documents.sparkSession):
        return written(local.withColumn("rep", F.monotonically_increasing_id()), "texts")


def _spilled(records: Iterator[tuple], folder: str, depth: int) -> list[str]:
    """Records cut by another hash into ``FAN`` files of the shared folder."""
    files, base = shared_files(folder)
    files.create_dir(base, recursive=True)
    names = [f"{base}/{uuid.uuid4().hex}-{depth}-{i}" for i in range(FAN)]
    outs = [files.open_output_stream(name) for name in names]
    writers = [pa.ipc.new_stream(out, RECORD) for out in outs]
    held: list[list[tuple]] = [[] for _ in names]
    weight = [0] * FAN

    def put(i: int) -> None:
        if held[i]:
            for batch in batched(held[i], RECORD, lambda r: len(r[1])):
                writers[i].write_batch(batch)
        held[i], weight[i] = [], 0

    for record in records:
        i = xxhash.xxh3_64_intdigest(record[1], depth + 1) % FAN
        held[i].append(record)
        weight[i] += len(record[1])
        if weight[i] >= BATCH // FAN:
            put(i)
    for i in range(FAN):
        put(i)
        writers[i].close()
        outs[i].close()
    return names


def _reread(folder: str, name: str) -> Iterator[tuple]:
    files, _ = shared_files(folder)
    with files.open_input_stream(name) as source, pa.ipc.open_stream(source) as stream:
        for batch in stream:
            yield from zip(*(c.to_pylist() for c in batch.columns))


def grace(records: Iterator[tuple], limit: int, folder: str, depth: int = 0) -> Iterator[tuple]:
    """Records (hash, content, row numbers, counts, largest ids) to a row
    (number, id that stays, class size, holds the row that stays, SHA-256) for
    each row number. Records whose different contents take more than ``limit``
    bytes are cut into spill files, each a bucket of its own; a bucket of one
    content is never cut."""
    table, reps, counts, tops = ContentTable(), [], [], []
    for h, content, rep, n, top in records:
        k = table.place(h, content)
        if k == len(reps):
            reps.append([])
            counts.append([])
            tops.append([])
        reps[k] += rep
        counts[k] += n
        tops[k] += top
        if table.bytes > limit and len(reps) > 1:
            break
    else:
        for content, rep, n, top in zip(table.contents, reps, counts, tops):
            sha, size = hashlib.sha256(content).hexdigest(), sum(n)
            keep = max((t for t in top if t is not None), default=None)
            keeper = min(r for r, t in zip(rep, top) if t == keep)
            yield from ((r, keep, size, r == keeper, sha) for r in rep)
        return

    def again() -> Iterator[tuple]:
        yield from zip(table.hashes, table.contents, reps, counts, tops)
        yield from records

    names = _spilled(again(), folder, depth)
    del table, reps, counts, tops
    files, _ = shared_files(folder)
    for name in names:
        yield from grace(_reread(folder, name), limit, folder, depth + 1)
        files.delete_file(name)


def classes(local: DataFrame, limit: int | None = None) -> DataFrame:
    """The class of every row of pass 1: ``rep``, ``keep_id``, ``group_size``,
    ``keeper`` (it holds the row that stays) and ``text_sha256``, written."""
    spark = local.sparkSession
    limit, folder = limit or CONTENT, shared_folder(spark, "spill")
    total = local.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((h.as_py(), c.as_py(), [r.as_py()], [n.as_py()], [t.as_py()])
                   for b in batches for h, c, r, n, t in zip(*b.columns))
        return batched(grace(records, limit, folder), CLASS, lambda r: 128)

    rows = local.select("h", "content", "rep", F.size("ids").cast("long").alias("n"), F.array_max("ids").alias("top"))
    with bounded_batches(spark):
        return written(rows.repartition(buckets, "h").mapInArrow(
            task, "rep long, keep_id long, group_size long, keeper boolean, text_sha256 string"), "classes")


def deduplicated(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each document: ``doc_id``, ``keep_id`` (of the row of its
    class that stays), ``group_size``, ``kept`` and ``text_sha256`` (of the
    normalised text)."""
    local = combined(documents, limit)
    joined = local.select("rep", "ids").join(classes(local, limit), "rep")
    first = F.coalesce(F.array_position("ids", F.col("keep_id")), F.lit(1)) - 1
    rows = joined.select("keep_id", "group_size", "keeper", "text_sha256", first.alias("first"),
                         F.posexplode("ids").alias("place", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("place") == F.col("first"))).alias("kept"),
                       "text_sha256")


def keep_distinct(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents whose row stays, all columns; ids must be distinct and
    not null (rows that share an id share their fate)."""
    kept = deduplicated(documents, limit).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return documents.join(kept, documents["doc_id"] == kept["_kept_id"], "left_semi")
