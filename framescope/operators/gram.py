"""Pairwise sums of many columns by blocks (A6, A7, C11 on wide tables).

An expression for every pair of 2,000 columns would be two million sums, so
wide tables are packed into matrices of rows once: a task multiplies them into
partial Gram matrices of ``TILE`` columns by ``TILE`` columns, Spark adds the
partial tiles in a tree of fan-in ``FAN``, and each whole tile gives the
coefficients of its own pairs. No task holds more than ``STATE`` bytes of
tiles (more columns take several reads) and none gets more than ``FAN``
partial copies of a tile.

Where copies of those sums would be more than copies of the rows, the packed
rows are cut into blocks of columns instead, each pair of blocks goes to one
task with all its rows, and the coefficients are ready there. A wide table
that no plan could spell out comes as its cells (:class:`Pivoted`).

Columns are centred on their means first. Those without missing values come
in blocks of their own, whose mask is a single column of ones; the other
blocks carry a mask, and a pair's count, sums and squares are products with
the other block's mask, so that each pair covers the rows where both values
are present.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import check_unique_names, qcol, quoted
from ..session import written

#: Columns of a block, partial tiles added by one task, bytes of a task's
#: tiles, of the rows it multiplies at once and of a packed matrix.
TILE, FAN, STATE, CHUNK, PACK = 128, 32, 256 << 20, 16 << 20, 256 << 10
#: Tasks for each core: every task hands on one copy of all tiles.
WAVES = 3
#: Rows of a tile whose coefficients are handed on at once.
SLICE = 64

_PARTIAL = "tile int, part int, sums binary"
_PAIRS = "column_a string, column_b string, r double"


def _packed_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as doubles (missing is NaN), packed into matrices of whole
    rows and written once: only the packing has a plan as wide as the table.
    The columns leave Spark as fields of a struct, which count against
    ``spark.sql.codegen.maxFields``; an ``array`` of thousands of columns would
    be one generated method, whose compilation fills the driver."""
    width = len(cols)
    step = max(1, PACK // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.column(0).slice(at, step)
                cells = np.empty((len(part), width))
                for i, c in enumerate(part.flatten()):
                    cells[:, i] = c.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"cells": pa.array([cells.tobytes()], pa.binary())})

    fields = ", ".join(f"CAST({quoted(c)} AS DOUBLE) AS _{i}" for i, c in enumerate(cols))  # one call, not several a column
    return written(df.select(F.expr(f"struct({fields})").alias("v")).mapInArrow(pack, "cells binary"), "cells")


class Pivoted:
    """A wide table of numbers as its cells: a row for each value of ``row``, a
    column for each value of ``column`` in their order, what
    ``groupBy(row).pivot(column)`` gives with columns called ``name``, but no
    plan is as wide as the table. ``cells`` has a row a cell, each cell once."""

    def __init__(self, cells: DataFrame, row: str, column: str, value: str, name: str = "{}"):
        self.cells, self.row, self.column, self.value, self.name = cells, row, column, value, name

    def packed(self) -> Packed:
        """The cells are written once; sorted by row and column they fill the
        matrices one row after the other."""
        kept = written(self.cells.select(
            qcol(self.row).alias("_row"), qcol(self.column).alias("_column"),
            F.coalesce(qcol(self.column).cast("string"), F.lit("null")).alias("_key"),
            qcol(self.value).cast("double").alias("_value")), "cells")
        spark = kept.sparkSession
        keys = [r["_key"] for r in kept.select("_column", "_key").distinct().orderBy("_column").collect()]  # one row a column
        names = [self.name.format(k) for k in keys]
        check_unique_names(names, spark.conf.get("spark.sql.caseSensitive") == "true")
        at = spark.createDataFrame(list(enumerate(keys)), "_at int, _key string")
        by_row = Window.partitionBy("_row").orderBy("_at")
        cells = kept.join(F.broadcast(at), "_key").select(
            (F.row_number().over(by_row) == 1).alias("first"), "_at", F.col("_value").alias("value"))
        return Packed(written(cells.mapInArrow(_filler(len(names)), "cells binary"), "cells"), names)


def _filler(width: int) -> Callable:
    """Batches of cells in the order of rows to packed matrices."""
    step = max(1, PACK // (8 * width)) if width else 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"cells": pa.array([x.tobytes()], pa.binary())})

        cells, last = np.full((step, width), np.nan), -1
        for batch in batches:
            first, at, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = last + np.cumsum(first)
            while len(row):
                n = np.searchsorted(row, step)
                cells[row[:n], at[:n]] = value[:n]
                if n == len(row):
                    last = row[-1]
                    break
                yield out(cells)
                cells[:] = np.nan
                row, at, value = row[n:] - step, at[n:], value[n:]
        if last >= 0:
            yield out(cells[:last + 1])

    return fill


class Packed:
    """Rows of many columns for :func:`column_facts` and :func:`pair_frame`."""

    def __init__(self, rows: DataFrame, cols: Sequence[str]):
        self.cols = list(cols)
        self.tasks = WAVES * rows.sparkSession.sparkContext.defaultParallelism
        self.rows = rows.coalesce(self.tasks)

    @classmethod
    def of(cls, df: DataFrame, cols: Sequence[str]) -> Packed:
        return cls(_packed_rows(df, cols), cols)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows as matrices of at most about ``CHUNK`` bytes."""
    held, size = [], 0
    for batch in batches:
        for cells in batch.column(0):
            x = np.frombuffer(cells.as_buffer()).reshape(-1, width)
            if held and size + x.nbytes > CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
            held.append(x)
            size += x.nbytes
    if held:
        yield np.concatenate(held)


def column_facts(packed: Packed) -> tuple[int, dict, dict, dict]:
    """``(rows, non-missing counts, means, varies)`` of the columns (null and
    NaN are missing): one row a task and column crosses the shuffle."""
    cols, width = packed.cols, len(packed.cols)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(width, dtype=np.int64), 0
        total, low, high = np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            for x in _chunks(batches, width):
                there = ~np.isnan(x)
                rows += len(x)
                n += there.sum(0)
                total += np.where(there, x, 0.0).sum(0)
                low = np.minimum(low, np.where(there, x, np.inf).min(0))
                high = np.maximum(high, np.where(there, x, -np.inf).max(0))
        # the last row counts the table's rows
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width + 1), pa.int32()), "n": pa.array(np.append(n, rows)),
            "total": pa.array(np.append(total, 0.0)), "low": pa.array(np.append(low, 0.0)),
            "high": pa.array(np.append(high, 0.0))})

    got = packed.rows.mapInArrow(facts, "i int, n long, total double, low double, high double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    by = {r["i"]: r for r in got.collect()}  # one row a column
    if not by:
        return 0, dict.fromkeys(cols, 0), dict.fromkeys(cols), dict.fromkeys(cols, False)
    own = [by[i] for i in range(width)]
    return (by[width]["n"], {c: r["n"] for c, r in zip(cols, own)},
            {c: r["total"] / r["n"] if r["n"] else None for c, r in zip(cols, own)},
            {c: -math.inf < r["low"] < r["high"] < math.inf for c, r in zip(cols, own)})


def _shapes(a: int, b: int, masked_a: bool, masked_b: bool) -> list[tuple[int, int]]:
    """Shapes of a tile's sums: products, the sums and squares of either
    side over the other's mask, and the counts."""
    ma, mb = (a if masked_a else 1), (b if masked_b else 1)
    return [(a, b), (a, mb), (ma, b), (a, mb), (ma, b), (ma, mb)]


def _cut(flat: np.ndarray, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([r * c for r, c in shapes])
    return [flat[e - r * c:e].reshape(r, c) for e, (r, c) in zip(ends, shapes)]


def _coefficients(sums: list[np.ndarray], constant: float) -> np.ndarray:
    """Pearson r of each pair of a tile, NaN where there is none."""
    products, sa, sb, qa, qb, n = sums
    with np.errstate(all="ignore"):
        cov, va, vb = products - sa * sb / n, qa - sa * sa / n, qb - sb * sb / n
        good = (n > 1) & (va > constant * qa) & (vb > constant * qb)
        return np.where(good, cov / np.sqrt(va * vb), np.nan)


def _added(rows: pd.DataFrame) -> np.ndarray:
    total = np.frombuffer(rows["sums"].iloc[0]).copy()
    with np.errstate(invalid="ignore", over="ignore"):
        for more in rows["sums"].iloc[1:]:
            total += np.frombuffer(more)
    return total


def _side(x: np.ndarray, masked: bool) -> tuple:
    """Values, squares, mask and places of infinities of a block's columns."""
    there, endless = ~np.isnan(x), np.isinf(x)
    mask = there.astype(float) if masked else np.ones((len(x), 1))
    values = np.where(there & ~endless, x, 0.0)
    return values, values * values, mask, endless.astype(float) if endless.any() else None


def _multiply(sums: list[np.ndarray], one: tuple, other: tuple) -> None:
    """Adds two blocks' products over some rows to a tile's sums."""
    (a, a2, ma, ia), (b, b2, mb, ib) = one, other
    for s, (left, right) in zip(sums, ((a, b), (a, mb), (ma, b), (a2, mb), (ma, b2), (ma, mb))):
        s += left.T @ right
    # a pair with an infinite value on its rows has no coefficient
    if ia is not None:
        sums[0][np.broadcast_to(ia.T @ mb > 0, sums[0].shape)] = np.nan
    if ib is not None:
        sums[0][np.broadcast_to(ma.T @ ib > 0, sums[0].shape)] = np.nan


def _multiplier(blocks: list[np.ndarray], masked: list[bool], tiles: list[tuple[int, int]], first: int,
                mean: np.ndarray, width: int, own_columns: np.ndarray) -> Callable:
    """Batches of packed rows to this task's sums of the given tiles, whose
    blocks number the ``own_columns`` of the ``width`` packed ones."""
    shapes = [_shapes(len(blocks[i]), len(blocks[j]), masked[i], masked[j]) for i, j in tiles]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [np.zeros(sum(r * c for r, c in s)) for s in shapes]
        needed = sorted({k for t in tiles for k in t})
        with np.errstate(invalid="ignore", over="ignore"):
            for x in _chunks(batches, width):
                x = x[:, own_columns] - mean
                sides = {k: _side(x[:, blocks[k]], masked[k]) for k in needed}
                for (i, j), flat, shape in zip(tiles, state, shapes):
                    _multiply(_cut(flat, shape), sides[i], sides[j])
        part = TaskContext.get().partitionId()
        for k, flat in enumerate(state, first):
            yield pa.RecordBatch.from_pydict({"tile": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "sums": pa.array([flat.tobytes()], pa.binary())})

    return multiply


def _passes(tiles: list[tuple[int, int]], sizes: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Runs of tiles whose sums fit in ``STATE`` bytes, with their start."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > STATE:
            yield start, tiles[start:k]
            start, held = k, 0
        held += size
    yield start, tiles[start:]


def _blocks(whole: np.ndarray, size: int) -> tuple[list[np.ndarray], list[bool], list[tuple[int, int]]]:
    """Blocks of at most ``size`` columns, which of them have masks, and the
    pairs of blocks. Columns without missing values are apart."""
    at = np.arange(len(whole))
    blocks, masked = [], []
    for own, holes in ((at[whole], False), (at[~whole], True)):
        blocks += [own[k:k + size] for k in range(0, len(own), size)]
        masked += [holes] * (len(blocks) - len(masked))
    return blocks, masked, [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]


def _pairs_of(i: int, j: int, blocks: list[np.ndarray], sums: list[np.ndarray], constant: float,
              least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and coefficients of the pairs of a tile, some rows at a time."""
    a, b = blocks[i], blocks[j]
    for k in range(0, len(a), SLICE):
        some = a[k:k + SLICE, None]
        r = _coefficients([x if len(x) == 1 else x[k:k + SLICE] for x in sums], constant)
        keep = some < b if i == j else np.ones(r.shape, dtype=bool)
        if least is not None:
            keep = keep & (np.abs(r) >= least)
        yield np.minimum(some, b)[keep], np.maximum(some, b)[keep], r[keep]


def _encoded(x: np.ndarray) -> bytes:
    """A matrix as bits of the values that are there, and those values."""
    there = ~np.isnan(x)
    return np.packbits(there).tobytes() + x[there].tobytes()


def _decoded(cells: memoryview, rows: int, width: int) -> np.ndarray:
    size = rows * width
    there = np.unpackbits(np.frombuffer(cells, np.uint8, -(-size // 8)), count=size).view(bool)
    x = np.full(size, np.nan)
    x[there] = np.frombuffer(cells, offset=-(-size // 8))
    return x.reshape(rows, width)


def _slicer(blocks: list[np.ndarray], mean: np.ndarray, width: int, own_columns: np.ndarray) -> Callable:
    """Batches of packed rows to centred pieces of blocks; pieces with the same
    number hold the same rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = TaskContext.get().partitionId() << 33
        for piece, x in enumerate(_chunks(batches, width), begin):
            with np.errstate(invalid="ignore", over="ignore"):
                x = x[:, own_columns] - mean
            for k, own in enumerate(blocks):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int64()),
                    "n": pa.array([len(x)], pa.int32()), "cells": pa.array([_encoded(x[:, own])], pa.binary())})

    return cut


def _finisher(blocks: list[np.ndarray], masked: list[bool], tiles: list[tuple[int, int]], names: Sequence[str],
              constant: float, least: float | None) -> Callable:
    """Pieces of blocks, sorted by tile, piece and block, to the tiles' pairs."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        called = pa.array(names, pa.string())
        tile, sums, held = None, [], {}

        def add() -> None:
            i, j = tiles[tile]
            with np.errstate(invalid="ignore", over="ignore"):
                sides = {k: _side(np.concatenate(held.pop(k)), masked[k]) for k in {i, j}}
                _multiply(sums, sides[i], sides[j])

        def pairs() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            for a, b, r in _pairs_of(*tiles[tile], blocks, sums, constant, least):
                yield pa.RecordBatch.from_pydict({"column_a": called.take(pa.array(a)), "column_b": called.take(pa.array(b)),
                                                  "r": pa.array(r)})

        for batch in batches:
            for t, k, n, cells in zip(*(batch.column(c) for c in range(4))):
                if t.as_py() != tile:
                    if tile is not None:
                        yield from pairs()
                    tile, size = t.as_py(), 0
                    i, j = tiles[tile]
                    sums = [np.zeros(x) for x in _shapes(len(blocks[i]), len(blocks[j]), masked[i], masked[j])]
                k, n = k.as_py(), n.as_py()
                x = _decoded(cells.as_buffer(), n, len(blocks[k]))
                # the tile's last block ends a piece: both have the same rows now
                held.setdefault(k, []).append(x)
                size += x.nbytes
                if k == tiles[tile][1] and size >= CHUNK:
                    add()
                    size = 0
        if tile is not None:
            yield from pairs()

    return finish


def pair_frame(packed: Packed, cols: Sequence[str], facts: tuple, constant: float,
               least: float | None = None) -> DataFrame:
    """``column_a, column_b, r`` for each pair of two or more packed columns, in
    the order of ``cols`` (null and NaN are missing); r is null where a pair has
    fewer than two rows, a side without spread or an infinite value. A table
    without rows gives no pairs. With ``least``, pairs whose r is null or
    nearer to 0 are left out."""
    n_rows, nn, mean, _ = facts
    whole = np.array([nn[c] == n_rows for c in cols])
    shift = np.array([mean[c] if mean[c] is not None and math.isfinite(mean[c]) else 0.0 for c in cols])
    place = {c: i for i, c in enumerate(packed.cols)}
    own_columns = np.array([place[c] for c in cols])
    blocks, masked, tiles = _blocks(whole, TILE)
    shape = [_shapes(len(blocks[i]), len(blocks[j]), masked[i], masked[j]) for i, j in tiles]
    sizes = [8 * sum(r * c for r, c in s) for s in shape]
    # tiles of half the state, the other half is for the rows; one a task at least
    side = max(1, min(math.isqrt(STATE // 2 // 48), -(-len(cols) // math.ceil(math.sqrt(2 * packed.tasks)))))
    copies = 8 * sum(nn[c] for c in cols) * -(-len(cols) // side)
    if sum(sizes) > STATE and copies < packed.tasks * sum(sizes):
        out = _by_columns(packed, cols, _blocks(whole, side), shift, own_columns, constant, least)
    else:
        out = _by_rows(packed, cols, (blocks, masked, tiles), shape, sizes, shift, own_columns, constant, least)
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def _by_columns(packed: Packed, cols: Sequence[str], layout: tuple, shift: np.ndarray, own_columns: np.ndarray,
                constant: float, least: float | None) -> DataFrame:
    """Each pair of blocks meets in one task, a few rows at a time."""
    blocks, masked, tiles = layout
    pieces = packed.rows.mapInArrow(_slicer(blocks, shift, len(packed.cols), own_columns),
                                    "block int, piece long, n int, cells binary")
    of = packed.rows.sparkSession.createDataFrame(
        [(t, k) for t, tile in enumerate(tiles) for k in sorted(set(tile))], "tile int, block int")
    # the list of tiles is bounded by the schema
    dealt = pieces.join(F.broadcast(of), "block").repartition(len(tiles), "tile").sortWithinPartitions(
        "tile", "piece", "block").select("tile", "block", "n", "cells")
    return dealt.mapInArrow(_finisher(blocks, masked, tiles, cols, constant, least), _PAIRS)


def _by_rows(packed: Packed, cols: Sequence[str], layout: tuple, shape: list, sizes: list[int], shift: np.ndarray,
             own_columns: np.ndarray, constant: float, least: float | None) -> DataFrame:
    """Each task multiplies its rows into all tiles, which are added in a tree."""
    blocks, masked, tiles = layout
    names, width = np.array(cols, dtype=object), len(packed.cols)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": [key[0]], "part": [key[1]], "sums": [_added(rows).tobytes()]})

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sums = _cut(_added(rows), shape[key[0]])
        a, b, r = (np.concatenate(x) for x in zip(*_pairs_of(*tiles[key[0]], blocks, sums, constant, least)))
        return pd.DataFrame({"column_a": names[a], "column_b": names[b], "r": r})

    out = None
    for first, some in _passes(tiles, sizes):
        sums = packed.rows.mapInArrow(_multiplier(blocks, masked, some, first, shift, width, own_columns), _PARTIAL)
        left = packed.tasks
        while left > FAN:
            sums = sums.groupBy("tile", F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(add, _PARTIAL)
            left = -(-left // FAN)
        pairs = sums.groupBy("tile").applyInPandas(finish, _PAIRS)
        out = pairs if out is None else out.unionByName(pairs)
    return out
