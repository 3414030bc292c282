"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into three segments of 22, 21 and 21 bits, each
a word of the perfect binary Golay code [23, 12, 7] (padded with zeros). A
word's *nearest* codeword is at most 3 bits away; its *near* codewords are
the one or six at most 4 bits away. Words that differ in 1 bit: the nearest
codeword of either is near the other. Words that differ in up to 2 bits
share a near codeword (the differences of the six cover all 23 places).

Fingerprints with at most 4 differing bits spread a <= b <= c errors over the
segments, so either a = 0 and b <= 2: some segment is equal and another
shares a near codeword; or a = b = 1: in two segments a nearest codeword of
one is near the other. The keys are therefore (segment, near codeword of
another) for all ordered pairs, and (near, near) for all pairs, of which only
(nearest, nearest) starts a comparison. Equal fingerprints are one row
before, so exact copies cost nothing, and every candidate's bits are counted.

Rows of a key are compared where they were sorted to; a key with more than
``HOT`` rows is cut into blocks, and pairs of blocks go to tasks of their
own. Tasks report spanning trees, not pairs; components come from large-star
and small-star rounds in Spark.

Defined cases: null and wordless texts have fingerprint zero; a component's
id is its smallest doc_id that is not null (null if it has none); repeated
rows count each, and one of them stays; other columns are ignored by
``components`` and kept by ``keep_one``."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import small_batches, text_key, written

SHINGLE, BITS = 4, 4
SEED = 42
WIDTHS = (22, 21, 21)
#: Rows of one key that are compared in the task they were sorted to.
HOT, BLOCK = 16_384, 4_096
PAIRS = 2_000_000
LINKED = 500_000

# Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLYNOMIAL = 0b101011100011


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    for i in range(22, 10, -1):
        word = np.where((word >> i) & 1, word ^ (POLYNOMIAL << (i - 11)), word)
    return word


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the error patterns of at most 4 bits, lightest first,
    and how many there are."""
    table, n = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for k in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), k)], dtype=np.int64)
        for e, r in zip(errors.tolist(), _remainder(errors).tolist()):
            table[r, n[r]] = e
            n[r] += 1
    return table, n


PATTERNS, NEAR = _patterns()


def near_codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the near codewords, nearest first, and a mask of
    the valid ones; both of shape (n, 6)."""
    r = _remainder(word)
    return (word[:, None] ^ PATTERNS[r]) >> 11, np.arange(6) < NEAR[r][:, None]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, row, starts)`` arrays of all keys of uint64 fingerprints."""
    parts, at = [], 0
    for w in WIDTHS:
        parts.append(((prints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    near = [near_codewords(p) for p in parts]
    out_key, out_row, out_start = [], [], []
    rows = np.arange(len(prints))

    def add(key: np.ndarray, valid: np.ndarray, starts: np.ndarray) -> None:
        out_key.append(key[valid])
        out_row.append(np.broadcast_to(rows.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[valid])
        out_start.append(np.broadcast_to(starts, key.shape)[valid])

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add((tag << 40) | (parts[i][:, None] << 12) | near[j][0], near[j][1], np.array(True))
                tag += 1
    first = np.arange(6) == 0
    for i, j in combinations(range(3), 2):
        key = (tag << 40) | (near[i][0][:, :, None] << 12) | near[j][0][:, None, :]
        add(key, near[i][1][:, :, None] & near[j][1][:, None, :], first[:, None] & first[None, :])
        tag += 1
    return np.concatenate(out_key), np.concatenate(out_row), np.concatenate(out_start)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED)
                  for a, b in zip((end - size)[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i:i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint column (its 64 bits as a signed bigint)."""
    @F.pandas_udf(T.LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return of(text)


class _Trees:
    """Union-find over the links that one task has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def edges(self) -> pd.DataFrame:
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        return pd.DataFrame({"a": np.array([p[0] for p in pairs], dtype=np.int64),
                             "b": np.array([p[1] for p in pairs], dtype=np.int64)})


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def _compare(key: np.ndarray, prints: np.ndarray, starts: np.ndarray, bits: int, trees: _Trees) -> None:
    """Link the close pairs of rows sorted by key, starting rows first: each
    starting row is compared with the later rows of its key."""
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    first = np.flatnonzero(starts)
    after = ends[np.searchsorted(ends, first, side="right")] - first - 1
    first, after = first[after > 0], after[after > 0]
    done = 0
    total = np.cumsum(after)
    while done < len(first):
        base = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        n = after[done:stop]
        left = np.repeat(first[done:stop], n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = _close(prints[left], prints[right], bits)
        if ok.any():
            trees.link(prints[left[ok]], prints[right[ok]])
        done = stop


_FOUND = "a long, b long, left binary, right binary, starting int"


def _searcher(bits: int, hot: int, block: int):
    """Search a sorted stream of ``key, fp, starts`` rows: yields links, and
    the pairs of blocks of keys too large for one task."""
    def blocks(prints: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        prints, starts = prints[np.argsort(~starts, kind="stable")], np.sort(starts)[::-1]
        for i in range(0, len(prints), block):
            if not starts[i]:
                return  # no starting row from here on
            for j in range(i, len(prints), block):
                yield pd.DataFrame({"a": [None], "b": [None], "left": [prints[i:i + block].tobytes()],
                                    "right": [prints[j:j + block].tobytes()],
                                    "starting": [int(starts[i:i + block].sum())]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _Trees()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def finish(parts) -> Iterator[pd.DataFrame]:
            nonlocal trees
            key, prints, starts = (np.concatenate(x) for x in zip(*parts))
            if len(key) > hot and key[0] == key[-1]:
                yield from blocks(prints, starts)
                return
            _compare(key, prints, starts, bits, trees)
            if len(trees.parent) > LINKED:
                yield trees.edges().assign(left=None, right=None, starting=None)
                trees = _Trees()

        for b in batches:
            key, prints, starts = b["key"].to_numpy(), b["fp"].to_numpy(), b["starts"].to_numpy().astype(bool)
            while len(key):
                if held and held[0][0][0] != key[0]:
                    yield from finish(held)
                    held = []
                # whole keys are compared at once; the last may go on in the next batch
                cut = int(np.searchsorted(key, key[-1]))
                if cut == 0:
                    held.append((key, prints, starts))
                    break
                if held:
                    same = int(np.searchsorted(key, key[0], side="right"))
                    held.append((key[:same], prints[:same], starts[:same]))
                    yield from finish(held)
                    held, key, prints, starts = [], key[same:], prints[same:], starts[same:]
                    continue
                yield from finish([(key[:cut], prints[:cut], starts[:cut])])
                key, prints, starts = key[cut:], prints[cut:], starts[cut:]
        if held:
            yield from finish(held)
        if trees.parent:
            yield trees.edges().assign(left=None, right=None, starting=None)

    return search


def _compare_blocks(bits: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left, right, n in zip(b["left"], b["right"], b["starting"]):
                x, y = np.frombuffer(left, dtype=np.int64)[:int(n)], np.frombuffer(right, dtype=np.int64)
                trees = _Trees()
                for i in range(0, len(x), 128):
                    at, to = np.nonzero(_close(x[i:i + 128, None], y[None, :], bits))
                    apart = x[i + at] != y[to]
                    trees.link(x[i + at[apart]], y[to[apart]])
                yield trees.edges()

    return compare


def links(prints: DataFrame, bits: int = BITS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` exactly
    as all pairs within ``bits`` differing bits (at most 4) would."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find fingerprints with at most 4 differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["fp"].to_numpy()
            for i in range(0, len(own), 2000):
                part = own[i:i + 2000]
                key, row, starts = keys(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part[row], "starts": starts})

    dealt = (prints.select("fp").mapInPandas(keyed, "key long, fp long, starts boolean").repartition("key")
             .sortWithinPartitions("key", F.desc("starts")))
    found = written(dealt.mapInPandas(_searcher(bits, hot, block), _FOUND), "simhash-links")
    edges = found.where("left IS NULL").select("a", "b")
    pairs = found.where("left IS NOT NULL").select("left", "right", "starting")
    n = pairs.count()
    if n:
        more = pairs.repartition(min(n, 10_000)).mapInPandas(_compare_blocks(bits), "a long, b long")
        edges = edges.unionAll(written(more, "simhash-blocks"))
    return edges.distinct()


def star_rounds(edges: DataFrame) -> DataFrame:
    """``a, root`` for every linked fingerprint that is not its component's
    smallest one (``root``): large-star and small-star until nothing changes."""
    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "star")
    state = mark(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that both sides of the join are plain exchanges: a hub's many edges can be split
        least = written(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "star-least")
        large = (both.join(least, F.col("a") == F.col("u")).where("b > a")
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct())
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        now = written(small.select("a", F.col("m").alias("b"))
                      .unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(),
                      "star")
        if (after := mark(now)) == state:
            break
        state = after
    return now.select("a", F.col("b").alias("root"))


def components(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id, tk, fp, root, component_id`` of every document row: the
    text's key, its fingerprint, its component's smallest fingerprint and
    smallest doc_id."""
    spark = documents.sparkSession
    small_batches(spark)
    table = written(documents.select("doc_id", text_key(F.col("text")).alias("tk"),
                                     fingerprint_of(F.col("text"), shingle).alias("fp")), "simhash")
    prints = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    small_batches(spark, 20_000)
    roots = star_rounds(links(prints, bits))
    small_batches(spark)
    rooted = prints.join(roots, prints["fp"] == roots["a"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    rooted = written(rooted, "simhash-rooted")
    least = rooted.where("linked").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("m"))
    ids = least.join(prints, F.col("r") == F.col("fp")).select("r", F.least("m", "least").alias("id"))
    named = rooted.join(ids, F.col("root") == F.col("r"), "left").select(
        F.col("fp").alias("f"), "root", F.coalesce("id", "least").alias("component_id"))
    return table.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "tk", "fp", "root", "component_id")


def scored(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document row."""
    return components(documents, shingle, bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each component (the smallest doc_id, then text key),
    columns unchanged."""
    groups = components(documents, shingle, bits)
    kept = written(groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("k"))
        .select(F.col("k.doc_id").alias("_keep_doc"), F.col("k.tk").alias("_keep_key")), "simhash-kept")
    rows = documents.join(kept, documents["doc_id"].eqNullSafe(kept["_keep_doc"])
                          & text_key(documents["text"]).eqNullSafe(kept["_keep_key"]), "left_semi")
    if rows.groupBy("doc_id", text_key(F.col("text"))).count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "text"])
    return rows
