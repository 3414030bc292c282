"""Interpolated modified Kneser-Ney bigram model as sorted hash arrays.

Training. Tasks hash the words of the training texts and sum their bigrams
(context, word) in batches; Spark deals these partial counts out by shard (a
range of the context's hash), and each shard's task writes sorted arrays to
the shared folder: bigram hash with count, and context hash with its total
and its numbers of words seen once, twice and more. A second shuffle gives
each word the number of contexts before it (the continuation counts of the
lower order). Contexts so frequent that they would fill a shard (at most half
as many as there are shards) are dealt out by the whole bigram instead, and
their statistics are summed in that second shuffle.

Scoring. Workers memory-map the arrays and look up sorted unique hashes:

    p(w|h) = (max(c(hw) - D(c), 0) + G(h) p1(w)) / c(h),   p1(w) if h is new
    p1(w)  = (max(k(w) - D1(k), 0) + G1 / (V + 1)) / K

with c the counts, k the continuation counts, K their sum, V the distinct
tokens, D the discounts of the order for counts of one, two and more (from
the counts of counts), and G the discounted mass.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; every text ends with
an end token and is preceded by a start context. Hashes have 64 bits.
Defined cases: null texts count as empty (one token, the end); repeated rows
count each; without training rows every token has probability 1 / (V + 1);
a null doc_id is held out by the rule for empty text; other columns are
ignored."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import local_copy, lower_ascii, put_file, remainder, shared_files, shared_folder, small_batches, space_words, written

#: Bytes of text that a shard's counts come from, about.
SHARD_BYTES = 12_000_000
#: Tokens that a task counts before it hands them on.
FLUSH = 2_000_000
#: Documents looked at to find the frequent contexts (which only decides how
#: counts are dealt out, not what they are).
LOOK = 2_000

START, END = (np.uint64(xxhash.xxh64_intdigest(s)) for s in (b" start", b" end"))  # no word has a space
BIGRAM = np.dtype("<u4")
CONTEXT = np.dtype([("total", "<i8"), ("n", "<u4", 3), ("pad", "<u4")])
WORD = np.dtype("<u4")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and its end."""
    words = (text or "").encode("utf-8").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def contexts(w: np.ndarray) -> np.ndarray:
    """The token before each token of one text."""
    out = np.empty_like(w)
    out[0], out[1:] = START, w[:-1]
    return out


def bigram(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of each (context, word) pair."""
    x = ctx * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes have sorted shards."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _dealt(ctx: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each bigram: by context, or by the pair for hot contexts."""
    return shard_of(np.where(np.isin(ctx, hot), pair, ctx), shards)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a row of each, and the sums of n."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], order[first], np.add.reduceat(n[order], first) if len(k) else n[:0]


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes by significance, which packs well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _pack(sorted_key: np.ndarray, *others: np.ndarray) -> bytes:
    """Arrays of one length; the first is sorted and kept as differences."""
    step = np.diff(sorted_key, prepend=np.uint64(0))
    body = b"".join(_planes(np.ascontiguousarray(a)) for a in (step, *others))
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(t).itemsize for t in ("<u8", *types)]
    n, at, out = len(raw) // sum(sizes), 0, []
    for t, size in zip(("<u8", *types), sizes):
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _joined(blobs, *types: str) -> list[np.ndarray]:
    parts = [_unpack(b, *types) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts)]


def _counter(hot: np.ndarray, shards: int, flush: int):
    """Texts to partial bigram counts by shard."""
    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        ctx, w = (np.concatenate(x) for x in zip(*held))
        _, at, n = _summed(bigram(ctx, w), np.ones(len(w), dtype=np.uint32))
        ctx, w, n = ctx[at], w[at], n.astype("<u4")
        to = _dealt(ctx, bigram(ctx, w), hot, shards)
        order = np.lexsort((ctx, to))
        ctx, w, n, to = ctx[order], w[order], n[order], to[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        yield pd.DataFrame({"shard": to[cuts[:-1]], "blob": [_pack(ctx[a:b], w[a:b], n[a:b])
                                                             for a, b in zip(cuts, cuts[1:])]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for t in b["text"]:
                w = tokens(t)
                held.append((contexts(w), w))
                size += len(w)
                if size >= flush:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return count


def _file(out, keys: np.ndarray, values: np.ndarray) -> None:
    out.write(np.ascontiguousarray(keys, dtype="<u8").tobytes())
    out.write(np.ascontiguousarray(values).tobytes())


_BUILT = "kind string, shard long, blob binary, stat array<long>"


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _contexts_of(ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of distinct bigrams, and their statistics."""
    keys, _, total = _summed(ctx, n.astype(np.int64))
    stats = np.zeros(len(keys), dtype=CONTEXT)
    stats["total"] = total
    at = np.searchsorted(keys, ctx)
    for i, seen in enumerate((n == 1, n == 2, n >= 3)):
        stats["n"][:, i] = np.bincount(at[seen], minlength=len(keys))
    return keys, stats


def _shard_builder(folder: str, hot: np.ndarray, shards: int):
    """One shard's partial counts to its arrays, its continuation counts by
    the word's shard, and its part of the hot contexts."""
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        ctx, w, n = _joined(rows["blob"], "<u8", "<u4")
        pair, at, n = _summed(bigram(ctx, w), n.astype(np.int64))
        ctx, w = ctx[at], w[at]
        put_file(folder, f"bigram-{shard}", lambda out: _file(out, pair, n.astype(BIGRAM)))
        special = np.isin(ctx, hot)
        put_file(folder, f"context-{shard}", lambda out: _file(out, *_contexts_of(ctx[~special], n[~special])))
        out = [("stat", shard, None, [int(n.sum()), len(n), *_of_counts(n)])]
        word, _, before = _summed(w, np.ones(len(w), dtype=np.int64))
        to = shard_of(word, shards)
        for s in np.unique(to):
            out.append(("word", int(s), _pack(word[to == s], before[to == s].astype("<u4")), None))
        keys, stats = _contexts_of(ctx[special], n[special])
        to = shard_of(keys, shards)
        for s in np.unique(to):
            own = stats[to == s]
            out.append(("hot", int(s), _pack(keys[to == s], own["total"], *[
                np.ascontiguousarray(own["n"][:, i]) for i in range(3)]), None))
        return pd.DataFrame(out, columns=["kind", "shard", "blob", "stat"])

    return build


def _word_builder(folder: str):
    """Continuation counts and hot contexts of one shard."""
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        stat = [0] * 6
        words = rows["blob"][rows["kind"] == "word"]
        if len(words):
            w, n = _joined(words, "<u4")
            w, _, n = _summed(w, n.astype(np.int64))
            put_file(folder, f"word-{shard}", lambda out: _file(out, w, n.astype(WORD)))
            stat = [int(n.sum()), len(n), *_of_counts(n)]
        special = rows["blob"][rows["kind"] == "hot"]
        if len(special):
            ctx, total, *seen = _joined(special, "<i8", "<u4", "<u4", "<u4")
            keys, _, total = _summed(ctx, total)
            stats = np.zeros(len(keys), dtype=CONTEXT)
            stats["total"] = total
            for i in range(3):
                stats["n"][:, i] = _summed(ctx, seen[i].astype(np.int64))[2]
            put_file(folder, f"hot-{shard}", lambda out: _file(out, keys, stats))
        return pd.DataFrame([("stat", shard, None, stat)], columns=["kind", "shard", "blob", "stat"])

    return build


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts for counts of 0, 1, 2 and 3 or more; where the counts of
    counts do not give them, 0, 0.5, 1 and 1.5."""
    if not (n1 and n2):
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return 0.0, *(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the model's few numbers."""

    folder: str
    shards: int
    hot: tuple[int, ...]
    n_tokens: int
    n_types: int
    n_bigrams: int
    high: tuple[float, ...]
    low: tuple[float, ...]
    low_seen: tuple[int, int, int]


def train(documents: DataFrame, shard_bytes: int = SHARD_BYTES, flush: int = FLUSH) -> Model:
    """Count the model of all given documents into a new shared folder."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select("text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    shards = max(2, -(-(size["b"] or 0) // shard_bytes))
    hot = _hot_contexts(texts, size["n"], shards)
    folder = shared_folder(spark, "lm")
    counted = texts.mapInPandas(_counter(hot, shards, flush), "shard long, blob binary")
    built = written(counted.groupBy("shard").applyInPandas(_shard_builder(folder, hot, shards), _BUILT), "lm-shards")
    words = written(built.where("kind <> 'stat'").groupBy("shard").applyInPandas(_word_builder(folder), _BUILT),
                    "lm-words")

    def total(df: DataFrame) -> list[int]:
        row = df.where("kind = 'stat'").agg(*[F.sum(F.col("stat")[i]) for i in range(6)]).first()
        return [x or 0 for x in row]

    n, n_bigrams, *high = total(built)
    _, n_types, *low = total(words)
    seen = (low[0], low[1], n_types - low[0] - low[1])
    return Model(folder, shards, tuple(int(x) for x in hot), n, n_types, n_bigrams, discounts(*high),
                 discounts(*low), seen)


def _hot_contexts(texts: DataFrame, n_docs: int, shards: int) -> np.ndarray:
    """The start, and words with more than two shards' share of the tokens in
    a look at some documents: at most half as many as shards."""
    look = texts.sample(min(1.0, LOOK / n_docs), seed=7) if n_docs else texts
    words = written(look.select(F.explode(space_words(lower_ascii(F.col("text")))).alias("w"))
                    .groupBy("w").agg(F.count("*").alias("n")), "lm-look")
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.where(F.col("n") * shards > 2 * total).select("w").collect()
    return np.array([START, *(xxhash.xxh64_intdigest(r[0].encode()) for r in rows)], dtype=np.uint64)


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, value: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and the values of one array file, memory-mapped."""
    try:
        raw = np.memmap(local_copy(folder, name), dtype=np.uint8, mode="r")
    except (FileNotFoundError, ValueError):  # a shard without rows
        raw = np.zeros(0, dtype=np.uint8)
    n = len(raw) // (8 + value.itemsize)
    return raw[:8 * n].view("<u8"), raw[8 * n:].view(value)


@functools.lru_cache(maxsize=16)
def _reachable(folder: str) -> None:
    """An error, not a model without counts, where the arrays' folder cannot
    be seen."""
    files, base = shared_files(folder)
    if not files.get_file_info(base).type:  # NotFound is zero
        raise FileNotFoundError(f"the language model's folder cannot be read here: {folder}")


def _look_up(folder: str, kind: str, value: np.dtype, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Values of keys (zero where absent), each sought in its shard's file."""
    out = np.zeros(len(keys), dtype=value)
    order = np.argsort(shard, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order))
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        own = order[a:b]
        have, values = _mapped(folder, f"{kind}-{shard[own[0]]}", value)
        if len(have):
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            hit = have[at] == keys[own]
            out[own[hit]] = values[at[hit]]
    return out


def _discount(d: tuple[float, ...], n: np.ndarray) -> np.ndarray:
    return np.maximum(n - np.array(d)[np.minimum(n, 3)], 0.0)


def score_batch(model: Model, texts) -> pd.DataFrame:
    """``n_tokens, n_known, base_score, score`` of some whole texts."""
    if model.n_bigrams:
        _reachable(model.folder)
    parts = [tokens(t) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    if not len(sizes):
        return pd.DataFrame({"n_tokens": sizes, "n_known": sizes, "base_score": [], "score": []})
    w, ctx = np.concatenate(parts), np.concatenate([contexts(p) for p in parts])
    vocabulary, at = np.unique(np.append(w, START), return_inverse=True)
    start, at = at[-1], at[:-1]
    before = np.empty_like(at)
    first = np.cumsum(sizes) - sizes
    before[1:] = at[:-1]
    before[first] = start
    home = shard_of(vocabulary, model.shards)
    special = np.isin(vocabulary, np.array(model.hot, dtype=np.uint64))
    stats = np.zeros(len(vocabulary), dtype=CONTEXT)
    for kind, own in (("context", ~special), ("hot", special)):
        stats[own] = _look_up(model.folder, kind, CONTEXT, vocabulary[own], home[own])
    n_docs = int(stats["total"][start])
    raw = stats["total"].copy()  # a word's count is its total as a context; the end is no context
    raw[vocabulary == END] = n_docs
    raw[start] = 0
    left = _look_up(model.folder, "word", WORD, vocabulary, home).astype(np.int64)
    v = model.n_types + 1
    low_mass = float(np.dot(model.low[1:], model.low_seen))
    k = model.n_bigrams
    p1 = (_discount(model.low, left) + low_mass / v) / k if k else np.full(len(vocabulary), 1.0 / v)
    pairs, pair_at = np.unique(bigram(ctx, w), return_inverse=True)
    row = np.zeros(len(pairs), dtype=np.int64)
    row[pair_at] = np.arange(len(w))
    c_row = before[row]
    deal = np.where(special[c_row], shard_of(pairs, model.shards), home[c_row])
    n = _look_up(model.folder, "bigram", BIGRAM, pairs, deal).astype(np.int64)
    total = stats["total"][c_row]
    mass = stats["n"][c_row].astype(float) @ np.array(model.high[1:])
    lower = p1[at[row]]
    p = np.where(total > 0, (_discount(model.high, n) + mass * lower) / np.maximum(total, 1), lower)
    base = np.log10((raw + 0.5) / (model.n_tokens + 0.5 * v))
    return pd.DataFrame({
        "n_tokens": sizes, "n_known": np.add.reduceat((raw > 0)[at].astype(np.int64), first),
        "base_score": np.add.reduceat(base[at], first), "score": np.add.reduceat(np.log10(p)[pair_at], first)})


SCORE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                      T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score_of(model: Model, text: Column) -> Column:
    """The score struct of a text column."""
    @F.pandas_udf(SCORE)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield score_batch(model, batch)

    return of(text)


def scored(documents: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity`` of every document row, by the model of the rows that
    are not held out."""
    out = remainder(F.col("doc_id"), folds) == held_out
    model = train(documents.where(~out))
    small_batches(documents.sparkSession, 512)
    return documents.select("doc_id", out.alias("held_out"), score_of(model, F.col("text")).alias("s")).select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        "s.base_score", "s.score", F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens")).alias("perplexity"))
