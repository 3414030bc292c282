"""Cross-tokenizer alignment: which tokens of vocabulary A and vocabulary B
end at the same byte of a text, counted over the corpus.

``A`` is a byte-level BPE file of the ``tokenizers`` library and reads a space
and the text, ``B`` a ``sentencepiece`` model, which adds the space itself.
Byte offsets where tokens of both end cut them into groups; a link is the pair
of the two tokens that end there.

* **Identity fast path.** :meth:`Pair.same` holds, for each A id, the B id with
  the same bytes. A group of one token each with these ids is counted in a
  vector as long as A's vocabulary, one a task; the other groups alone have
  their (A id, B id) keys counted by a shuffle.
* **Texts are encoded once** (:func:`encoded`), their links written as sorted
  keys with counts. Between two single-spaced words both tokenizers always cut
  (:func:`_splits` proves it from the files; otherwise a text is one chunk), so
  chunks are encoded apart and remembered in a bounded table.
* **Counts back to texts** (:func:`aligned`): identity counts and each B id's
  highest count are vectors bounded by the vocabularies. The ``HOT`` most
  frequent other keys travel as one sorted array; the rest meet the texts in a
  join, where no key is frequent any more.

Defined results: null, empty, or texts whose tokens' bytes are not the space
and the text have no tokens, zeros and the empty ``groups_sha256``; repeated
rows count each; columns other than ``doc_id`` and ``text`` are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import bounded_batches, written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Keys whose counts travel to every task (16 bytes each).
HOT = 500_000
#: Chunks that a worker remembers, and the longest of them in characters.
REMEMBERED, SHORT = 300_000, 64
#: Chunks encoded as one text.
JOINED = 1_000
#: Keys that a task counts before it hands them on.
FLUSH = 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
ENCODED = ("doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>")


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain), *((256 + i, b) for i, b in enumerate(rest))]}


def _splits(a: dict, pieces: list[str]) -> bool:
    """Whether both tokenizers always cut before a single space between two
    other characters: A's words begin with it and are encoded apart; no piece
    of B has a space after another character, so no merge crosses it."""
    pre = a.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return byte_level and not a.get("normalizer") and not any("▁" in p.lstrip("▁") for p in pieces)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, with the end of the last."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _runs(at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[r]:at[r + 1]]`` of the rows, one after another,
    and their sizes."""
    sizes = at[rows + 1] - at[rows]
    start = _starts(sizes)
    return values[np.arange(start[-1]) + np.repeat(at[rows] - start[:-1], sizes)], sizes


class Chunks:
    """What is known of chunks, by number: tokens of each vocabulary, groups
    and their text, A ids of identity groups, keys of the others (runs of flat
    arrays), and whether the bytes are the chunk's."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, bytes agree
        self.spelled: list[str] = []
        self.runs = [(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))] * 2
        self.used = np.zeros(0, dtype=np.int64)

    def add(self, names: list[str], sizes: np.ndarray, spelled: list[str], runs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Further chunks; ``runs`` are their identity ids and other keys."""
        self.number.update(zip(names, range(len(self.spelled), len(self.spelled) + len(names))))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.spelled += spelled
        self.runs = [(np.append(a, a[-1] + at[1:]), np.append(v, more)) for (a, v), (at, more) in zip(self.runs, runs)]
        self.used = np.append(self.used, np.zeros(len(names), dtype=np.int64))

    def most_used(self, n: int) -> Chunks:
        """The ``n`` short chunks met most often, the others forgotten."""
        names = list(self.number)
        short = np.fromiter((len(c) <= SHORT for c in names), dtype=bool, count=len(names))
        rows = np.argsort(np.where(short, -self.used, 1), kind="stable")[:min(n, int(short.sum()))]
        out, runs = Chunks(), []
        for at, values in self.runs:
            kept, sizes = _runs(at, values, rows)
            runs.append((_starts(sizes), kept))
        out.add([names[r] for r in rows], self.sizes[rows], [self.spelled[r] for r in rows], runs)
        return out


class Pair:
    """Two tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        values = _byte_values()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        known: dict[bytes, int] = {}
        for bytes_only in (True, False):  # an ordinary piece goes before the byte of the same value
            for i, raw in reversed(list(enumerate(self.b_bytes))):
                if self.b.is_byte(i) == bytes_only and not (self.b.is_control(i) or self.b.is_unknown(i)):
                    known[raw] = i
        self.same = np.array([known.get(raw, -1) for raw in self.a_bytes], dtype=np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.a_bytes, self.b_bytes))
        # an id's text with what follows it: inside its side of a group, or after the side's last
        self.words = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]
        self.apart = _splits(json.loads(self.a.to_str()), pieces)
        self.chunks = Chunks()

    @property
    def width(self) -> int:
        """Keys are ``A id * width + B id``."""
        return len(self.b_bytes)

    def _tokens(self, names: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks encoded one by one: both sides' ids and how many each chunk
        has (none where the bytes are not its ``raw`` ones), and where they are."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + c for c in names], add_special_tokens=False)]
        b = self.b.encode(names, num_threads=1)
        fits = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y))
                         for x, y, w in zip(a, b, raw)], dtype=bool)
        a, b = ([x if ok else [] for x, ok in zip(side, fits)] for side in (a, b))
        n_a, n_b = (np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (a, b))
        return *(np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in (a, b)), n_a, n_b, fits

    def _joined_tokens(self, names: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of chunks that start and end with other characters than
        spaces, encoded as one text: both tokenizers cut between them."""
        text = " ".join(names)
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype=np.int64)
        b = np.array(self.b.encode([text], num_threads=1)[0], dtype=np.int64)
        whole = b"".join(raw)
        if not (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(self.b_bytes.__getitem__, b.tolist()))):
            return self._tokens(names, raw)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        n_a, n_b = (np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0)
                    for size, ids in ((self.a_size, a), (self.b_size, b)))
        return a, b, n_a, n_b, np.ones(len(names), dtype=bool)

    def learn(self, new: list[str]) -> None:
        """Encode chunks, each preceded by a space, and cut them into groups."""
        if not new:
            return
        clean = [c for c in new if self.apart and not (c[0].isspace() or c[-1].isspace())]
        odd = list(set(new).difference(clean))
        names = clean + odd
        raw = [b" " + c.encode() for c in names]
        steps = [*range(0, len(clean), JOINED), len(clean)]
        found = [self._joined_tokens(names[s:e], raw[s:e]) for s, e in zip(steps, steps[1:])]
        if odd:
            found.append(self._tokens(odd, raw[len(clean):]))
        a, b, n_a, n_b, fits = (np.concatenate(x) for x in zip(*found))
        # both sides have the same bytes, so ends may be counted through all chunks at once
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        place = np.searchsorted(end_b, end_a)
        last_a = end_b[place] == end_a if len(a) else np.zeros(0, dtype=bool)
        at_a, at_b = np.flatnonzero(last_a), place[last_a]
        last_b = np.zeros(len(b), dtype=bool)
        last_b[at_b] = True
        one = (np.diff(at_a, prepend=-1) == 1) & (np.diff(at_b, prepend=-1) == 1)
        x, y = a[at_a], b[at_b]
        same = one & (self.same[x] == y)
        chunk = np.repeat(np.arange(len(names)), n_a)[at_a]
        count = functools.partial(np.bincount, minlength=len(names))
        runs = [(_starts(count(chunk[same])), x[same]), (_starts(count(chunk[~same])), (x * self.width + y)[~same])]
        # the groups' text: a group's A tokens, then its B tokens
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = a + len(self.a_bytes) * last_a
        code[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * last_b
        spelled, cut = list(map(self.words.__getitem__, code.tolist())), _starts(n_a + n_b).tolist()
        self.chunks.add(names, np.stack([n_a, n_b, count(chunk), fits.astype(np.int64)], axis=1),
                        ["".join(spelled[s:e]) for s, e in zip(cut, cut[1:])], runs)

    def encode(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns of :data:`ENCODED` after the id."""
        if len(self.chunks.spelled) > REMEMBERED:
            self.chunks = self.chunks.most_used(REMEMBERED // 2)
        cut = [(_CUT.split(t) if self.apart else [t]) if t else [] for t in texts]
        met = list(chain.from_iterable(cut))
        self.learn([c for c in set(met) if c not in self.chunks.number])
        known = self.chunks
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        rows = np.fromiter(map(known.number.__getitem__, met), dtype=np.int64, count=len(met))
        np.add.at(known.used, rows, 1)
        text = np.repeat(np.arange(len(texts)), sizes)
        wrong = np.zeros(len(texts), dtype=bool)
        wrong[text[known.sizes[rows, 3] == 0]] = True
        rows, text = rows[~wrong[text]], text[~wrong[text]]
        totals = np.zeros((len(texts), 4), dtype=np.int64)
        np.add.at(totals, text, known.sizes[rows])
        at = _starts(np.bincount(text, minlength=len(texts))).tolist()
        numbers, spelled = rows.tolist(), known.spelled
        sha = [hashlib.sha256("".join(map(spelled.__getitem__, numbers[s:e]))[:-1].encode()).hexdigest() if e > s else ""
               for s, e in zip(at, at[1:])]
        out = [*(pa.array(totals[:, i], pa.int64()) for i in range(3)), pa.array(sha, pa.string())]
        for (start, values), top, kind in zip(known.runs, (len(self.same), len(self.same) * self.width), (pa.int32(), pa.int64())):
            keys, n = _runs(start, values, rows)
            both, times = np.unique(np.repeat(text, n) * top + keys, return_counts=True)
            offsets = pa.array(_starts(np.bincount(both // top, minlength=len(texts))).astype(np.int32))
            out += [pa.ListArray.from_arrays(offsets, pa.array(both % top, kind)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
        return out


@functools.lru_cache(maxsize=2)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


# ---- passes ---------------------------------------------------------------

def _sorted_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n[:0]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin, with the end."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def encoded(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Each text's token numbers, groups and links, written: ``row`` and
    :data:`ENCODED` (``same``: A ids of identity groups, ``pairs``: the other
    keys, both distinct and sorted, with their counts)."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "pairs", "pairs_n"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_file, b_file)
        gc.freeze()  # the collector need not walk the vocabularies
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *both.encode(batch.column(1).to_pylist())], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with bounded_batches(documents.sparkSession):
        return written(rows.mapInArrow(task, ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")


def identity_counts(texts: DataFrame, both: Pair) -> np.ndarray:
    """How often each A id is linked to its own B id: a vector a task, summed
    by id (at most the vocabulary comes to the driver)."""
    size = len(both.same)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size, dtype=np.int64)
        for batch in batches:
            np.add.at(vector, _flat(batch.column(0))[0], _flat(batch.column(1))[0])
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(vector[at], pa.int64())], names=["a", "n"])

    got = texts.select("same", "same_n").mapInArrow(task, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()
    vector = np.zeros(size, dtype=np.int64)
    for r in got:
        vector[r["a"]] = r["n"]
    return vector


def pair_counts(texts: DataFrame) -> DataFrame:
    """``key, n`` of the links of all other groups, written."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = _sorted_counts(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 200_000], pa.int64()), pa.array(n[i:i + 200_000], pa.int64())],
                                                 names=["key", "n"])

        for batch in batches:
            held.append((_flat(batch.column(0))[0], _flat(batch.column(1))[0].astype(np.int64)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    keys = texts.select("pairs", "pairs_n").mapInArrow(task, "key long, n long")
    return written(keys.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")


def highest(pairs: DataFrame, identity: np.ndarray, both: Pair) -> np.ndarray:
    """The highest count of any key with each B id (a vocabulary's vector)."""
    top = np.zeros(both.width, dtype=np.int64)
    known = both.same >= 0
    np.maximum.at(top, both.same[known], identity[known])
    for r in pairs.groupBy((F.col("key") % both.width).alias("b")).agg(F.max("n").alias("n")).collect():
        top[r["b"]] = max(top[r["b"]], r["n"])
    return top


def links(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The alignment table: ``a_id, b_id, n`` (links), ``best`` (no A id is
    linked to this B id more often)."""
    both, texts = pair(a_file, b_file), encoded(documents, a_file, b_file)
    identity, pairs = identity_counts(texts, both), pair_counts(texts)
    top = highest(pairs, identity, both)
    spark = documents.sparkSession
    at = np.flatnonzero(identity)
    own = spark.createDataFrame([(int(a), int(both.same[a]), int(identity[a])) for a in at], "a_id long, b_id long, n long")
    rest = pairs.select(F.floor(F.col("key") / both.width).alias("a_id"), (F.col("key") % both.width).alias("b_id"), "n")
    best = spark.createDataFrame([(int(b), int(top[b])) for b in np.flatnonzero(top)], "b_id long, top long")
    return (own.unionByName(rest).join(F.broadcast(best), "b_id")
            .select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best")))


def aligned(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, hot: int | None = None) -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links``
    (tokens are never empty: one a group), ``n_best`` (links whose key is its
    B id's most frequent, ties included), ``count_sum`` (of the keys' counts
    over the links) and ``groups_sha256``."""
    hot = HOT if hot is None else hot
    both, texts, spark = pair(a_file, b_file), encoded(documents, a_file, b_file), documents.sparkSession
    identity, pairs = identity_counts(texts, both), pair_counts(texts)
    top = highest(pairs, identity, both)
    chosen = pairs.orderBy(F.desc("n"), "key").limit(hot).orderBy("key").toArrow()
    whole = chosen.num_rows < hot  # then no key is left for the join
    keys, counts = (chosen.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    sent = spark.sparkContext.broadcast((both.same, identity, top, keys, counts))
    width = both.width

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of each row's values."""
        total = np.append(0, np.cumsum(values, dtype=np.int64))
        return total[at[1:]] - total[at[:-1]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, identity, top, keys, counts = sent.value
        for batch in batches:
            ids, at = _flat(batch.column("same"))
            times = _flat(batch.column("same_n"))[0]
            best = sums(times * (identity[ids] == top[same[ids]]), at)
            total = sums(times * identity[ids], at)
            pair_keys, at = _flat(batch.column("pairs"))
            times = _flat(batch.column("pairs_n"))[0].astype(np.int64)
            place = np.searchsorted(keys, pair_keys)
            place[place == len(keys)] = 0
            known = (keys[place] == pair_keys) if len(keys) else np.zeros(len(pair_keys), dtype=bool)
            n = np.where(known, counts[place], 0) if len(keys) else np.zeros(len(pair_keys), dtype=np.int64)
            best += sums(times * (known & (n == top[pair_keys % width])), at)
            total += sums(times * n, at)
            left = np.append(0, np.cumsum(~known)).astype(np.int32)[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")],
                 pa.array(best, pa.int64()), pa.array(total, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(pair_keys[~known], pa.int64())),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(times[~known], pa.int64()))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "left", "left_n"])

    looked = texts.mapInArrow(task, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                    "n_best long, count_sum long, left array<long>, left_n array<long>")
    if not whole:
        looked = written(looked, "looked-up")
        high = spark.createDataFrame([(int(b), int(top[b])) for b in np.flatnonzero(top)], "b long, top long")
        rare = pairs.join(F.broadcast(high), F.col("key") % width == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))
        more = (looked.where(F.size("left") > 0).select("row", F.explode(F.arrays_zip("left", "left_n")).alias("l"))
                .select("row", F.col("l.left").alias("key"), F.col("l.left_n").alias("times")).join(rare, "key")
                .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("more_sum")))
        looked = (looked.join(more, "row", "left")
                  .withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                                "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}))
    return looked.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
