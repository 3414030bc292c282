"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms, accents, homoglyphs and digits
or signs that stand for letters inside a word all become plain lower-case
letters. The lexicon is learnt from labelled rows: whole words and word
beginnings whose document frequency is much higher among toxic documents get
their smoothed log odds as weight; near copies of one document count as one.
Copies are documents whose sets of ``SHINGLE``-word shingles agree in ``NEAR``
of ``HASHES`` min-hashes (an estimate of their Jaccard similarity) with the
first of their group; bands of ``BAND`` min-hashes name the candidates. The
min-hashes of the bounded sample are compared on the driver. Phrases around a lexicon word
that non-toxic documents use become exceptions, which cancel the match.
A document's matched weight, normalised by the root of its length, goes
through a logistic curve fitted to the same rows.

Defined cases: null text counts as empty (score of a document without
matches); null labels, and labels without document, train nothing; without
two labelled classes every score is 0; repeated rows count each; other
columns are ignored."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import remainder, written

#: Bound on the labelled rows that the lexicon and curve are fitted on.
SAMPLE = 40_000
#: A unit needs this many distinct toxic documents, and this share of them.
LEAST, SHARE = 5, 0.004
#: Least weight: toxic documents use the unit e**MIN_WEIGHT times as often.
MIN_WEIGHT = 2.0
#: Near copies: words of a shingle, min-hashes of a document, of a band, and the share that must agree.
SHINGLE, HASHES, BAND, NEAR = 5, 128, 4, 0.8
PREFIXES = (4, 5, 6, 7, 8, 9)
FLAG = 0.3

# Letters of other scripts that look like Latin ones, and signs
# written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "г": "r", "п": "n",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ε": "e", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "η": "n",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
HIDDEN = "­​‌‍⁠﻿"

_TABLE = str.maketrans(HOMOGLYPHS | {c: None for c in HIDDEN})
_LEET = re.compile(r"(?<![^\W_])(?=[\d@$!]*[^\W\d_])(?:[^\W_]|[@$!](?=[^\W_]))+")
_LEET_TABLE = str.maketrans(DIGITS | SIGNS)
_MARKS = re.compile(r"[̀-ͯ]+")
_GAPS = re.compile(r"[\W\d_]+")
_OTHER = re.compile(r"[^\x00-\x7f\u0300-\u036f]")
_LEET_BYTES = b"0123456789@$!"
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_HAS_LEET = re.compile(r"[^\W\d_][\d@$!]|[\d@$!][^\W\d_]")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.replace("ß", "ss")).lower()
        if _OTHER.search(t):
            return _fold_any(_MARKS.sub("", t.translate(_TABLE)))
    raw = t.encode("ascii", "ignore")  # what goes are combining marks
    if len(raw.translate(None, _LEET_BYTES)) < len(raw) and _HAS_LEET.search(t := raw.decode()):
        return _fold_any(t)
    return f" {b' '.join(raw.translate(_LETTERS).split()).decode()} "


def _fold_any(t: str) -> str:
    if _HAS_LEET.search(t):
        t = _LEET.sub(lambda m: m[0].translate(_LEET_TABLE), t)
    return f" {_GAPS.sub(' ', t).strip()} "


def _units(folded: str) -> set[str]:
    """Whole words (spaces on both sides) and beginnings (one in front)."""
    words = set(folded.split())
    units = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        units.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return units


_ODD = np.random.default_rng(5).integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _key(folded: str) -> int:
    """A hash of the whole folded text: exact copies share it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(folded) >> 1


def _sketch(folded: str) -> np.ndarray:
    """``HASHES`` min-hashes of the text's shingles (of all words, if fewer)."""
    import xxhash

    words = folded.split()
    grams = {" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    h = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams))
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        mixed = h[i:i + 4096] * _ODD[:, None]  # the top bits depend on all bits below
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _groups(keys: np.ndarray, sketches: np.ndarray) -> dict[int, int]:
    """The key that stands for each near copy of another key's text."""
    root = np.arange(len(keys))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, HASHES, BAND):
        band = np.ascontiguousarray(sketches[:, k:k + BAND]).view(f"V{4 * BAND}").ravel()
        _, which, size = np.unique(band, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        for rows in np.split(order, np.cumsum(size)[:-1]):
            while len(rows) > 1:  # the first takes its near copies, the others go on without it
                near = (sketches[rows] == sketches[rows[0]]).mean(1) >= NEAR
                first = find(rows[0])
                for i in rows[near]:
                    other = find(i)
                    root[max(first, other)] = first = min(first, other)
                rows = rows[~near]
    return {int(keys[i]): int(keys[find(i)]) for i in range(len(keys)) if find(i) != i}


@dataclass
class Lexicon:
    """Unit weights, exception phrases and the curve ``(a, b)``."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float] = (-4.0, 1.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for u, w in self.weights.items():
            a.add_word(u, (u, w))
        for p in self.exceptions:
            a.add_word(p, (p, None))
        a.make_automaton()
        return a


def matches(automaton, folded: str) -> dict[int, float]:
    """Start of each matched word and the largest weight there, without
    words inside an exception phrase."""
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (unit, weight) in automaton.iter(folded):
        start = end - len(unit) + 1
        if weight is None:
            excused.append((start, end))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    for s, e in excused:
        for at in [x for x in found if s <= x < e]:
            del found[at]
    return found


def strength(automaton, text: str | None) -> float:
    """Matched weight over the root of the length in hundreds of words."""
    folded = fold(text)
    if not len(automaton):
        return 0.0
    total = sum(matches(automaton, folded).values())
    return total / max(1.0, folded.count(" ") / 100) ** 0.5 if total else 0.0


def _sample(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``text, y`` of at most ``bound`` labelled rows, chosen by a hash of the
    id; the ids are broadcast, so the texts do not move."""
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(remainder(F.col("id"), 4) != 2)
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(bound)
    return documents.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("text", "y")


def learn(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Lexicon:
    """The lexicon, exceptions and curve from a bounded labelled sample."""
    rows = written(_sample(documents, labels, bound), "toxic-sample")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            folded = [fold(t) for t in b["text"]]
            yield pd.DataFrame({"copy": [_key(f) for f in folded], "y": b["y"], "sketch": [_sketch(f).tobytes() for f in folded]})

    # at most one row of 4 x HASHES bytes for each row of the bounded sample
    got = rows.mapInPandas(sketch, "copy long, y int, sketch binary").toPandas().sort_values(["copy", "y"])
    texts = got.drop_duplicates("copy")
    near = _groups(texts["copy"].to_numpy(), np.array([np.frombuffer(s, np.uint32) for s in texts["sketch"]],
                                                      dtype=np.uint32).reshape(-1, HASHES))
    group = got["copy"].map(lambda c: near.get(c, c))
    sizes = got.assign(copy=group).drop_duplicates(["copy", "y"]).groupby("y").size().to_dict()
    if not {0, 1} <= set(sizes):
        return Lexicon({}, curve=(-40.0, 0.0))
    many = set(group[group.duplicated(keep=False)])

    def count_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            single: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            out = set()
            for t, y in zip(b["text"], b["y"]):
                folded = fold(t)
                copy = _key(folded)
                copy = near.get(copy, copy)
                if copy in many:
                    out.update((u, y, copy, 1) for u in _units(folded))
                else:
                    single[y].update(_units(folded))
            out.update((u, y, -1, n) for y, c in single.items() for u, n in c.items())
            yield pd.DataFrame(list(out), columns=["unit", "y", "copy", "n"])

    least = max(LEAST, SHARE * sizes[1])
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    weight = (F.log((of(1) + 0.5) / (sizes[1] + 1)) - F.log((of(0) + 0.5) / (sizes[0] + 1))).alias("w")
    # documents without copies are counted in place (copy -1), a group's units once
    units = (rows.mapInPandas(count_units, "unit string, y int, copy long, n long").groupBy("unit", "y", "copy")
             .agg(F.when(F.col("copy") < 0, F.sum("n")).otherwise(1).alias("n")))
    got = (units.groupBy("unit").agg(of(1).alias("n"), weight)
           .where((F.col("n") >= least) & (F.col("w") >= MIN_WEIGHT)).select("unit", "w"))
    lexicon = Lexicon(dict(got.collect()))  # at most one unit for each SHARE of the bounded sample's words
    lexicon.exceptions = _exceptions(rows, lexicon)
    lexicon.curve = _curve(rows, lexicon)
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    """Phrases (a lexicon word with the word before or after) that ``least``
    non-toxic documents use, and more of them than toxic ones."""
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["y"]):
                folded = fold(t)
                seen = set()
                for at in matches(a, folded) if len(a) else ():
                    end = folded.index(" ", at + 1)
                    if at:
                        seen.add(folded[folded.rindex(" ", 0, at):end + 1])
                    if end + 1 < len(folded):
                        seen.add(folded[at:folded.index(" ", end + 1) + 1])
                out += [(p, y) for p in seen]
            yield pd.DataFrame(out, columns=["phrase", "y"])

    toxic = F.sum("y")
    got = (rows.mapInPandas(phrases, "phrase string, y int").groupBy("phrase")
           .agg(F.count("*").alias("n"), toxic.alias("k"))
           .where((F.col("n") - F.col("k") >= least) & (F.col("n") > 3 * F.col("k"))).select("phrase"))
    return [r[0] for r in got.collect()]


def strength_of(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for batch in texts:
            yield pd.Series([strength(a, t) for t in batch], dtype=float)

    return of(text)


def _curve(rows: DataFrame, lexicon: Lexicon, steps: int = 12) -> tuple[float, float]:
    """Ridge logistic regression of the label on the log strength, over
    binned strengths (at most 81 rows a label)."""
    x = F.round(F.least(F.log1p(strength_of(lexicon, F.col("text"))), F.lit(8.0)), 1)
    bins = rows.select(x.alias("x"), "y").groupBy("x", "y").count().collect()
    at = np.array([r[0] for r in bins])
    y = np.array([r[1] for r in bins], dtype=float)
    n = np.array([r[2] for r in bins], dtype=float)
    w = np.array([-2.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * at)))
        g, h = n * (y - p), n * p * (1 - p)
        grad = np.array([g.sum(), (g * at).sum()]) - 0.1 * w
        hess = np.array([[h.sum(), (h * at).sum()], [(h * at).sum(), (h * at * at).sum()]]) + 0.1 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def scored(documents: DataFrame, labels: DataFrame, flag: float = FLAG) -> DataFrame:
    """``doc_id, held_out, strength, score, predicted`` of every document row."""
    lexicon = learn(documents, labels)
    a, b = lexicon.curve
    odds = F.lit(a) + F.lit(b) * F.log1p("strength")
    return (documents.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
                             strength_of(lexicon, F.col("text")).alias("strength"))
            .withColumn("score", 1 / (1 + F.exp(-odds)))
            .withColumn("predicted", (F.col("score") >= flag).cast("int")))
