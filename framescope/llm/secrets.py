"""Secret scan: fixed patterns plus character Markov models.

Two first-order character models are trained on the scanned corpus itself:
*random* on the values that the fixed patterns find (its labelled samples of
random strings; a uniform pseudo-count stands for strings not seen yet), and
*ordinary* on all other text of every document (identifiers and words).
Transition counts are summed over all documents in Spark. A token of
``LEAST`` or more characters, four of them letters, is a secret of kind
``markov`` when its log-likelihood ratio passes ``PER_CHAR`` a character;
of a token that touches a span that a pattern found, the parts outside are
scored, each as a token. Where the whole does not pass, the runs of its parts (between ``/ = _ -``) that have as many
characters and pass are, best first, so that a name or path in front of a
random value does not hide it. Several parts without any digit are names.

Spans are ``(start, end, kind)`` in code points, end exclusive. Defined
cases: null text counts as empty and has no spans; repeated rows count
each; without documents the models are uniform; other columns are ignored
by the scan and kept by ``redact``."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns; ASCII letters of the keywords in either case.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
PART = re.compile(r"[A-Za-z0-9+]+")
LEAST, PER_CHAR = 16, 1.3
#: Pseudo-count of each transition between characters of tokens.
SMOOTH = 2.0
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
_CODE = np.zeros(256, dtype=np.int64)
_CODE[list(ALPHABET)] = np.arange(1, SIZE)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: leftmost, non-overlapping per kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _pairs(raw: bytes) -> np.ndarray:
    """Counts of adjacent character codes (0: any other byte)."""
    codes = _CODE[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def _split(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, str]:
    """The found values, and the rest of the text."""
    values, rest, at = [], [], 0
    for s, e, kind in spans:
        value = TOKEN.findall(text[s:e])[-1:] if kind == "assign" else [text[s:e]]
        values += value
        if e > at:
            rest.append(text[at:max(at, s)])
            at = e
    rest.append(text[at:])
    return " ".join(values), " ".join(rest)


def ratios(documents: DataFrame) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of each transition."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                if t:
                    values, rest = _split(t, pattern_spans(t))
                    total[0] += _pairs(values.encode("utf-8", "replace")) if values else 0
                    total[1] += _pairs(rest.encode("utf-8", "replace"))
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield pd.DataFrame({"model": k, "pair": at, "n": total[k][at]})

    got = (documents.select("text").mapInPandas(count, "model int, pair int, n long")
           .groupBy("model", "pair").agg(F.sum("n").alias("n")).collect())  # at most 2 x SIZE x SIZE rows
    counts = np.full((2, SIZE, SIZE), SMOOTH)
    counts[:, 0, 0] = 0
    for r in got:
        counts[r["model"], r["pair"] // SIZE, r["pair"] % SIZE] += r["n"]
    counts[:, 0, 0] = SMOOTH  # transitions outside tokens say nothing about them
    p = counts / counts.sum(2, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def _random_runs(token: str, llr: np.ndarray) -> list[tuple[int, int]]:
    """Where a token is random: the whole of it, else the runs of its parts
    with the largest ratio over ``PER_CHAR`` a character that do not overlap."""
    codes = _CODE[np.frombuffer(token.encode(), dtype=np.uint8)]
    over = np.concatenate([[0.0], np.cumsum(llr[codes[:-1], codes[1:]] - PER_CHAR)]) - PER_CHAR
    letters = np.concatenate([[0], np.cumsum([c.isalpha() for c in token])])
    digits = np.concatenate([[0], np.cumsum([c.isdigit() for c in token])])
    parts = [m.span() for m in PART.finditer(token)]
    if over[-1] > 0 and letters[-1] >= 4 and (digits[-1] or len(parts) == 1):
        return [(0, len(token))]
    found: list[tuple[int, int]] = []
    todo = [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        best, first, last, run, at = 0.0, -1, -1, -1, low
        for j in range(low, high):
            # of the parts that start LEAST characters before this one's end, the one that leaves the most
            end = parts[j][1]
            while at <= j and end - parts[at][0] >= LEAST:
                if run < 0 or over[parts[at][0]] < over[parts[run][0]]:
                    run = at
                at += 1
            for i in {run, j}:
                start = parts[i][0]
                if i < 0 or end - start < LEAST or letters[end] - letters[start] < 4:
                    continue
                score = over[end - 1] - over[start] - PER_CHAR
                if score > best and (i == j or digits[end] > digits[start]):
                    best, first, last = score, i, j
        if last >= 0:
            found.append((parts[first][0], parts[last][1]))
            todo += [(low, first), (last + 1, high)]
    return sorted(found)


def _scored(text: str, start: int, end: int, llr: np.ndarray) -> list[tuple[int, int, str]]:
    """Random runs of a token, or of what is left of it."""
    token = text[start:end]
    if end - start < LEAST or sum(c.isalpha() for c in token) < 4:
        return []
    return [(start + s, start + e, "markov") for s, e in _random_runs(token, llr)]


def spans_of(text: str | None, llr: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans of one text, by start and then kind."""
    text = text or ""
    spans = pattern_spans(text)
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
    extra = []
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < LEAST:
            continue
        at = m.start()
        # what base spans leave of a token is scored on its own
        for i in range(bisect_right(ends, at), bisect_left(starts, m.end())):
            extra += _scored(text, at, spans[i][0], llr)
            at = max(at, spans[i][1])
        extra += _scored(text, at, m.end(), llr)
    return sorted(spans + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCAN = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_markov")]
                    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the counts, digest and spans of every document row."""
    llr = ratios(documents)

    @F.pandas_udf(SCAN)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                spans = spans_of(t, llr)
                base = joined([s for s in spans if s[2] != "markov"])
                rows.append([sum(s[2] == k for s in spans) for k in KINDS]
                            + [hashlib.sha256(base.encode()).hexdigest(), joined(spans)])
            yield pd.DataFrame(rows, columns=SCAN.fieldNames())

    return documents.select("doc_id", scan(F.col("text")).alias("s")).select("doc_id", "s.*")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``[kind]`` and ``n_chars``
    set to the new length where a text changed; null texts stay null."""
    llr = ratios(documents)

    @F.pandas_udf(T.StringType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([t if t is None else _masked(t, spans_of(t, llr)) for t in batch], dtype=object)

    # the new text in a frame of its own names, so that no column can clash
    cells = [F.col(f"`{c}`") for c in documents.columns]
    both = documents.select(F.struct(*cells).alias("row"), clean(F.col("text")).alias("clean"))
    changed = ~F.col("clean").eqNullSafe(F.col("row.text"))
    own = {"text": F.col("clean"),
           "n_chars": F.when(changed, F.length("clean").cast("bigint")).otherwise(F.col("row.n_chars"))
           if "n_chars" in documents.columns else None}
    return both.select(*[(own.get(c) if own.get(c) is not None else F.col("row")[c]).alias(c)
                         for c in documents.columns])


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text
