"""Quality classifier: regularised quadratic discriminant over transformed
document statistics.

Each text becomes ``NAMES`` statistics (counts turned into smoothed log
ratios). Per label, counts, sums and outer products are summed over all
training rows in Spark; the class covariances are shrunk towards the pooled
one and its diagonal, factorised once (Cholesky) and shipped as small
matrices; scores are differences of Mahalanobis log densities, turned into a
probability by a line fitted to the same training rows.

Defined cases: null text counts as empty; null labels and labels without a
document train nothing; repeated rows count each; without two labelled
classes every score is 0.5; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import remainder, written

NAMES = ("length", "capitals", "symbols", "shouts", "digits", "stops", "word_length", "distinct", "distinct_runs",
         "repeated_lines")
SYMBOLS = b"#$%&*|<>@^~_=+{}[]\\/`"
#: Share of the pooled covariance in each class's, and of the diagonal in both.
POOLED, DIAGONAL = 0.3, 0.1
KEEP = 0.7


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    capitals = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = capitals + count(b"abcdefghijklmnopqrstuvwxyz")
    runs = max(n - 2, 0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        np.log((capitals + 1) / (letters + 100)),
        np.log((count(SYMBOLS) + 1) / (n + 20)),
        np.log((count(b"!?") + 1) / (n + 20)),
        np.log((count(b"0123456789") + 1) / (n + 20)),
        np.log((count(b".,;:") + 1) / (n + 10)),
        np.log((sum(map(len, words)) + 20) / (n + 4)),
        np.log((len(set(words)) + 10) / (n + 10)),
        np.log((len(set(zip(words, words[1:], words[2:]))) + 10) / (runs + 10)),
        np.log((len(set(lines)) + 5) / (len(lines) + 5)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(x) for x in batch])


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants by class, and the
    line that turns a log-density difference into log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    line: tuple[float, float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) - 0.5 * self.log_dets[k]
                   for k in (0, 1)]
        return density[1] - density[0]

    def odds(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        return self.line[0] + self.line[1] * np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def _sums(rows: DataFrame, function, schema_len: int) -> dict[int, np.ndarray]:
    """Per label, the sum of ``function(x)`` vectors over all rows: summed in
    each task, then by Spark."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = np.array(b["x"].tolist(), dtype=float), b["y"].to_numpy()
            for k in np.unique(y):
                total[k] = total.get(k, 0) + function(x[y == k])
        for k, v in total.items():
            yield pd.DataFrame({"y": k, "i": np.arange(len(v)), "v": v})

    got = (rows.select("x", "y").mapInPandas(partial, "y int, i int, v double")
           .groupBy("y", "i").agg(F.sum("v").alias("v")).collect())
    out: dict[int, np.ndarray] = {}
    for r in got:  # labels x moments: bounded by the number of statistics
        out.setdefault(r["y"], np.zeros(schema_len))[r["i"]] = r["v"]
    return out


def fit(rows: DataFrame) -> Model | None:
    """A model from rows ``x array<double>, y int`` (0 or 1); None unless
    both labels occur."""
    d = len(NAMES)
    moments = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), 1 + d + d * d)
    if not {0, 1} <= set(moments):
        return None
    n = np.array([moments[k][0] for k in (0, 1)])
    means = np.array([moments[k][1:1 + d] / n[k] for k in (0, 1)])
    own = [moments[k][1 + d:].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, dets = [], []
    for c in own:
        c = (1 - POOLED) * c + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Model(means, np.array(factors), np.array(dets), (0.0, 1.0))
    model.line = _line(rows, model)
    return model


def _line(rows: DataFrame, model: Model, steps: int = 6) -> tuple[float, float]:
    """Ridge logistic regression of the label on the squashed difference, by
    Newton steps whose sums Spark takes over all training rows."""
    bins = _sums(rows, lambda x: np.concatenate([_histogram(model, x)]), 241)
    centre = np.linspace(-12, 12, 241)
    pos, neg = bins.get(1, np.zeros(241)), bins.get(0, np.zeros(241))
    w = np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * centre)))
        g = pos - (pos + neg) * p
        h = (pos + neg) * p * (1 - p)
        grad = np.array([g.sum(), (g * centre).sum()]) - 1.0 * (w - [0, 1])
        hess = np.array([[h.sum(), (h * centre).sum()], [(h * centre).sum(), (h * centre ** 2).sum()]]) + np.eye(2)
        w = w + np.linalg.solve(hess, grad)
    return float(w[0]), float(max(w[1], 0.1))


def _histogram(model: Model, x: np.ndarray) -> np.ndarray:
    at = np.clip(np.rint((model.odds(x) + 12) * 10), 0, 240).astype(int)
    return np.bincount(at, minlength=241).astype(float)


def training(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``x, y`` of featured documents (``doc_id, x``) whose labels may
    be learnt from."""
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.where(remainder(F.col("id"), 4) != 2)
    return featured.join(known, featured["doc_id"] == known["id"]).select("x", "y")


def featured(documents: DataFrame) -> DataFrame:
    """``doc_id, x`` of every document, kept in the shared folder."""
    return written(documents.select("doc_id", _statistics(F.col("text")).alias("x")), "quality")


def score_of(model: Model | None, x: Column) -> Column:
    """The score of a statistics column."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(v.tolist(), dtype=float)) if len(v) else [], dtype=float)

    return score(x)


def scored(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row."""
    table = featured(documents)
    model = fit(training(table, labels))
    return table.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
                        score_of(model, F.col("x")).alias("score")).withColumn(
        "predicted", (F.col("score") >= keep).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents scoring ``keep`` or more, columns unchanged."""
    model = fit(training(featured(documents), labels))
    return documents.where(score_of(model, _statistics(documents["text"])) >= keep)
