"""Mixing documents to target domain weights, with soft membership.

1. A multinomial classifier over byte trigrams (hashed to ``BUCKETS``) is
   trained on the table's own labels (``source`` or another column; null
   labels train nothing): trigram counts by domain are summed in Spark over
   all labelled rows but those held out (crc32 of the id modulo 5 is 1).
2. It is calibrated on held-out rows: one temperature and a bias a domain,
   chosen so that their likelihood is greatest and that the expected documents,
   then tokens, of every domain are the labels'. A domain that texts do not
   show leaves posteriors near the domains' shares; the temperature is then
   near 0. Every document, labelled or not, gets its posterior from its text.
3. With t the tokens, q the posteriors and r the rate of each document, the
   expected tokens of domain d are ``sum(r t q_d)``. Projected gradient
   descent minimises ``sum_d (sum(r t q_d) - target_d)^2 / size_d`` from
   r = 1, over ``r >= 1`` with the default targets and over ``r >= 0`` with
   given weights. A document's gradient needs only the few residuals
   of the domains, so a step is one pass that sums the domains' tokens; a
   task recomputes its rates from the residuals of the earlier steps.

Targets: ``weights`` by domain (default: the domains' shares to the power
``TEMPERATURE``), times the smallest token budget for which no domain has
fewer tokens than now. With the default weights no document's rate is below 1,
so each appears at least once; raising documents of mixed posterior can
overfill a domain, so the budget rises with the steps to what fits the weights
best. Given weights may ask for less of a domain than its documents have, so
their rates may be below 1. A document of rate r appears floor(r) times, and once more with probability equal to
the rest, decided by a hash of its id and text.

Where texts tell domains apart too little, no rates meet the targets; the
misses that remain are part of the result (``miss``), with a warning.

Defined cases: null and empty texts have no tokens and the domains' shares as
posterior, and take part at their rate; without labels there is one domain and
every rate is 1; a table without tokens keeps rate 1; repeated rows count each;
other columns are kept."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import bounded_batches, remainder, text_key, written

BUCKETS = 1 << 14
EVIDENCE = 60
TEMPERATURE = 0.7
#: Steps end when the domains' residuals are below ``TOLERANCE`` of their
#: sizes, when no rate moves by ``STILL``, or after ``STEPS`` with a warning.
STEPS, TOLERANCE, STILL = 100, 1e-4, 1e-6
#: Held-out rows that the calibration uses at most (it needs a few numbers,
#: whatever the size of the table), and evidence values of them.
CALIBRATION, MOST_SCORES = 20_000, 2_000_000
#: Weights of the evidence tried first, and rounds of balancing.
WEIGHTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.5, 4.0)
ROUNDS = 8
#: Mean log likelihoods that differ by less count as equal.
SAME = 1e-4
#: Domains of the label column; a table with more is an error, not a sample.
MOST_DOMAINS = 1000
CHUNK = 1 << 20


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte-trigram counts of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), dtype=np.uint8)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, max(len(raw) - 2, 0), CHUNK):
        b = raw[i:i + CHUNK + 2].astype(np.uint32)
        code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
        total += np.bincount(code >> np.uint32(18), minlength=BUCKETS)
    return total


@dataclass
class Classifier:
    """Domains, their log probabilities of each trigram bucket, and the
    calibration: the weight of a text's evidence, each domain's bias, and its
    share of the labels (the posterior of a text without trigrams)."""

    domains: list[str]
    logs: np.ndarray
    weight: float = 1.0
    bias: np.ndarray | None = None
    share: np.ndarray | None = None

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihood of a text by domain, of at most ``EVIDENCE`` trigrams."""
        n = trigrams(text)
        at = np.flatnonzero(n)
        if not len(at):
            return np.zeros(len(self.domains))
        seen = n[at].sum()
        return self.logs[:, at] @ n[at] * (min(seen, EVIDENCE) / seen)

    def posterior(self, text: str | None) -> np.ndarray:
        even = np.full(len(self.domains), 1 / len(self.domains))
        evidence = self.evidence(text)
        if not evidence.any():
            return even if self.share is None else self.share
        return _posteriors(evidence[None], self.weight, 0 if self.bias is None else self.bias)[0]


def _posteriors(evidence: np.ndarray, weight: float, bias: np.ndarray) -> np.ndarray:
    odds = weight * evidence + bias
    p = np.exp(odds - odds.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _balanced(evidence: np.ndarray, weight: float, bias: np.ndarray, mass: np.ndarray, wanted: np.ndarray, rounds: int) -> np.ndarray:
    """The bias after ``rounds`` of scaling every domain's expected mass to the
    wanted one (half a row is added to both, so that none vanishes)."""
    some = mass.mean() / 2
    for _ in range(rounds):
        bias = bias + np.log((wanted + some) / (mass @ _posteriors(evidence, weight, bias) + some))
    return bias


def calibrated(classifier: Classifier, evidence: np.ndarray, labels: np.ndarray, tokens: np.ndarray) -> Classifier:
    """The classifier with the temperature and biases that held-out rows (their
    evidence, domain numbers and tokens) ask for."""
    d = len(classifier.domains)
    if not len(labels):
        return classifier
    one = np.ones(len(labels))
    wanted = np.bincount(labels, minlength=d).astype(float)
    start = np.log(wanted + 0.5) - np.log(len(labels) + 0.5 * d)

    def loss(weight: float) -> tuple[float, np.ndarray]:
        bias = _balanced(evidence, weight, start, one, wanted, ROUNDS)
        return -float(np.log(_posteriors(evidence, weight, bias)[np.arange(len(labels)), labels] + 1e-300).mean()), bias

    tried = {w: loss(w) for w in WEIGHTS}
    for _ in range(6):  # halve the steps around the best weight
        known = sorted(tried)
        at = known.index(min(tried, key=lambda w: tried[w][0]))
        for other in known[max(at - 1, 0):at] + known[at + 1:at + 2]:
            tried.setdefault((known[at] + other) / 2, None)
        tried = {w: x or loss(w) for w, x in tried.items()}
    best = min(x[0] for x in tried.values())
    weight = min(w for w, x in tried.items() if x[0] < best + SAME)  # of equal ones the least
    bias = tried[weight][1]
    if tokens.sum():
        bias = _balanced(evidence, weight, bias, tokens.astype(float), np.bincount(labels, weights=tokens, minlength=d), ROUNDS)
    return Classifier(classifier.domains, classifier.logs, weight, bias, (wanted + 0.5) / (len(labels) + 0.5 * d))


def train(documents: DataFrame, label: str = "source") -> Classifier:
    """A calibrated classifier from all rows with a label."""
    rows = documents.select(F.col(label).cast("string").alias("d"), "text", (remainder(F.col("doc_id"), 5) == 1).alias("held"),
                            F.xxhash64("doc_id", "text").alias("h")).where("d IS NOT NULL")
    domains = sorted(r[0] for r in rows.select("d").distinct().limit(MOST_DOMAINS + 1).collect())
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{label} has more than {MOST_DOMAINS} values")
    if not domains:
        return Classifier(["all"], np.zeros((1, BUCKETS)))
    index = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, t in zip(b["d"], b["text"]):
                total[index[d]] = total.get(index[d], 0) + trigrams(t)
        for i, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"d": i, "bucket": at, "n": n[at]})

    got = (rows.where("NOT held").select("d", "text").mapInPandas(count, "d int, bucket int, n long").groupBy("d", "bucket")
           .agg(F.sum("n").alias("n")).toPandas())  # at most domains x BUCKETS rows
    counts = np.full((len(domains), BUCKETS), 0.5)
    counts[got["d"], got["bucket"]] += got["n"]
    fitted = Classifier(domains, np.log(counts / counts.sum(1, keepdims=True)))
    # a bounded part of the held-out rows, chosen by hash, comes to the driver
    held = rows.where("held")
    most = min(CALIBRATION, MOST_SCORES // len(domains))
    share = most / max(held.count(), 1)
    if share < 1:
        held = held.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"d": [index[d] for d in b["d"]], "tokens": [_tokens(t) for t in b["text"]],
                                "e": [fitted.evidence(t) for t in b["text"]]})

    seen = held.select("d", "text").mapInPandas(score, "d int, tokens long, e array<double>").toPandas()
    if not len(seen):
        return fitted
    return calibrated(fitted, np.stack(seen["e"]), seen["d"].to_numpy(), seen["tokens"].to_numpy())


def _tokens(text: str | None) -> int:
    return len((text or "").encode("utf-8", "replace").split())


FACTS = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])


def facts_of(classifier: Classifier, text: Column) -> Column:
    """Tokens and posterior of a text column."""
    @F.pandas_udf(FACTS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({"tokens": [_tokens(t) for t in texts], "q": [classifier.posterior(t) for t in texts]})

    return of(text)


def _steps(q: np.ndarray, history: list[tuple[np.ndarray, float]], least: float = 0.0) -> np.ndarray:
    """Rates of at least ``least`` after the steps along the earlier scaled
    residuals, each carried on by its momentum."""
    return _last_step(q, history, least)[0]


def _last_step(q: np.ndarray, history: list[tuple[np.ndarray, float]], least: float) -> tuple[np.ndarray, float]:
    """The rates, and the largest move of the last step without momentum (the
    projected gradient)."""
    r = before = np.ones(len(q))
    moved = 0.0
    for residual, momentum in history:
        step = np.maximum(r - q @ residual, least)
        moved = float(np.abs(step - r).max(initial=0.0))
        r = np.maximum(step + momentum * (step - before), least)
        before = step
    return r, moved


def _raised(now: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The wanted tokens times the factor of 1 or more that fits ``now`` best."""
    scaled = np.divide(wanted, size, out=np.zeros_like(wanted, dtype=float), where=size > 0)
    return wanted * max(1.0, scaled @ now / (scaled @ wanted)) if scaled @ wanted > 0 else wanted


def fit(facts: DataFrame, domains: int, targets, least: float = 0.0) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """The scaled residuals and momenta of the steps of an accelerated
    projected gradient descent on rows ``tokens, q``, and by what share of its
    present tokens each domain's total then misses its target; ``targets`` maps
    present domain tokens to wanted ones, which are raised together as far as
    rates of at least ``least`` > 0 need. Warns, too, if the targets are not
    met to ``TOLERANCE``."""
    def totals(history: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, most = np.zeros(domains), 0.0
            for b in batches:
                if b.num_rows:
                    q = b.column("q").flatten().to_numpy().reshape(-1, domains)
                    r, moved = _last_step(q, history, least)
                    total += (r * b.column("tokens").to_numpy()) @ q
                    most = max(most, moved)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(domains), pa.int32()), pa.array(total), pa.array(np.full(domains, most))],
                                             names=["d", "v", "moved"])

        got = (facts.select("tokens", "q").mapInArrow(partial, "d int, v double, moved double").groupBy("d")
               .agg(F.sum("v").alias("v"), F.max("moved").alias("moved")).collect())
        out = np.zeros(domains)
        for r in got:
            out[r["d"]] = r["v"]
        return out, max((r["moved"] for r in got), default=0.0)

    history: list[tuple[np.ndarray, float]] = []
    now, moved = totals(history)
    size = now
    wanted = targets(size)
    age, last = 1.0, np.inf
    while True:
        # scaled by the domains' sizes the largest curvature is at most 1
        aim = _raised(now, wanted, size) if least else wanted
        residual = np.divide(now - aim, size, out=np.zeros(domains), where=size > 0)
        left = np.abs(residual).max(initial=0.0)
        if left < TOLERANCE:
            return history, residual
        if len(history) >= STEPS or history and moved < STILL:
            warnings.warn(f"mixing: after {len(history)} steps a domain is {left:.2g} of its size off its target "
                          f"(last move of a rate {moved:.2g})", stacklevel=2)
            return history, residual
        loss = float((residual ** 2 * size).sum())
        age = 1.0 if loss > last else age  # momentum that overshoots starts anew
        older, age, last = age, (1 + np.sqrt(1 + 4 * age * age)) / 2, loss
        history.append((residual, (older - 1) / age))
        now, moved = totals(history)


def default_targets(size: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Wanted tokens of each domain from its present tokens."""
    if not size.sum():
        return size
    share = size / size.sum()
    w = share ** TEMPERATURE if weights is None else np.asarray(weights, dtype=float)
    w = np.where(size > 0, w, 0)
    w = w / w.sum()
    return w * np.max(np.divide(size, w, out=np.zeros_like(size), where=w > 0))


def rated(documents: DataFrame, label: str = "source", weights: dict[str, float] | None = None,
          ) -> tuple[DataFrame, Classifier, list[tuple[np.ndarray, float]], np.ndarray]:
    """Rows ``doc_id, tk, tokens, q, rate``, with the classifier, the steps and
    each domain's miss."""
    spark = documents.sparkSession
    with bounded_batches(spark):
        classifier = train(documents, label)
        facts = written(documents.select("doc_id", text_key(F.col("text")).alias("tk"), facts_of(classifier, F.col("text")).alias("f"))
                        .select("doc_id", "tk", "f.*"), "mixing")
    own = None if weights is None else np.array([weights.get(d, 0.0) for d in classifier.domains])
    least = _least(weights)
    history, miss = fit(facts, len(classifier.domains), lambda size: default_targets(size, own), least)
    return facts.withColumn("rate", rate_of(history, F.col("q"), least)), classifier, history, miss


def _least(weights: dict[str, float] | None) -> float:
    """The least rate: the default targets keep every document."""
    return 1.0 if weights is None else 0.0


def rate_of(history: list[tuple[np.ndarray, float]], q: Column, least: float = 0.0) -> Column:
    @F.pandas_udf(T.DoubleType())
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(_steps(np.stack(v.to_numpy()), history, least) if len(v) else [], dtype=float)

    return of(q)


def copies_of(doc_id: Column, text: Column, rate: Column) -> Column:
    """How often a document of a rate appears."""
    draw = F.pmod(F.xxhash64(doc_id, text, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def domain_totals(documents: DataFrame, label: str = "source") -> DataFrame:
    """``doc_id, domain, posterior, tokens, rate`` of every document row, with
    its likeliest domain and that domain's ``miss``: by what share of its
    present tokens the domain's expected total is off its target."""
    rows, classifier, _, miss = rated(documents, label)
    best = F.array_position("q", F.array_max("q")).cast("int")
    names = F.array(*[F.lit(d) for d in classifier.domains])
    return rows.select("doc_id", F.element_at(names, best).alias("domain"), F.array_max("q").alias("posterior"), "tokens", "rate",
                       F.element_at(F.array(*[F.lit(float(m)) for m in miss]), best).alias("miss"))


def mixed(documents: DataFrame, label: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """The documents repeated to the target weights: their own columns, then
    ``mix_rate`` and ``mix_copy`` (1 to the number of copies; those two names
    are replaced if the input has them)."""
    _, classifier, history, _ = rated(documents, label, weights)
    facts = facts_of(classifier, F.col("text"))
    own = [c for c in documents.columns if c not in ("mix_rate", "mix_copy")]
    rate = rate_of(history, facts.getField("q"), _least(weights))
    out = documents.select(*[F.col(f"`{c}`") for c in own], rate.alias("mix_rate"))
    n = copies_of(F.col("doc_id"), F.col("text"), F.col("mix_rate"))
    return out.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("mix_copy"))
