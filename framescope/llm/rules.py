"""Quality rules with host verdicts, in DataFrame operations only.

Each document is measured inside its own row (no shuffle). Rule failures are
then summed by host (``source``; null is a host of its own), each host's
failure rate of a rule is shrunk towards all hosts' rates by an empirical
beta prior, and a host whose shrunk rate of any rule passes ``max_rate``
takes its documents with it.

The prior of a rule is fitted by the moments of a beta-binomial: with m the
rate over all N documents of H hosts, S the squared distances of the hosts' rates
from m, each by its documents n, and no spread between hosts at all, S would be
``m (1 - m) (H - 1)`` by chance alone. What is above that gives the correlation
inside hosts, ``(S / (m (1 - m)) - (H - 1)) / (N - sum(n^2) / N - (H - 1))``, and the
prior's size is one less than its inverse, held in [``LEAST``, ``MOST``] (``MOST``
where there is none, or every host has one document). So a host of few documents
is judged mostly by the prior and a large one by its
own. Defined cases: null and empty texts have no words and fail; hosts or
tables without rows give no rows; repeated rows count each; other columns
are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import SPACES, let, space_words, written

SYMBOLS = "#*$%&|<>"
LEAST, MOST = 2.0, 1000.0
#: A host goes when a rule's shrunk failure rate passes this.
MAX_RATE = 0.6
SPAN = 5


def _repeated(words: Column) -> Column:
    """Words inside ``SPAN``-word windows that occur twice or more."""
    def covered(at: Column) -> Column:
        step = F.transform(F.sequence(F.lit(1), F.size(at) - 1),
                           lambda i: F.least(F.get(at, i) - F.get(at, i - 1), F.lit(SPAN)))
        return F.when(F.size(at) < 2, F.lit(0)).otherwise(
            F.aggregate(step, F.lit(SPAN), lambda a, x: a + x))

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"])
                         | (x["h"] == F.get(pairs, i + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    def search(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, places))

    def over(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - SPAN),
                             lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SPAN)]))
        return F.when(F.size(ws) <= SPAN, F.lit(0)).otherwise(let(hashes, search))

    return let(words, over)


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words`` (counts as bigint) of every document row. Windows are
    told apart by a 64-bit hash within their own document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    worded = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = {
        "n_words": let(space_words(F.col("text")), F.size),
        "word_chars": F.length(bare),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(worded),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(space_words(F.col("text"))),
    }
    return documents.select("doc_id", "source", *[c.cast("bigint").alias(n) for n, c in counts.items()])


def _failures() -> dict[str, Column]:
    """The rules, each true where a document fails it."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * chars,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def prior_size(m: float, spread: float, n: int, hosts: int, squares: float) -> float:
    """Size of a rule's beta prior (see the module)."""
    room = n - squares / n - (hosts - 1)
    excess = spread / (m * (1 - m)) - (hosts - 1) if 0 < m < 1 else 0.0
    if excess <= 0 or room <= 0:
        return MOST
    return min(MOST, max(LEAST, room / excess - 1))


def host_rates(measured: DataFrame) -> DataFrame:
    """``source, n, rate_<rule>``: each host's shrunk failure rates."""
    rules = _failures()
    hosts = written(measured.groupBy("source").agg(
        F.count("*").alias("n"), *[F.sum(c.cast("int")).alias(r) for r, c in rules.items()]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.pow(F.col("n"), 2)).alias("squares"),
                      *[F.sum(r).alias(r) for r in rules]).first()
    n = total["n"] or 1
    means = {r: (total[r] or 0) / n for r in rules}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - means[r], 2)).alias(r) for r in rules]).first()
    rates = []
    for r, m in means.items():
        size = prior_size(m, spread[r] or 0.0, n, total["hosts"], total["squares"] or 0.0)
        rates.append(((F.col(r) + size * m) / (F.col("n") + size)).alias(f"rate_{r}"))
    return hosts.select("source", "n", *rates)


def judged(documents: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``measures`` of every document with ``base_failed``, ``host_rejected``
    and ``kept``."""
    measured = written(measures(documents), "measures")
    rates = host_rates(measured)
    worst = F.greatest(*[c for c in rates.columns if c.startswith("rate_")])
    verdicts = rates.select(F.col("source").alias("host"), (worst > max_rate).alias("host_rejected"))
    rules = _failures()
    base = rules["short"] | rules["repeats"]
    joined = measured.join(verdicts, measured["source"].eqNullSafe(verdicts["host"]), "left")
    return joined.select(*measured.columns, base.alias("base_failed"), "host_rejected",
                         (~base & ~F.col("host_rejected")).alias("kept"))
