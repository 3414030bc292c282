"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
operations only.

An item's windows are its runs of ``window`` consecutive words (a shorter
item is one window). A window is the set of its word shingles; a document
contains it only if it has all of them, so it must have the window's rarest
one: with containment 1 the necessary prefix is a single shingle.

1. A first read of the documents counts the benchmark's shingles in all of
   them, which orders each window's shingles by rarity. A window with a
   shingle that no document has is out; of the others the rarest shingle, the
   prefix, goes on.
2. A second read keeps the positions of prefix shingles only, with the words
   around them, and joins them with the prefixes. In both reads a bit map of
   bounded size holds off the other positions before anything is shuffled;
   a fuller map lets more of them through to the join, which is exact.
3. The window must fit in the document at that position (positional and
   length bounds), and its words must equal the document's.

The documents are read twice, whatever the number and lengths of the items.

Defined cases: null or wordless texts hit nothing and have 0 words; a null
item id counts as the empty string; items that repeat an id count once;
repeated document rows each get their own result row; other columns are
ignored. Empty tables give empty results (no benchmark: nothing is hit)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.common import alnum_words, text_key, written

WINDOW, SHINGLE = 10, 3
#: Bits of the map of searched shingles at most, as a power of two (2 MB).
MAP_BITS = 24


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from a position on (fewer at the very end)."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _place(h: Column, bits: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a map of ``2 ** bits`` bits."""
    at = F.shiftrightunsigned(h, 64 - bits)
    return F.shiftrightunsigned(at, 6), at.bitwiseAND(63).cast("int")


def _may_be_in(h: Column, keys: DataFrame) -> Column:
    """Whether a hash may be among the distinct ``keys.h``: a bit map of about
    64 bits a key and ``2 ** MAP_BITS`` at most, filled by a subquery."""
    bits = min(MAP_BITS, max(6, (64 * keys.count() - 1).bit_length()))
    word, bit = _place(F.col("h"), bits)
    set_bits = keys.groupBy(word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b"))
    filled = (keys.sparkSession.range(1 << (bits - 6)).join(set_bits, F.col("id") == F.col("word"), "left")
              .agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))).alias("m")))
    word, bit = _place(h, bits)
    table = filled.select(F.col("m.b")).scalar()
    return F.call_function("shiftrightunsigned", F.get(table, word.cast("int")), bit).bitwiseAND(1) == 1


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``item, win`` of every item's windows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))),
        lambda i: F.slice("w", i, F.lit(window)))).alias("win")).distinct()


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
         ) -> tuple[DataFrame, DataFrame]:
    """``(base, found)``: every document row as ``doc_id, tk, n_words``, and
    the distinct ``doc_id, tk, item, start, len`` of windows that occur."""
    wins = written(windows(benchmark, window).withColumn("len", F.size("win")), "windows")
    sizes = sorted({min(r[0], shingle) for r in wins.select("len").distinct().collect()}) or [shingle]
    grams = None
    for k in sizes:
        of = wins.where(F.least("len", F.lit(shingle)) == k)
        part = of.select("item", "win", "len", F.posexplode("win").alias("off", "word")).where(F.col("off") + k <= F.col("len"))
        part = part.select("item", "win", "len", "off", _shingle(F.col("win"), F.col("off"), k).alias("h"))
        grams = part if grams is None else grams.unionAll(part)
    grams = written(grams, "grams")
    words = documents.select("doc_id", text_key(F.col("text")).alias("tk"), alnum_words(F.col("text")).alias("w"))
    # hashes of exploded positions, not of array elements: the whole pass is compiled, and only refers to the words
    rows = words.select("doc_id", "tk", "w", F.posexplode_outer("w").alias("p", "word"))
    hashes = [_shingle(F.col("w"), F.col("p"), k) for k in sizes]
    freq = (rows.where("p IS NOT NULL").select(F.explode(F.array(*hashes)).alias("h"))
            .where(_may_be_in(F.col("h"), grams.select("h").distinct())).groupBy("h").agg(F.count("*").alias("n")))
    prefix = (grams.join(freq, "h", "left").groupBy("item", "win", "len")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("r"))
              .where("r.n > 0").select("item", "win", "len", F.col("r.h").alias("h"), F.col("r.off").alias("off")))
    prefix = written(prefix, "prefixes")
    keys = prefix.select("h").distinct()
    found_any = functools.reduce(operator.or_, [_may_be_in(h, keys) for h in hashes])
    left = F.greatest(F.col("p") - (window - 1), F.lit(0))
    # the first position, null in a document without words, stands for the document, too
    table = written(rows.where(F.col("p").isNull() | (F.col("p") == 0) | found_any).select(
        "doc_id", "tk", F.col("p").alias("pos"), F.greatest(F.size("w"), F.lit(0)).alias("n_words"), left.alias("left"),
        F.array(*hashes).alias("hs"), F.slice("w", left + 1, F.lit(2 * window)).alias("around")), "shingles")
    base = table.where("coalesce(pos, 0) = 0").select("doc_id", "tk", "n_words")
    seen = table.where("pos IS NOT NULL").withColumn("h", F.explode("hs")).drop("hs")
    start = F.col("pos") - F.col("off")
    exact = F.slice("around", start - F.col("left") + 1, F.col("len")) == F.col("win")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    found = (seen.join(prefix, (seen.h == prefix.h) & inside & F.when(inside, exact))
             .select("doc_id", "tk", "item", start.alias("start"), "len").distinct())
    return base, found


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id, tk, n_words, n_hit, n_items,
    items_sha256, items, contaminated``; ``tk`` is the text's key."""
    base, found = hits(documents, benchmark, window)
    found = written(found, "found")
    order = Window.partitionBy("doc_id", "tk").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc_id", "tk", "start").agg((F.col("start") + F.max("len")).alias("end"))
    covered = (spans.withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
               .groupBy("doc_id", "tk")
               .agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).alias("n_hit")))
    items = (found.select("doc_id", "tk", "item").distinct().groupBy("doc_id", "tk")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    facts = covered.join(items, covered.doc_id.eqNullSafe(items.doc_id) & covered.tk.eqNullSafe(items.tk)).select(
        covered.doc_id.alias("d"), covered.tk.alias("t"), "n_hit", "items")
    joined = base.join(facts, base.doc_id.eqNullSafe(facts.d) & base.tk.eqNullSafe(facts.t), "left")
    return joined.select(
        "doc_id", "tk", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    bad = contaminated(documents, benchmark).where("contaminated").select(
        F.col("doc_id").alias("_bad_doc"), F.col("tk").alias("_bad_key")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_bad_doc"])
                          & text_key(documents["text"]).eqNullSafe(bad["_bad_key"]), "left_anti")
