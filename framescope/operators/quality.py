"""Data-quality operators.

Every operator is a handful of aggregates over the canonical frame (NaN ->
null). Per-column facts are computed in ONE wide aggregation (one scan, no
shuffle beyond the single-row final merge) and then turned long with
``inline`` over a one-row array, so the output is a small frame with a
fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonicalize, qcol
from ..functions.classes import classify
from ..functions.text import fill
from ..session import written

# The numeric-looking test used on text columns.
NUMERIC_TEXT_STRIP = r"[,$%\s]"
NUMERIC_TEXT_PATTERN = r"^-?\d+\.?\d*$"
NUMERIC_TEXT_SHARE = 0.8
NEAR_EMPTY_LOW = 0.9
#: Size of the bit map of repeated hashes at most (8 MB).
MAP_BITS = 26
# The suggestion texts.
MISSING_TEXT = "Fill or drop {} missing values across {} column(s)."
DUPLICATES_TEXT = "Remove {} duplicate row(s)."
EMPTY_TEXT = "Drop fully empty column(s): {}."
NEAR_EMPTY_TEXT = "Review near-empty column(s) (>90% missing): {}."
NUMERIC_TEXT_TEXT = "Convert text-formatted numeric column(s) to numeric type: {}."
NO_ISSUES_TEXT = "No major data quality issues detected."


def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.StructType):
        return any(_holds_map(f.dataType) for f in t.fields)
    return isinstance(t, T.ArrayType) and _holds_map(t.elementType)


def _groupable(df: DataFrame, name: str) -> Column:
    """Values that are or hold a map cannot be grouped, compared or hashed;
    use their JSON text."""
    if _holds_map(df.schema[name].dataType):
        return F.to_json(qcol(name)).alias(name)
    return qcol(name)


def missing_by_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Q1: ``column, missing, total`` (missing = null or NaN), schema order."""
    df = canonicalize(df)
    cols = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("__total"),
        *[F.count(qcol(c)).alias(f"__nn{i}") for i, c in enumerate(cols)],
    )
    items = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            (F.col("__total") - F.col(f"__nn{i}")).alias("missing"),
            F.col("__total").alias("total"),
        )
        for i, c in enumerate(cols)
    ])
    out = wide.select(F.inline(items))
    if only_missing:
        out = out.where(F.col("missing") > 0)
    return out


def missing_total(df: DataFrame) -> DataFrame:
    """Q2: total missing cells and number of columns with any missing."""
    m = missing_by_column(df)
    return m.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_values"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    )


def empty_columns(df: DataFrame) -> DataFrame:
    """Q4: columns whose values are all missing (true for a zero-row frame)."""
    return missing_by_column(df).where(F.col("missing") == F.col("total")).select("position", "column")


def near_empty_columns(df: DataFrame) -> DataFrame:
    """Q5: ``0.9 <= missing share < 1.0``."""
    m = missing_by_column(df).where(F.col("total") > 0)
    share = F.col("missing") / F.col("total")
    return m.where((share >= NEAR_EMPTY_LOW) & (share < 1.0)).select(
        "position", "column", F.round(share, 4).alias("missing_share")
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns that hold at least one value.

    Needs the non-null counts first (one aggregation job), then returns a
    lazy projection of the input.
    """
    canon = canonicalize(df)
    if not df.columns:
        return df
    row = canon.agg(*[F.count(qcol(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if row[f"c{i}"] > 0]
    return df.select(*[qcol(c) for c in keep])


def _hash_input(df: DataFrame, name: str) -> Column:
    """Column as fed to the row hash: maps as JSON text, -0.0 as 0.0 (the
    grouping treats them as equal, the hash would not)."""
    t = df.schema[name].dataType
    if _holds_map(t):
        return F.to_json(qcol(name))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return qcol(name) + F.lit(0.0)
    return qcol(name)


def _nested_float(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _nested_float(t.elementType) or isinstance(t.elementType, (T.FloatType, T.DoubleType))
    if isinstance(t, T.StructType):
        return any(_nested_float(f.dataType) or isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in t.fields)
    return False


def _row_hash(df: DataFrame, cols: list[str]) -> Column:
    """Hash that equal rows share. Arrays and structs of floats are left to
    the comparison by value (it treats -0.0 and 0.0 inside them as equal)."""
    fed = [_hash_input(df, c) for c in cols if _holds_map(df.schema[c].dataType) or not _nested_float(df.schema[c].dataType)]
    return F.xxhash64(*fed) if fed else F.lit(0).cast("long")


def duplicate_candidates(df: DataFrame, subset: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows as ``_0, _1, ...`` with their hash ``_h``, hashes ``_c`` seen
    more than once). The second frame groups by the hash alone: 8 bytes per
    row cross the shuffle, partially aggregated."""
    cols = subset or df.columns
    keys = [_groupable(df, c).alias(f"_{i}") for i, c in enumerate(cols)]
    hashed = df.select(_row_hash(df, cols).alias("_h"), *keys)
    candidates = hashed.groupBy(F.col("_h").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_c")
    return hashed, candidates


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Q3: rows beyond the first of each identical row (nulls compare equal);
    one row ``duplicates`` (computed when called).

    Exact, in two steps sized for very large tables:

    1. group by a 64-bit hash of the row (8 bytes shuffled per row instead
       of the row, partially aggregated); a hash seen once is a row
       without a duplicate, since identical rows hash alike;
    2. only rows whose hash was seen more than once (a semi-join on the
       hash) are grouped by their full values, which also settles hash
       collisions.

    Not ``count_distinct``, which skips rows holding a null.
    """
    spark = df.sparkSession
    df = canonicalize(df)
    hashed, candidates = duplicate_candidates(df, subset)
    rows = hashed.join(candidates, F.col("_h") == F.col("_c"), "left_semi").drop("_h")
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")).first()[0]
    return spark.createDataFrame([(total,)], "duplicates bigint")


def _bit_of(h: Column, bits: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a map of ``2 ** bits`` bits."""
    place = F.shiftrightunsigned(h, 64 - bits)
    return F.shiftrightunsigned(place, 6), place.bitwiseAND(63).cast("int")


def _may_repeat(h: Column, repeated: DataFrame, n: int) -> Column:
    """Whether a row's hash may be among the ``n`` hashes ``_c``: a bit map of
    about sixteen bits a hash and ``2 ** MAP_BITS`` at most, so that its size
    is bounded; a fuller map only lets more rows be compared."""
    bits = min(MAP_BITS, max(10, (16 * n - 1).bit_length()))
    word, bit = _bit_of(F.col("_c"), bits)
    rows = repeated.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).collect()
    words = [0] * (1 << (bits - 6))
    for r in rows:  # at most a row a word
        words[r["w"]] = r["b"]
    table = repeated.sparkSession.createDataFrame([(words,)], "words array<long>").scalar()
    word, bit = _bit_of(h, bits)
    return F.call_function("shiftrightunsigned", F.get(table, word.cast("int")), bit).bitwiseAND(1) == 1


def dedup_rows(df: DataFrame, drop_duplicates: bool = True, drop_empty: bool = True) -> DataFrame:
    """Q7: drop fully empty columns, then identical rows.

    A first read groups 64-bit hashes of the rows (8 bytes a row shuffled,
    partially aggregated). Rows whose hash occurs once have no duplicate and
    pass without a shuffle; a bit map of the other hashes, bounded in size,
    tells them apart where they are read. The rest, and the few rows that
    share a bit with them, are compared by all their values."""
    out = drop_empty_columns(df) if drop_empty else df
    if not drop_duplicates or not out.columns:
        return out
    out = canonicalize(out)
    hashes = out.select(_row_hash(out, out.columns).alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = written(hashes.select("_c"), "repeated")
    n = repeated.count()
    if not n:
        return out
    maybe = _may_repeat(_row_hash(out, out.columns), repeated, n)
    return out.where(~maybe).unionByName(_compared(out.where(maybe)))


def _compared(out: DataFrame) -> DataFrame:
    """One of each set of rows with equal values."""
    maps = [f.name for f in out.schema.fields if _holds_map(f.dataType)]
    if not maps:
        return out.dropDuplicates()
    # maps cannot be compared: de-duplicate on their JSON text
    keyed = out.select("*", *[F.to_json(qcol(m)).alias(f"__json{i}") for i, m in enumerate(maps)])
    subset = [c for c in out.columns if c not in maps] + [f"__json{i}" for i in range(len(maps))]
    return keyed.dropDuplicates(subset).select(*[qcol(c) for c in out.columns])


def numeric_as_text(df: DataFrame, sample_rows: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Q6: text columns whose non-missing values look numeric.

    ``column, checked, numeric_like, share, flagged``; one wide aggregation
    over all values of all text columns. With ``sample_rows``, only each
    column's first so many non-missing values by ``order_by`` are checked
    (each partition keeps that many a column before the shuffle).
    """
    df = canonicalize(df)
    text_cols = classify(df).categorical
    if sample_rows is not None:
        if not order_by:
            raise ValueError("a sample of first values needs an order key")
        place = {c: i for i, c in enumerate(df.columns)}
        items = F.array(*[F.struct(F.lit(place[c]).alias("position"), F.lit(c).alias("column"), qcol(c).cast("string").alias("_s"))
                          for c in text_cols] or [F.lit(None).cast("struct<position: int, column: string, _s: string>")])
        long = df.select(F.struct(*[qcol(c) for c in order_by]).alias("_o"), F.inline(F.array_compact(items))).where(F.col("_s").isNotNull())
        first = long.withColumn("_i", F.row_number().over(Window.partitionBy("position").orderBy("_o", "_s"))).where(F.col("_i") <= sample_rows)
        like = F.regexp_replace("_s", NUMERIC_TEXT_STRIP, "").rlike(NUMERIC_TEXT_PATTERN)
        checked = first.groupBy("position", "column").agg(F.count(F.lit(1)).alias("checked"), F.count_if(like).alias("numeric_like"))
        part = F.col("numeric_like") / F.col("checked")
        return checked.withColumn("share", F.round(part, 4)).withColumn("flagged", part > NUMERIC_TEXT_SHARE)
    if not text_cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, checked bigint, numeric_like bigint, share double, flagged boolean"
        )
    aggs = []
    for i, c in enumerate(text_cols):
        s = qcol(c).cast("string")
        like = F.regexp_replace(s, NUMERIC_TEXT_STRIP, "").rlike(NUMERIC_TEXT_PATTERN)
        aggs += [F.count(s).alias(f"n{i}"), F.count_if(like).alias(f"k{i}")]
    wide = df.agg(*aggs)
    positions = {c: i for i, c in enumerate(df.columns)}
    items = F.array(*[
        F.struct(
            F.lit(positions[c]).alias("position"), F.lit(c).alias("column"),
            F.col(f"n{i}").alias("checked"), F.col(f"k{i}").alias("numeric_like"),
        )
        for i, c in enumerate(text_cols)
    ])
    share = F.col("numeric_like") / F.col("checked")
    return (
        wide.select(F.inline(items))
        .where(F.col("checked") > 0)
        .withColumn("share", F.round(share, 4))
        .withColumn("flagged", share > NUMERIC_TEXT_SHARE)
    )


def quality_fact_aggs(df: DataFrame) -> list[Column]:
    """Aggregate expressions behind :func:`quality_facts` (canonical frame)."""
    cols = df.columns
    text_cols = classify(df).categorical
    aggs = [F.count(F.lit(1)).alias("__total")] + [F.count(qcol(c)).alias(f"__nn{i}") for i, c in enumerate(cols)]
    for j, c in enumerate(text_cols):
        s = qcol(c).cast("string")
        like = F.regexp_replace(s, NUMERIC_TEXT_STRIP, "").rlike(NUMERIC_TEXT_PATTERN)
        aggs.append(F.count_if(like).alias(f"__k{j}"))
    return aggs


def quality_facts_from_row(df: DataFrame, row) -> tuple[DataFrame, DataFrame]:
    """(missing counts, numeric-looking text) frames from an aggregation row
    holding :func:`quality_fact_aggs`."""
    cols = df.columns
    text_cols = classify(df).categorical
    spark = df.sparkSession
    total = row["__total"]
    missing = spark.createDataFrame(
        [(i, c, total - row[f"__nn{i}"], total) for i, c in enumerate(cols)],
        "position int, column string, missing bigint, total bigint")
    pos = {c: i for i, c in enumerate(cols)}
    nat_rows = []
    for j, c in enumerate(text_cols):
        n, k = row[f"__nn{pos[c]}"], row[f"__k{j}"]
        if n > 0:
            nat_rows.append((pos[c], c, n, k, round(k / n, 4), k / n > NUMERIC_TEXT_SHARE))
    nat = spark.createDataFrame(
        nat_rows, "position int, column string, checked bigint, numeric_like bigint, share double, flagged boolean")
    return missing, nat


def quality_facts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing counts and numeric-as-text counts from ONE aggregation,
    returned as two local relations (one row per column)."""
    df = canonicalize(df)
    return quality_facts_from_row(df, df.agg(*quality_fact_aggs(df)).first())


def quality_report(df: DataFrame, facts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Q9: one row with every quality fact of the table.

    ``total_rows, total_columns, missing_values, columns_with_missing,
    missing_columns, duplicates, numeric_columns, categorical_columns, datetime_columns,
    empty_columns, near_empty_columns, suspected_numeric_as_text``.
    Column lists keep schema order.
    """
    from ..session import run_concurrently

    cls = classify(df)
    # the column facts and the duplicate count are independent jobs
    (m, nat_frame), dup = run_concurrently(
        (lambda: facts) if facts is not None else (lambda: quality_facts(df)),
        lambda: duplicate_rows(df),
    )
    ordered = F.array_sort(
        F.collect_list(F.struct("position", "column")), lambda a, b: a["position"] - b["position"]
    )
    by_missing = m.agg(
        F.first("total", ignorenulls=True).alias("total_rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_values"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("position", "column", "missing", "total"))),
                     lambda s: s["missing"] > 0),
            lambda s: s["column"]).alias("missing_columns"),
        F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("position", "column", "missing", "total"))),
                     lambda s: s["missing"] == s["total"]),
            lambda s: s["column"]).alias("empty_columns"),
        F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("position", "column", "missing", "total"))),
                     lambda s: (s["total"] > 0) & (s["missing"] / s["total"] >= NEAR_EMPTY_LOW)
                     & (s["missing"] < s["total"])),
            lambda s: s["column"]).alias("near_empty_columns"),
    )
    nat = nat_frame.where("flagged").agg(
        F.transform(ordered, lambda s: s["column"]).alias("suspected_numeric_as_text")
    )
    # One-row facts are attached as scalar subqueries: each runs once and
    # is inlined as a value, no join.
    return by_missing.select(
        F.coalesce("total_rows", F.lit(0)).cast("long").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        "missing_values", "columns_with_missing", "missing_columns",
        F.lit(dup.first()["duplicates"]).cast("long").alias("duplicates"),
        F.lit(len(cls.numeric)).alias("numeric_columns"),
        F.lit(len(cls.categorical)).alias("categorical_columns"),
        F.lit(len(cls.datetime)).alias("datetime_columns"),
        "empty_columns", "near_empty_columns",
        F.coalesce(nat.scalar(), F.array().cast("array<string>")).alias("suspected_numeric_as_text"),
    )


def quality_columns(df: DataFrame) -> DataFrame:
    """Q9 in detail: ``position, column, class, missing, empty, near_empty``
    of every column (the report's name lists and missing counts)."""
    cls = classify(df)
    kinds = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(cls.of(c)))])
    share = F.col("missing") / F.col("total")
    empty = F.col("missing") == F.col("total")
    return missing_by_column(df).select(
        "position", "column", kinds[F.col("column")].alias("class"), "missing", empty.alias("empty"),
        F.coalesce(~empty & (share >= NEAR_EMPTY_LOW), F.lit(False)).alias("near_empty"))


def quality_issues(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Q8: the issue list (``rank, issue, columns, n, message``), or one
    ``no_issues`` row. Built from the one-row report (pass it in when
    already computed); at most five rows."""
    r = report if report is not None else quality_report(df)
    join = lambda c: F.array_join(c, ", ")
    issues = F.array(
        F.when(F.col("missing_values") > 0, F.struct(
            F.lit(1).alias("rank"), F.lit("missing_values").alias("issue"),
            F.col("missing_columns").alias("columns"), F.col("missing_values").alias("n"),
            fill(MISSING_TEXT, F.col("missing_values").cast("string"),
                 F.col("columns_with_missing").cast("string")).alias("message"))),
        F.when(F.col("duplicates") > 0, F.struct(
            F.lit(2).alias("rank"), F.lit("duplicates").alias("issue"),
            F.array().cast("array<string>").alias("columns"), F.col("duplicates").alias("n"),
            fill(DUPLICATES_TEXT, F.col("duplicates").cast("string")).alias("message"))),
        F.when(F.size("empty_columns") > 0, F.struct(
            F.lit(3).alias("rank"), F.lit("empty_columns").alias("issue"),
            F.col("empty_columns").alias("columns"), F.size("empty_columns").cast("long").alias("n"),
            fill(EMPTY_TEXT, join(F.col("empty_columns"))).alias("message"))),
        F.when(F.size("near_empty_columns") > 0, F.struct(
            F.lit(4).alias("rank"), F.lit("near_empty_columns").alias("issue"),
            F.col("near_empty_columns").alias("columns"), F.size("near_empty_columns").cast("long").alias("n"),
            fill(NEAR_EMPTY_TEXT, join(F.col("near_empty_columns"))).alias("message"))),
        F.when(F.size("suspected_numeric_as_text") > 0, F.struct(
            F.lit(5).alias("rank"), F.lit("numeric_as_text").alias("issue"),
            F.col("suspected_numeric_as_text").alias("columns"),
            F.size("suspected_numeric_as_text").cast("long").alias("n"),
            fill(NUMERIC_TEXT_TEXT, join(F.col("suspected_numeric_as_text"))).alias("message"))),
    )
    found = r.select(F.array_compact(issues).alias("issues"))
    none_row = F.array(F.struct(
        F.lit(0).alias("rank"), F.lit("no_issues").alias("issue"),
        F.array().cast("array<string>").alias("columns"), F.lit(0).cast("long").alias("n"),
        F.lit(NO_ISSUES_TEXT).alias("message"),
    ))
    return found.select(
        F.inline(F.when(F.size("issues") > 0, F.col("issues")).otherwise(none_row))
    )
