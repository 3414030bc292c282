"""Samples by hash, first values, and distinct counts by bit maps."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest

from framescope.operators import charts, quality, stats
from framescope.operators.sample import hash_sample


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def test_samples_do_not_depend_on_partitions_and_are_nested(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = sorted(range(2000), key=md5)
    for parts in (1, 7):
        got = [r["k"] for r in hash_sample(df.repartition(parts), ["k"], rows=25).collect()]
        assert got == want[:25]
        some = {r["k"] for r in hash_sample(df.repartition(parts), ["k"], fraction=0.2).collect()}
        assert some == {x for x in range(2000) if md5(x)[:8] < f"{int(0.2 * 2 ** 32):08x}"}
    assert {r["k"] for r in hash_sample(df, ["k"], fraction=0.1).collect()} < some
    assert hash_sample(df, ["k"], fraction=0.0).count() == 0 and hash_sample(df, ["k"], fraction=1.0).count() == 2000
    for bad in ({}, {"rows": 1, "fraction": 0.5}, {"fraction": 1.5}):
        with pytest.raises(ValueError):
            hash_sample(df, ["k"], **bad)


def test_scatter_sample_keeps_missing_values(spark):
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(50)], "x long, y double")
    assert charts.scatter_pairs(df, "x", "y", sample_rows=50).count() == 50
    assert charts.scatter_pairs(df, "x", "y", sample_fraction=0.5).columns == ["x", "y"]


def test_first_values_that_look_numeric(spark):
    rows = [(i, None if i < 3 else "$1,2" if i < 8 else "word", "w") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t string, u string")
    got = {r["column"]: (r["position"], r["checked"], r["numeric_like"], r["share"], r["flagged"])
           for r in quality.numeric_as_text(df, sample_rows=5, order_by=["k"]).collect()}
    assert got == {"t": (1, 5, 5, 1.0, True), "u": (2, 5, 0, 0.0, False)}
    assert quality.numeric_as_text(df, sample_rows=17, order_by=["k"]).where("column = 't'").first()["flagged"] is False
    assert quality.numeric_as_text(df.select("k"), sample_rows=5, order_by=["k"]).count() == 0
    with pytest.raises(ValueError):
        quality.numeric_as_text(df, sample_rows=5)


def test_distinct_numbers_by_bit_maps(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(-40_000, 40_000), rnd.randrange(-2 ** 62, 2 ** 62), dt.date(2000, 1, 1) + dt.timedelta(rnd.randrange(900)),
             rnd.choice([None, 1, 2]), None) for _ in range(9000)]
    df = spark.createDataFrame(rows, "near long, far long, day date, few int, none int")
    assert stats._dense(df, df.columns) == ["day", "few"] or stats._dense(df, df.columns) == ["near", "day", "few"]
    want = {c: len({r[i] for r in rows if r[i] is not None}) for i, c in enumerate(df.columns)}
    assert stats.exact_distinct(df, df.columns) == want
    assert stats._counted_bits(df, ["near", "day", "few", "none"]) == {c: want[c] for c in ("near", "day", "few", "none")}
