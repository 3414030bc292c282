"""Exact dedup against a dictionary, with tables so small that they spill."""

from __future__ import annotations

import hashlib
import random

import pyarrow.fs as fs
import pytest

from framescope.llm import exact

SCHEMA = "doc_id long, text string, rep string, n double, ids int, kept boolean"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = ids.index(keep)
        out += [(str(i), str(keep), len(ids), k == first, sha) for k, i in enumerate(ids)]
    return sorted(out)


def answers(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def table(rows, spark):
    return spark.createDataFrame([r + ("r", 1.0, 2, False) for r in rows], SCHEMA)


@pytest.mark.parametrize("limit", [None, 2000, 40])
def test_dedup_equals_brute_force(spark, limit):
    rnd = random.Random(5)
    words = ["One", "one", "TWO", "two", "É", "é", "ß", "three"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 5))) for _ in range(400)] + ["long " * 4000] * 3 + [None, "", None]
    rows = [(rnd.choice([i, i, None, 7]), t) for i, t in enumerate(texts)] + [(10_000 + i, "Hot text") for i in range(700)]
    assert answers(exact.deduplicated(table(rows, spark).repartition(6), limit)) == brute(rows)


def test_equal_hashes_are_told_apart_by_content():
    t = exact.ContentTable(4)
    assert [t.place(1, c) for c in (b"a", b"b", b"a", b"c", b"b", b"d", b"e")] == [0, 1, 0, 2, 1, 3, 4]


def test_buckets_are_cut_until_they_fit_and_leave_no_file(tmp_path):
    texts = [f"text number {i}".encode() for i in range(300)] * 2 + [b"x" * 500]
    records = [(1, c, [i], [1], [i]) for i, c in enumerate(texts)]  # one hash for all: only other hashes cut them
    got = sorted(exact.grace(iter(records), 64, f"file://{tmp_path}/spill"))
    assert [(r[0], r[1], r[2]) for r in got] == [(i, i if i >= 300 else i + 300, 2) for i in range(600)] + [(600, 600, 1)]
    assert not fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/spill"))


def test_dedup_of_an_empty_table_and_documents_kept(spark):
    assert exact.deduplicated(table([], spark)).count() == 0
    rows = [(1, "A b"), (2, "a B"), (3, None), (5, "")]
    out = exact.keep_distinct(table(rows, spark))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5] and out.columns == table(rows, spark).columns
