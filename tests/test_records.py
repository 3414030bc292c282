"""CSV files with quoted line breaks: split into records by quote parity, the
same rows as the sequential reader's."""

from __future__ import annotations

import csv
import random

import pytest

from framescope.sources import files, records


def whole(spark, path, encoding="UTF-8"):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, seed, n, newline="\n", encoding="utf-8"):
    rnd = random.Random(seed)
    cells = ["plain", "", 'say "hi"', "two\nlines", "a, b", "\n\n", '"', "x" * 50, "é ß", 'end"\n', "one\r\ntwo", " lead", "3.5", ",\n,\"\",\n"]
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "odd \"name\"", "c"])
        for i in range(n):
            out.writerow([i, rnd.choice(cells), rnd.choice(cells) * rnd.randrange(1, 4)])


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("newline, encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "latin-1")])
def test_split_records_equal_the_sequential_reader(spark, tmp_path, small_ranges, newline, encoding):
    for i in range(2):
        write(tmp_path / f"part{i}.csv", i, 400, newline, encoding)
    path, name = f"{tmp_path}/part*.csv", {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding]
    found = records.csv_records(spark, path, name)
    assert found is not None and found.count() == 800
    lines = records._lines(spark, path, name)
    ranges = records.open_ranges(lines)
    assert len(ranges) > 30 and any(ranges.values()) and not all(ranges.values())  # read by many tasks
    got = files.read_csv(spark, path, infer_types=False, null_tokens=())
    assert rows(got) == rows(whole(spark, path, name)) and got.columns == whole(spark, path, name).columns


def test_a_field_longer_than_many_ranges(spark, tmp_path, small_ranges):
    with open(tmp_path / "long.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerows([["a", "b"], [1, "short\n"], [2, "line of a long field\n" * 500], [3, "end"], [4, "x\ny"]])
    got = files.read_csv(spark, f"{tmp_path}/long.csv", infer_types=False)
    assert rows(got) == rows(whole(spark, f"{tmp_path}/long.csv"))


@pytest.mark.parametrize("text", [
    'a,b\n1,5" pipe\n2,"x\ny"\n3,6" pipe\n',  # quotes inside an unquoted field
    'a,b\n1,"x\ny" z\n2,w\n',  # text after a closing quote
    'a,b\n1,"x\ny\n2,w\n',  # never closed
    'a,b\r1,"x\ry"\r2,w\r',  # lone carriage returns
    'a,b\r\n1,"x\ny"\n2,w\n3,v\n4,u\r\n',  # mixed line ends
])
def test_files_that_break_the_rules_are_left_to_the_sequential_reader(spark, tmp_path, text):
    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode())
    assert records.csv_records(spark, str(path), "UTF-8") is None
    assert rows(files.read_csv(spark, str(path), infer_types=False, null_tokens=(), multi_line=True)) == rows(whole(spark, str(path)))


def test_empty_lines_short_and_long_records(spark, tmp_path):
    path = tmp_path / "gaps.csv"
    path.write_text('a,b\n\n1,"x\n\ny"\n\n2\n3,p,q\n"",\n,""\n')
    got = files.read_csv(spark, str(path), infer_types=False, null_tokens=())
    assert records.csv_records(spark, str(path), "UTF-8") is not None
    assert rows(got) == rows(whole(spark, str(path)))
