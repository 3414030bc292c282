import pytest

from framescope.functions.classes import shape_frame
from framescope.sources.files import load_dataset
from framescope.sources.sinks import to_payload


def test_load_csv_roundtrip(spark, bodies_pdf, tmp_path):
    bodies_pdf.to_csv(tmp_path / "bodies.CSV", index=False)
    df = load_dataset(spark, str(tmp_path / "bodies.CSV"))
    assert dict(df.dtypes) == {"height": "double", "weight": "double", "side": "string"}
    assert sorted(map(tuple, df.collect())) == sorted(bodies_pdf.itertuples(index=False, name=None))


def test_sources_that_cannot_be_read(spark, tmp_path):
    for gone in (tmp_path / "none.csv", tmp_path / "none*.csv", tmp_path / "no" / "folder.parquet"):
        with pytest.raises(FileNotFoundError):
            load_dataset(spark, str(gone))
    (tmp_path / "sheet.ods").write_bytes(b"PK")
    with pytest.raises(ValueError, match="ods"):
        load_dataset(spark, str(tmp_path / "sheet.ods"))


def test_globs_and_urls(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"a,b\n{i},x\n")
    for path in (f"{tmp_path}/part*.csv", f"file://{tmp_path}/part[0-9].csv"):
        assert sorted(r["a"] for r in load_dataset(spark, path).collect()) == [0, 1, 2]


def test_codes_and_times_stay_text(spark, tmp_path):
    (tmp_path / "codes.csv").write_text(
        "code,clock,month,n,x,big,flag,at\n10D,12:30,2024-01,1,1e3,99999999999999999999,True,2024-01-02T03:04:05Z\n"
        "25F,09:15,2024-02,+2,.5,1,false,2024-02-03 04:05\n")
    types = dict(load_dataset(spark, str(tmp_path / "codes.csv")).dtypes)
    assert types == {"code": "string", "clock": "string", "month": "string", "n": "bigint", "x": "double",
                     "big": "double", "flag": "boolean", "at": "timestamp"}


def test_answers(spark, bodies_df):
    from framescope.operators import ask
    from framescope.sources.sinks import answer_kind, to_answer

    one, table = ask.row_count(bodies_df), ask.count_by_group(bodies_df, "side")
    assert to_answer(one) == {"scalar": 36} and answer_kind(one).first()["kind"] == "scalar"
    assert [r[0] for r in to_answer(table, keys=1)["table"]["rows"]] == ["right", "left"]
    assert to_answer(table.limit(1), keys=1) == {"scalar": 24}
    assert to_answer(table.limit(0), keys=1) == {"scalar": None}
    assert [answer_kind(t, 1).first()["kind"] for t in (table, table.limit(1), table.limit(0))] == ["table", "scalar", "none"]


def test_shape(bodies_df):
    row = shape_frame(bodies_df).first()
    assert (row["rows"], row["columns"]) == (36, 3)
    assert (row["numeric_columns"], row["categorical_columns"], row["datetime_columns"]) == (2, 1, 0)


def test_null_tokens_and_types(spark, tmp_path):
    path = tmp_path / "na.csv"
    path.write_text("a,b,c\n1,NA,x\n2,3.5,N/A\n,4,null\n")
    df = load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    rows = sorted(df.collect(), key=lambda r: (r["a"] is None, r["a"]))
    assert [r["b"] for r in rows] == [None, 3.5, 4.0]
    assert [r["c"] for r in rows] == ["x", None, None]


def test_latin1_fallback(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name,n\nJos\xe9,1\nZo\xeb,2\n".encode("latin-1"))
    df = load_dataset(spark, str(path))
    assert sorted(r["name"] for r in df.collect()) == ["José", "Zoë"]


def test_payload_is_plain_and_capped(spark):
    df = spark.range(500).selectExpr("id", "id / 3.0 AS x")
    p = to_payload(df, cap=200)
    assert p["truncated"] is True and len(p["rows"]) == 200
    assert all(type(v) in (int, float) for row in p["rows"] for v in row)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_table_formats_roundtrip(spark, bodies_df, tmp_path, fmt):
    from framescope.sources.sinks import write_result

    path = str(tmp_path / f"out.{fmt}")
    write_result(bodies_df, path, fmt=fmt)
    back = load_dataset(spark, path)
    assert back.count() == 36 and set(back.columns) == {"height", "weight", "side"}


def test_csv_quoting_and_multiline(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,note\n1,"a, b"\n2,"line one\nline two"\n3,plain\n')
    df = load_dataset(spark, str(path))
    notes = {r["id"]: r["note"] for r in df.collect()}
    assert notes == {1: "a, b", 2: "line one\nline two", 3: "plain"}


def test_dates_kept_as_text_on_request(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("day,v\n2024-01-01,1\n2024-01-02,2\n")
    assert dict(load_dataset(spark, str(path)).dtypes)["day"] == "timestamp"
    assert dict(load_dataset(spark, str(path), infer_dates=False).dtypes)["day"] == "string"


def test_all_missing_csv_column_is_numeric(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,empty\n1,\n2,NA\n")
    df = load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "empty": "double"}
