import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from tillwise.operators import cleaning as c
from tillwise.operators import history as h
from tillwise.sources.runlog import RunLog
from tillwise.sources.tables import NA_TOKENS, download_name, read_csv, save_csv, write_csv


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_latin_bytes_quotes_and_line_breaks(spark, tmp_path):
    raw = b'a,b\ncaf\xe9,1\n"x ""y"", z",2\n"two\nlines",3\n'
    df = read_csv(spark, write(tmp_path / "l.csv", raw), row_id="row")
    assert values(df, "row", "a", "b") == [(0, "café", 1), (1, 'x "y", z', 2), (2, "two\nlines", 3)]


def test_utf8_is_kept(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "u.csv", "a\ncafé €\n�\n".encode()))
    assert values(df, "a") == [("café €",), ("�",)]


def test_every_missing_token(spark, tmp_path):
    lines = "k,v\n" + "".join(f"{i},{t}\n" for i, t in enumerate(NA_TOKENS)) + "99,x\n"
    df = read_csv(spark, write(tmp_path / "n.csv", lines.encode()))
    assert df.where("v is not null").count() == 1


@pytest.mark.parametrize(
    "cells, kind",
    [
        (["1", "+2", ""], "bigint"), (["1", "2.5", "1e3"], "double"), (["1", "inf", "NA"], "double"), (["1d", "2"], "string"),
        (["True", "false", ""], "boolean"), (["2003-02-24", "x"], "string"), (["NA", ""], "double"),
        (["99999999999999999999", "1"], "double"),
    ],
)
def test_types(spark, tmp_path, cells, kind):
    data = "k,v\n" + "".join(f"r,{x}\n" for x in cells)
    df = read_csv(spark, write(tmp_path / "t.csv", data.encode()))
    assert df.schema["v"].dataType.simpleString() == kind
    assert df.count() == len(cells)


def test_round_trip_keeps_values(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", you', 1.5, dt.datetime(2024, 1, 2, 3, 4, 5, 678901)), (2, "a\nb\\", None, None)],
        "id long, t string, x double, at timestamp",
    )
    back = save_csv(df, str(tmp_path / "out"))
    assert values(back, "id", "t", "x") == values(df, "id", "t", "x")
    assert values(c.change_type(back, "at", "datetime64[ns]"), "id", "at") == values(df, "id", "at")
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(df, str(tmp_path / "out"))


def test_download_name():
    assert download_name("sales.2024.csv") == "sales.2024_preprocessed.csv"
    assert download_name("sales") == "sales_preprocessed.csv"


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.datasets().count() == 0
    df = spark.range(3)
    at = lambda hour: dt.datetime(2024, 5, 1, hour)
    log.upload("a", "a.csv", df, at(1))
    log.upload("b", "b.csv", df, at(2))
    assert [r["dataset_id"] for r in log.datasets().collect()] == ["b", "a"]
    log.opened("a", at(3))
    log.record("a", "reviews", df.withColumn("x", F.lit("old")), at(4))
    log.record("a", "reviews", df.withColumn("x", F.lit("new")), at(5))
    rows = log.datasets().collect()
    assert [r["dataset_id"] for r in rows] == ["a", "b"]
    assert rows[0]["has_reviews"] and not rows[0]["has_segmentation"] and not rows[1]["has_reviews"]
    assert (rows[0]["total_rows"], rows[0]["total_cols"], rows[0]["uploaded_at"]) == (3, 1, "May 01, 2024 01:00 AM")
    schema = df.withColumn("x", F.lit("")).schema
    assert values(log.restore("a", "reviews", schema), "id", "x") == [(0, "new"), (1, "new"), (2, "new")]
    assert log.restore("b", "reviews", schema).count() == 0
    log.delete("a", at(6))
    assert [r["dataset_id"] for r in log.datasets().collect()] == ["b"]
    log.upload("a", "a2.csv", df, at(7))
    assert [r["display_name"] for r in log.datasets().collect()] == ["a2.csv", "b.csv"]
    assert log.restore("a", "reviews", schema).count() == 0


def test_restored_rows_keep_their_order(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    df = spark.range(500).repartition(4).orderBy(F.desc("id"))
    log.record("a", "reviews", df)
    back = log.restore("a", "reviews", df.schema)
    assert values(back, "position", "id") == [(i + 1, 499 - i) for i in range(500)]
    log.record("a", "reviews", df.limit(0))
    assert log.restore("a", "reviews", df.schema).count() == 0


def test_surplus_fields_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, write(tmp_path / "s.csv", b"a,b\n1,2\n3,4,5\n"))
    short = read_csv(spark, write(tmp_path / "m.csv", b"a,b\n1,2\n3\n"))
    assert values(short, "a", "b") == [(1, 2), (3, None)]


def test_files_of_one_table_are_read_each_in_its_way(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    write(folder / "1.csv", b"a,b\ncaf\xe9,1\n")
    write(folder / "2.csv", 'a,b\n"two\nlines",2\n€,3\n'.encode())
    assert values(read_csv(spark, str(folder)), "b", "a") == [(1, "café"), (2, "two\nlines"), (3, "€")]


def test_saving_keeps_types(spark, tmp_path):
    rows = [(1, "007", dt.datetime(2024, 1, 2, 3, 4), "NA"), (2, "010", None, "x")]
    edits = h.EditHistory(spark.createDataFrame(rows, "id long, code string, at timestamp, note string"))
    edits.apply(c.change_type, "code", "category")
    edits.save(str(tmp_path / "out"))
    assert values(edits.current, "id", "code", "at", "note")[0] == rows[0]
    assert edits.current.schema["code"].metadata == {"category": True}
    assert read_csv(spark, str(tmp_path / "out")).count() == 2


def test_undo_is_the_inverse_of_apply(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(h, "LINEAGE_LIMIT", 2)
    df = spark.createDataFrame([(1, 4.0), (2, None)], "id long, v double")
    edits = h.EditHistory(df)
    edits.apply(c.fill_missing, "mean", ["v"])
    edits.apply(c.derive, "w", "v * 2")
    before = values(edits.current, "id", "v", "w")
    edits.apply(c.fill_missing, "drop_col", ["w"])
    assert edits.unsaved == 3
    assert values(edits.undo(), "id", "v", "w") == before == [(1, 4.0, 8.0), (2, 4.0, 8.0)]
    edits.save(str(tmp_path / "saved"))
    assert edits.unsaved == 0 and values(edits.current, "id", "v", "w") == before
    with pytest.raises(ValueError, match="nothing to undo"):
        edits.undo()
