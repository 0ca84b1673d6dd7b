import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from tillwise.operators import cleaning as c
from tillwise.operators import profiling as p


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [
        (1, None, "b", True), (2, 4.0, None, None), (3, float("nan"), "a", False),
        (4, 2.0, "a", True), (5, None, "b", True), (6, 6.0, None, None),
    ]
    return spark.createDataFrame(rows, "id int, num double, cat string, flag boolean")


@pytest.mark.parametrize(
    "strategy, num, cat",
    [
        ("mean", [4, 4, 4, 2, 4, 6], ["b", None, "a", "a", "b", None]),
        ("median", [4, 4, 4, 2, 4, 6], ["b", None, "a", "a", "b", None]),
        ("mode", [2, 4, 2, 2, 2, 6], ["b", "a", "a", "a", "b", "a"]),
        ("ffill", [None, 4, 4, 2, 2, 6], ["b", "b", "a", "a", "b", "b"]),
        ("bfill", [4, 4, 2, 2, 6, 6], ["b", "a", "a", "a", "b", None]),
    ],
)
def test_fills(gaps, strategy, num, cat):
    filled = c.fill_missing(gaps, strategy, ["num", "cat"], order_by=["id"])
    rows = filled.orderBy("id").select(F.nanvl("num", F.lit(None)).alias("num"), "cat").collect()
    assert [r["num"] for r in rows] == num
    assert [r["cat"] for r in rows] == cat


def test_drop_strategies(gaps):
    assert [r["id"] for r in c.fill_missing(gaps, "drop").orderBy("id").collect()] == [4]
    assert c.fill_missing(gaps, "drop_col", ["num"]).columns == ["id", "cat", "flag"]


def test_whole_column_missing_stays(spark):
    empty = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    for strategy in ("mean", "median", "mode"):
        assert [r["v"] for r in c.fill_missing(empty, strategy, ["v"]).collect()] == [None, None]


def test_fill_needs_order_and_known_strategy(gaps):
    with pytest.raises(ValueError, match="order_by"):
        c.fill_missing(gaps, "ffill", ["num"])
    with pytest.raises(ValueError, match="unknown strategy"):
        c.fill_missing(gaps, "guess", ["num"])


def test_strict_types(spark):
    df = spark.createDataFrame(
        [("1", " 2 ", "1.5", "2003-02-24", 2.7), ("3", "4", "x", "2003-03-01", -2.7)],
        "a string, b string, c string, d string, e double",
    )
    assert values(c.change_type(df, "b", "int64"), "b") == [(2,), (4,)]
    assert values(c.change_type(df, "e", "int64"), "e") == [(-2,), (2,)]
    assert values(c.change_type(df, "a", "float64"), "a") == [(1.0,), (3.0,)]
    assert [r["d"].date() for r in c.change_type(df, "d", "datetime64[ns]").orderBy("d").collect()] == [
        dt.date(2003, 2, 24), dt.date(2003, 3, 1),
    ]
    assert c.change_type(df, "a", "category").schema["a"].metadata == {"category": True}
    for column, target in (("c", "int64"), ("c", "float64"), ("c", "datetime64[ns]")):
        with pytest.raises(ValueError, match="convert"):
            c.change_type(df, column, target)
    with pytest.raises(ValueError, match="does not exist"):
        c.change_type(df, "zz", "int64")


def test_missing_does_not_become_a_whole_number(gaps):
    with pytest.raises(ValueError, match="convert"):
        c.change_type(gaps, "num", "int64")


def test_us_dates_with_times(spark):
    df = spark.createDataFrame([("2/24/2003 0:00",), ("11/6/2004 13:05",)], "d string")
    assert [r["d"] for r in c.change_type(df, "d", "datetime64[ns]").orderBy("d").collect()] == [
        dt.datetime(2003, 2, 24), dt.datetime(2004, 11, 6, 13, 5),
    ]


def test_replace(gaps):
    assert values(c.replace_value(gaps, "cat", "a", "z").where("cat = 'z'"), "id") == [(3,), (4,)]
    assert c.replace_value(gaps, "cat", "a", "").where("cat is null").count() == 4
    assert values(c.replace_value(gaps, "num", "2", "3").where("num = 3"), "id") == [(4,)]
    assert c.replace_value(gaps, "flag", "yes", "no").where("flag").count() == 0
    with pytest.raises(ValueError, match="cannot read"):
        c.replace_value(gaps, "num", "x", "3")


def test_label_codes_are_dense_and_sorted(gaps):
    codes = c.label_encode(gaps, "cat").orderBy("id").collect()
    assert [r["cat"] for r in codes] == [1, 2, 0, 0, 1, 2]


def test_one_hot_drops_first_and_keeps_missing_false(gaps):
    hot = c.one_hot(gaps, "cat")
    assert hot.columns == ["id", "num", "flag", "cat_b"]
    assert [r["cat_b"] for r in hot.orderBy("id").collect()] == [True, False, False, False, True, False]
    sparse = c.one_hot(gaps, "cat", "sparse")
    flags = [x for x in hot.columns if x.startswith("cat_")]
    named = sorted(next((f for f in flags if r[f]), "") for r in hot.collect())
    assert sorted(r["cat_set"] or "" for r in sparse.collect()) == named
    with pytest.raises(ValueError, match="unknown form"):
        c.one_hot(gaps, "cat", "wide")


def test_mode_of_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, None), (4, [3])], "id int, v array<int>")
    assert values(c.fill_missing(df, "mode"), "id", "v")[2] == (3, [1, 2])


def test_numbers_and_truths_as_text(spark):
    numbers = [12345678.0, 1e-4, 1.5e-5, 1e16, 123456789012345.67, -0.00025, 1.0, float("inf"), 1e22, 1e-300, 0.0, None]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, v double")
    got = [t for _, t in values(c.change_type(df, "v", "object"), "i", "v")]
    assert got == [None if v is None else repr(v) for v in numbers]
    found = c.find_and_replace(df, "v", "12345678.0", "X")
    assert found.where("v = 'X'").count() == 1
    truths = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, v boolean")
    assert values(c.change_type(truths, "v", "object"), "i", "v") == [(1, "True"), (2, "False"), (3, None)]


@pytest.mark.parametrize(
    "texts",
    [
        ["24/02/2003", "01/03/2003"], ["Feb 24, 2003", "Mar 1, 2003"], ["24-Feb-2003", "1-Mar-2003"],
        ["2/24/2003 1:05 PM", "3/1/2003 2:00 AM"], ["20030224", "20030301"], ["02/24/03", "03/01/03"],
        ["2003-02-24T10:00:00Z", "2003-03-01T00:00:00Z"], ["2003-02-24 10:00:00+00:00", "2003-03-01 00:00:00+00:00"],
    ],
)
def test_forms_of_dates(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    days = [v.strftime("%Y-%m-%d") for v, in values(c.change_type(df, "v", "datetime64[ns]"), "v")]
    assert days == ["2003-02-24", "2003-03-01"]


def test_iqr_and_scaling(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "v double")
    assert values(c.trim_outliers(df, "v"), "v") == [(1.0,), (2.0,), (3.0,), (4.0,)]
    flat = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    for method in ("minmax", "standard"):
        assert values(c.scale(flat, "v", method), "v") == [(0.0,), (0.0,)]
    assert c.scale(df, "v", "minmax").agg(F.max("v")).first()[0] == 1.0
    text = spark.createDataFrame([("a",)], "v string")
    assert c.trim_outliers(text, "v") is text and c.scale(text, "v") is text


def test_clean_text_keeps_letters_of_all_scripts(spark):
    df = spark.createDataFrame([("\t Très BIEN, «ok»! ½ a_b \n",), (None,)], "t string")
    assert values(c.clean_text(df, "t"), "t") == [(None,), ("très bien ok ½ a_b",)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("qty * price", 6.0), ("(qty + 1) * -price", -9.0), ("qty / 0", None), ("2 ** qty", 4.0),
        ("-7 % 3", 2), ("7 % -3", -2), ("`unit cost` + 1", 11.0), ("7 // 2", 3), ("qty > 1", True),
    ],
)
def test_formulas(spark, text, expected):
    df = spark.createDataFrame([(2, 3.0, 10.0)], ["qty", "price", "unit cost"])
    assert c.derive(df, "out", text).first()["out"] == expected


@pytest.mark.parametrize("text", ["__import__('os')", "qty.sum()", "nope + 1", "qty +", "'a' * qty", "[1]"])
def test_formulas_refuse_anything_else(spark, text):
    df = spark.createDataFrame([(2,)], ["qty"])
    with pytest.raises(ValueError):
        c.derive(df, "out", text)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Review.Text ", "Comments", "Stars"])
    assert c.standardise(df).columns == ["review_text", "comments", "rating"]
    both = spark.createDataFrame([(1, 2)], ["review", "text"])
    assert c.rename_aliases(both).columns == ["review_text", "text"]


def test_row_operators_work_on_streams(spark, tmp_path):
    spark.createDataFrame([("A!", 1), ("B", 2)], "t string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, n int").parquet(str(tmp_path / "in"))
    out = c.derive(c.clean_text(c.replace_value(stream, "n", 2, 5), "t"), "m", "n * 2")
    query = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [("a", 1, 2), ("b", 5, 10)]


def test_profile(gaps, spark):
    info = {r["column"]: r for r in p.dataset_info(gaps).collect()}
    assert (info["num"]["non_null"], info["num"]["null_count"], info["num"]["dtype"]) == (3, 3, "float64")
    assert info["num"]["is_categorical"] and info["num"]["is_numeric"]
    assert info["flag"]["is_categorical"] and info["flag"]["dtype"] == "bool"
    assert not p.dataset_info(spark.range(30)).first()["is_categorical"]
    assert not p.dataset_info(spark.range(0)).first()["is_categorical"]


def test_counts(gaps, spark):
    assert [tuple(r) for r in p.value_counts(gaps, "cat").collect()] == [("a", 2), ("b", 2), ("nan", 2)]
    assert tuple(p.uniqueness(gaps, "num").first()) == (4, 6)
    twice = spark.createDataFrame([(1, None), (1, None), (1, "x"), (1, None)], "a int, b string")
    assert p.duplicate_rows(twice).first()["duplicates"] == 2
    assert p.duplicate_rows(spark.range(0)).first()["duplicates"] == 0


def test_content_and_dates(spark):
    df = spark.createDataFrame([(1, "two words", "2020-1-2"), (2, None, "x"), (3, " a  b c ", "y")], "id int, t string, d string")
    row = p.content_stats(df, ["t"]).first()
    assert (row["avg_words"], row["avg_len"], row["uniqueness"]) == (2.5, 8.5, 1.0)
    assert row["non_null_ratio"] == pytest.approx(2 / 3)
    assert p.looks_like_date(df, "d", ["id"]).first()["is_date"]
    assert not p.looks_like_date(df, "t", ["id"]).first()["is_date"]
    assert p.numeric_ratio(df, ["id", "d"]).collect()[1]["valid_ratio"] == 0.0
