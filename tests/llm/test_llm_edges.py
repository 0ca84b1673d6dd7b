"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tillwise.llm import chat, decontaminate, licenses, lm_score, mixing, odd_sketch, quality, token_counts, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, score string, kept string, copies string, item_id string, verdict string, host string, rule string, labels string, h string, part string, base string, word string, rep string"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, *["x"] * 15)


ROWS = [
    row(1, "one two three four five six seven eight nine ten eleven"),
    row(1, "one two three four five six seven eight nine ten eleven"),
    row(2, "ONE two three four five six seven eight nine ten eleven", None),
    row(3, None), row(4, ""), row(5, " \n\t "), row(None, "a null id and some more words to make it pass the rule", "b"),
    row(None, None, None), row(6, LONG, "b"), row(7, "short"), row(8, "short", "c"), row(1, "another text under a known id with ten words or more"),
    row(9, "naïve ÉCOLE 日本語 \U0001f600 " * 5, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 0, 1), (2, 1, 0), (None, 1, 1), (7, None, None), (1, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS) and set(docs.columns) - {"n_words", "kept"} <= set(rows[0].asDict())
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(3, None)]["n_words"] == 0 and by[(3, None)]["base_failed"] and not by[(4, "")]["kept"]
    assert by[(6, LONG)]["n_words"] == 60_000 and by[(6, LONG)]["n_repeat_words"] == 60_000
    assert by[(None, None)]["host_rate"] is None
    assert quality.judge(none).count() == 0


def test_lm_score(docs, none):
    rows = lm_score.score(docs, F.col("doc_id") != 2).collect()
    assert len(rows) == len(ROWS)
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if not (r["text"] or "").strip()} == {1}
    assert lm_score.score(none).count() == 0
    # nothing to learn from: finite scores all the same
    assert all(r["n_known"] == 0 and r["score"] > -1e9 for r in lm_score.score(docs, F.lit(False)).collect())


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["copies"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.mix(none).count() == 0 and mixing.draw(none).count() == 0
    clashing = docs.withColumns({n: F.lit("x") for n in ("copy", "shard", "shards", "place", "pos", "block", "_mix_key", "_mix_h", "_mix_row")})
    drawn = mixing.draw(clashing).collect()
    assert len(drawn) == sum(r["copies"] for r in rows) and all(isinstance(r["copy"], int) for r in drawn)
    assert mixing.draw(docs.withColumnRenamed("source", "place"), source="place").count() == len(drawn)


def test_near_duplicates(docs, none):
    rows = odd_sketch.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[8]["component_id"] == 7
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[4]["kept"] and by[5]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    kept = odd_sketch.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, None, 1, 3, 4, 5, 6, 7, 9]
    assert odd_sketch.near_duplicates(none).count() == 0 and odd_sketch.drop_near_duplicates(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "two three four five six seven eight nine"), (2, None), (3, ""), (4, "short"), (None, "a null id and some more words"), (1, "other words")],
        "item_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (7, 4), (8, 4), (None, None)}
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r["text"] for r in clean.collect()} >= {None, "", LONG, "another text under a known id with ten words or more"}
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_contaminated(none, items).count() == 0


def test_url_filter(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://A.com/x", "h"), (4, "http://A.com/x", "h"), (None, "http://b.net/es/1?q=1&r=2#f", "h"), (5, "x://", None), (6, "http://c.org/" + "a" * 50_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_filter.judge(pages).collect()
    assert len(out) == len(rows) and all(r["verdict"] in ("allow", "block") for r in out)
    by = {r["page_id"]: r for r in out}
    assert by[1]["host"] == "" and by[4]["rule"] == "com/" and by[None]["rule"] == "net/es/"
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id < 4")).collect()} == {"allow"}


def test_toxicity(spark, docs, none):
    rows = toxicity.toxicity(docs, labels(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(none, labels(spark)).count() == 0
    assert toxicity.toxicity(docs, labels(spark).limit(0)).count() == len(ROWS)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"),
        (None, 0, "user", "lost"), (4, None, None, None), (5, 0, "user", LONG), (6, 1, "b", "x"), (6, 1, "a", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.chat_texts(turns).collect()}
    assert set(out) == {1, 4, 5, 6} and out[1]["n_copies"] == 2 and out[1]["n_turns"] == 2
    assert out[1]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>"
    assert out[4]["chat"] == "<|im_start|>unknown\n<|im_end|>" and out[6]["chat"].index("a\n") < out[6]["chat"].index("b\n")
    assert chat.chat_texts(turns.limit(0)).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS) and all(r["labels"] == "" and r["n_base"] == 0 and r["score"] == 0 for r in rows)
    assert licenses.scan(none).count() == 0


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(docs, path).collect()
    assert len(rows) == len(ROWS)
    assert {(r["n_bytes"], r["n_tokens"]) for r in rows if not r["text"]} == {(0, 0)}
    assert token_counts.count_tokens(none, path).count() == 0
