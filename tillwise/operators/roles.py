"""Which column plays which role, for a whole catalogue of tables at once.

The catalogue is a frame with one row per column of every table, names from the schemas and
content measures from the data. Each role is a scored expression over it, and the winner per
table is one ``min_by``; no rule list is joined.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.operators.profiling import (
    column_facts,
    looks_like_date,
    text_columns,
    type_name,
)
from tillwise.plans.scratch import save

# fixed values: name rules, in order of preference
ID_KEYWORDS = ["customer", "cust", "user", "client", "member", "account", "phone", "email"]
ID_PREFERRED = ["id", "code", "number", "num", "name"]
DATE_KEYWORDS = ["date", "time", "timestamp", "dt", "day"]
AMOUNT_KEYWORDS = ["sales", "amount", "total", "price", "revenue", "spend", "cost", "value"]

INVOICE_PATTERNS = ["invoice", "order", "transaction", "trans_id", "receipt"]
USER_PATTERNS = ["cust", "user", "client", "member", "account"]
ITEM_PATTERNS = ["prod", "item", "desc", "title", "stock", "sku", "article"]
QTY_PATTERNS = ["qty", "quantity", "rating", "amount", "unit", "score"]

STRONG_REVIEW = ["review", "feedback", "comment", "opinion", "testimonial"]
WEAK_REVIEW = ["text", "description", "message", "remark", "summary", "content", "body", "notes"]
ID_LIKE = ["id", "sku", "code", "date", "time", "link", "url", "image", "img", "asin", "no", "num", "key"]
STRONG_PRODUCT = ["product", "item", "sku", "asin"]
WEAK_PRODUCT = ["title", "name"]
PERSON = ["user", "customer", "reviewer", "author", "client", "buyer", "reviewedby"]
RATING = ["rating", "stars", "star", "score"]

# fixed values: scores and limits
STRONG_SCORE, WEAK_SCORE, FUZZY_SHARE, FUZZY_LIMIT = 100, 20, 0.7, 0.8
MIN_WORDS, MIN_PRESENT, MAX_WORDS, UNIQUE_SHARE = 3, 0.05, 25, 5
MIN_NUMERIC = 0.5

# fixed values: reasons shown to the user
NEEDS_ID = "Customer Identification Column (e.g. CUSTOMERNAME)"
NEEDS_DATE = "Transaction Date Column (e.g. ORDERDATE)"
NEEDS_AMOUNT = "Transaction Amount Column (e.g. SALES)"
EMPTY_TABLE = "Dataset is empty"
NO_TEXT = "No text columns found in dataset (sentiment analysis needs a column of written feedback)"
NO_PROSE = (
    "No column with substantive free-form text was found -- only short labels, "
    "codes, or mostly-empty text columns are present"
)


def catalogue(
    tables: Mapping[str, DataFrame],
    order_by: Mapping[str, Sequence[str]] | None = None,
    measure_all: bool = False,
    content: bool = True,
    dates: bool = True,
) -> DataFrame:
    """(dataset, position, column, dtype, is_text, is_date, measures) for all columns of the tables.

    One aggregate per table and a union of the results: a single job whose tables run side by
    side. Content is measured where the name makes the column a candidate for a role judged by
    content (or everywhere, on request), so no other column is read; without ``content`` only rows are counted, and
    without ``dates`` no value is looked at for dates. The result has a row per
    column and is saved, as every role looks at it several times.
    """
    measured: Mapping[str, Sequence[str]] = {}
    if measure_all:
        measured = {name: df.columns for name, df in tables.items()}
    elif content:
        measured = _candidates(tables)
    dated = _date_columns(tables, order_by or {}) if dates else {}
    facts = [column_facts(df, name, dated.get(name, []), measured.get(name, [])) for name, df in tables.items()]
    return save(reduce(DataFrame.unionByName, facts))


def _candidates(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Columns whose names suggest review text, a product or a rating, by table."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame(
        [(name, c) for name, df in tables.items() for c in df.columns], "dataset string, column string"
    )
    scored = _with_name_scores(names)
    hits = scored.where((F.col("_review") > 0) | (F.col("_product") > 0) | _holds(RATING))
    found: dict[str, list[str]] = {}
    for row in hits.select("dataset", "column").collect():
        found.setdefault(row["dataset"], []).append(row["column"])
    return found


def _date_columns(tables: Mapping[str, DataFrame], order_by: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Per table its timestamp columns, and the text columns that look like dates where no name says date or time.

    One job for all such columns of all tables; ten values of each come to a verdict.
    """
    found = {n: [f.name for f in df.schema if type_name(f.dataType) == "datetime64[ns]"] for n, df in tables.items()}
    looks = [
        looks_like_date(df, c, order_by.get(name) or df.columns[:1]).select(F.lit(name).alias("dataset"), F.lit(c).alias("column"), "is_date")
        for name, df in tables.items()
        if not any(k in c.lower() for c in df.columns for k in DATE_KEYWORDS)
        for c in text_columns(df)
    ]
    if looks:
        for row in reduce(DataFrame.unionByName, looks).where("is_date").collect():
            found[row["dataset"]].append(row["column"])
    return found


# --- names ---


def _first_keyword(name: Column, keywords: list[str]) -> Column:
    """Place of the first keyword found inside the name, or NULL."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(k)), i) for i, k in enumerate(keywords)])


def _holds_any(name: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(name, F.lit(p)) for p in parts])


def _winner(column: str, when: Column, *order: Column) -> Column:
    """The column lowest in ``order`` among those meeting the condition; NULL for none."""
    return F.min_by("column", F.when(when, F.struct(*order))).alias(column)


def name_tokens(name: Column) -> Column:
    """Lower-case words of a snake_case, kebab-case, spaced or camelCase name."""
    parted = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.transform(F.filter(F.split(parted, "[^a-zA-Z0-9]+"), lambda t: t != ""), F.lower)


def closest_ratio(words: Column, keywords: list[str]) -> Column:
    """Best similarity between any word and any keyword, 0 under the limit."""

    @F.pandas_udf("double")
    def ratio(lists: pd.Series) -> pd.Series:
        def best(found) -> float:
            pairs = (difflib.SequenceMatcher(None, w, k).ratio() for w in found for k in keywords)
            top = max(pairs, default=0.0)
            return top if top >= FUZZY_LIMIT else 0.0

        return lists.map(best)

    return ratio(words)


def name_score(words: Column, strong: list[str], weak: list[str]) -> Column:
    def has(keywords: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords]))

    near_strong, near_weak = closest_ratio(words, strong), closest_ratio(words, weak)
    return (
        F.when(has(strong), float(STRONG_SCORE))
        .when(has(weak), float(WEAK_SCORE))
        .when(near_strong > 0, STRONG_SCORE * FUZZY_SHARE * near_strong)
        .when(near_weak > 0, WEAK_SCORE * FUZZY_SHARE * near_weak)
        .otherwise(0.0)
    )


# --- roles ---


def segmentation_roles(columns: DataFrame) -> DataFrame:
    """(dataset, id_col, date_col, amount_col)."""
    name = F.lower("column")
    ids, dates, amounts = (_first_keyword(name, k) for k in (ID_KEYWORDS, DATE_KEYWORDS, AMOUNT_KEYWORDS))
    named = columns.select("*", ids.alias("_id"), dates.alias("_date"), amounts.alias("_amount"))
    by_content = F.lit(len(DATE_KEYWORDS))
    date_rank = F.coalesce("_date", F.when(F.col("is_date"), by_content))
    return named.groupBy("dataset").agg(
        _winner("id_col", F.col("_id").isNotNull(), F.col("_id"), ~_holds_any(name, ID_PREFERRED), F.col("position")),
        _winner("date_col", date_rank.isNotNull(), date_rank, F.col("position")),
        _winner("amount_col", F.col("_amount").isNotNull(), F.col("_amount"), F.col("position")),
    )


def recommendation_roles(columns: DataFrame) -> DataFrame:
    """(dataset, invoice_col, user_col, item_col, qty_col); one column may fill several."""
    patterns = {
        "invoice_col": INVOICE_PATTERNS,
        "user_col": USER_PATTERNS,
        "item_col": ITEM_PATTERNS,
        "qty_col": QTY_PATTERNS,
    }
    name = F.lower("column")
    return columns.groupBy("dataset").agg(
        *[_winner(role, name.rlike("|".join(p)), F.col("position")) for role, p in patterns.items()]
    )


def _holds(keywords: list[str]) -> Column:
    return F.arrays_overlap("_words", F.array(*[F.lit(k) for k in keywords]))


def _with_name_scores(columns: DataFrame) -> DataFrame:
    words = columns.withColumn("_words", name_tokens(F.col("column")))
    return words.select(
        "*",
        name_score(F.col("_words"), STRONG_REVIEW, WEAK_REVIEW).alias("_review"),
        name_score(F.col("_words"), STRONG_PRODUCT, WEAK_PRODUCT).alias("_product"),
    )


def review_roles(columns: DataFrame) -> DataFrame:
    """(dataset, review_col, product_col, rating_col); the name decides, the content breaks ties."""
    scored = _with_name_scores(columns).withColumn(
        "_content", F.least("avg_words", F.lit(float(MAX_WORDS))) + F.col("uniqueness") * UNIQUE_SHARE
    )
    prose = (
        F.col("is_text") & ~_holds(ID_LIKE) & (F.col("_review") > 0)
        & (F.col("avg_words") >= MIN_WORDS) & (F.col("non_null_ratio") >= MIN_PRESENT)
    )
    reviews = scored.groupBy("dataset").agg(
        _winner("review_col", prose, -F.col("_review"), -F.col("_content"), F.col("position"))
    )
    left = scored.join(reviews, "dataset").where(~F.col("column").eqNullSafe(F.col("review_col")))
    length = F.when(F.col("is_text"), F.col("avg_len")).otherwise(0.0)
    products = left.groupBy("dataset").agg(
        _winner("product_col", ~_holds(PERSON) & (F.col("_product") > 0), -F.col("_product"), length, F.col("position"))
    )
    left = left.join(products, "dataset").where(~F.col("column").eqNullSafe(F.col("product_col")))
    ratings = left.groupBy("dataset").agg(
        _winner("rating_col", _holds(RATING) & (F.col("valid_ratio") > MIN_NUMERIC), F.col("position"))
    )
    return reviews.join(products, "dataset", "left").join(ratings, "dataset", "left")


# --- verdicts ---


def segmentation_suitability(columns: DataFrame) -> DataFrame:
    roles = segmentation_roles(columns)
    needs = {"id_col": NEEDS_ID, "date_col": NEEDS_DATE, "amount_col": NEEDS_AMOUNT}
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), text) for c, text in needs.items()]))
    return roles.withColumn("missing_requirements", missing).withColumn(
        "is_suitable", F.size("missing_requirements") == 0
    )


def recommendation_suitability(columns: DataFrame) -> DataFrame:
    roles = recommendation_roles(columns)
    buyer = F.col("user_col").isNotNull() | F.col("invoice_col").isNotNull()
    return roles.withColumn("is_suitable", F.col("item_col").isNotNull() & buyer)


def review_suitability(columns: DataFrame) -> DataFrame:
    """Review roles with a verdict and, where unfit, the reason; an empty table has no roles."""
    facts = columns.groupBy("dataset").agg(
        F.max("total_rows").alias("_rows"), F.bool_or("is_text").alias("_has_text")
    )
    empty = F.col("_rows") == 0
    unfit = F.when(F.col("_has_text"), NO_PROSE).otherwise(NO_TEXT)
    reason = F.when(empty, EMPTY_TABLE).when(F.col("review_col").isNull(), unfit)
    joined = review_roles(columns).join(facts, "dataset")
    return joined.select(
        "dataset",
        *[F.when(~empty, F.col(c)).alias(c) for c in ("review_col", "product_col", "rating_col")],
        F.array_compact(F.array(reason)).alias("missing_requirements"),
        (~empty & F.col("review_col").isNotNull()).alias("is_suitable"),
    )
