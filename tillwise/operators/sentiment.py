"""Review sentiment by lexicon and rules, overall and per product.

A review is scored inside its row: only its text travels to an Arrow function, in batches, and comes back as one number, so no token
becomes a row and nothing is shuffled or sorted. Tokens are looked up in the lexicon, and only where one has polarity are the three
before it looked at. (The same rules as array functions of the engine, which are interpreted once per token, took ten times as
long.) A lexicon of more than LEXICON_WORDS words stays distributed: each review is joined to its own words of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.lexicon import BOOSTERS_DOWN, WEAKER, boosters, negations, words_table
from tillwise.functions.text import col, known, strip
from tillwise.plans.lookups import join_spread
from tillwise.plans.scratch import save

# fixed values: published scoring rules (Hutto & Gilbert 2014)
NEGATED = -0.74
CAPITALS = 0.733
DECAY = {1: 1.0, 2: 0.95, 3: 0.9}
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NORMALISER = 15
POSITIVE, NEGATIVE = 0.05, -0.05

# fixed values: report sizes and texts
TOP_PRODUCTS = 15
SAMPLE_COMMENTS = 30
NO_PRODUCT = "Unknown Product"

TEXT_HASH = "_text_hash"

# words that every task carries, at most (a few MB); published lexicons have under 10,000
LEXICON_WORDS = 50_000

TWO_WORD_WEAKER = frozenset(w for w in BOOSTERS_DOWN if " " in w)

MARK = r"""(?:!\?!\?|\?!\?!|!!!|\?\?\?|\?!\?|!\?!|!!|\?\?|[.!?,;:\-'"])"""
ENDS = frozenset(".!?,;:-'\"")
PLAIN = r"[^!-/:-@\[-`{-~]{2,}"
ONE_MARK = re.compile(f"^{MARK}({PLAIN})$|^({PLAIN}){MARK}$")
# Unicode white space; str.split() takes four control characters for such as well
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROL = re.compile(r"[\x1c-\x1f]")

# what a lexicon says of a word: valence and boost, missing for most, and whether it negates
Word = tuple[float | None, float | None, bool]
UNKNOWN: Word = (None, None, False)


def _bare(piece: str) -> str:
    if piece[-1] in ENDS and len(piece) > 2 and piece[:-1].isalnum():
        return piece[:-1]
    return ONE_MARK.sub(r"\1\2", piece) if piece[0] in ENDS or piece[-1] in ENDS else piece


def tokens(text: str) -> list[str]:
    """Pieces of two characters or more, one leading or trailing punctuation mark taken off."""
    pieces = SPACE.split(text) if CONTROL.search(text) else text.split()
    return [p if p.isalnum() else _bare(p) for p in pieces if len(p) > 1]


def _capital(token: str) -> bool:
    return token == token.upper() and token != token.lower()


@dataclass
class Lexicon:
    """What is known of words, and which of them have a polarity: a booster never has one of its own."""

    words: Mapping[str, Word]

    def __post_init__(self):
        self.polar = frozenset(w for w, (valence, boost, _) in self.words.items() if valence is not None and boost is None)


def polarity(text: str | None, lexicon: Lexicon) -> float:
    """Sum of the polarities of a text's tokens, each after the three tokens before it, with the weight of its ! and ?."""
    found, words = tokens(text or ""), lexicon.words
    low = [t.lower() for t in found]
    hits = [i for i, w in enumerate(low) if w in lexicon.polar]
    # "kind" has no polarity in "kind of"
    hits = [i for i in hits if not (low[i] == "kind" and low[i + 1 : i + 2] == ["of"])]
    if not hits:
        return 0.0
    near = {k for i in hits for k in range(max(0, i - 3), i + 1)}
    # capitals count only in a text that is not all capitals
    capital = {k for k in near if found[k] != low[k] and found[k] == found[k].upper()}
    if capital and all(map(_capital, found)):
        capital = set()
    but = low.index("but") if "but" in low else None
    total = 0.0
    for i in hits:
        v = words[low[i]][0]
        if i in capital:
            v += CAPITALS if v > 0 else -CAPITALS
        for place in range(1, min(i, 3) + 1):
            v = _after(v, found, low, i, place, words, capital)
        if i and low[i - 1] == "least" and words.get("least", UNKNOWN)[0] is None and low[max(0, i - 2)] not in ("at", "very"):
            v *= NEGATED
        if but is not None and i != but:
            v *= BEFORE_BUT if i < but else AFTER_BUT
        total += v
    # rounding far below the reported digits makes sums of equal values in another order equal
    total = round(total, 9)
    return total + math.copysign(emphasis(text), total) if total else 0.0


def emphasis(text: str) -> float:
    marks = min(text.count("!"), MAX_EXCLAMATIONS) * EXCLAMATION
    asked = text.count("?")
    return marks + (0.0 if asked < 2 else asked * QUESTION if asked <= 3 else MANY_QUESTIONS)


def _after(v: float, found: list[str], low: list[str], i: int, place: int, words: Mapping[str, Word], capital: set[int]) -> float:
    """Polarity ``v`` of token ``i`` after the one ``place`` before it: strengthening, then negation."""
    at = i - place
    valence, boost, negates = words.get(low[at], UNKNOWN)
    # a token with polarity of its own neither strengthens nor negates
    if valence is not None:
        return v
    if boost is not None:
        loud = 0.0 if at not in capital else CAPITALS if v > 0 else -CAPITALS
        v += ((-boost if v < 0 else boost) + loud) * DECAY[place]
    stressed = place > 1 and found[at] == "never" and any(found[k] in ("so", "this") for k in range(at + 1 if place == 3 else i - 1, i))
    if stressed:
        v *= 1.5 if place == 2 else 1.25
    elif negates or "n't" in low[at]:
        v *= NEGATED
    if place == 3 and (f"{low[at]} {low[at + 1]}" in TWO_WORD_WEAKER or f"{low[at + 1]} {low[at + 2]}" in TWO_WORD_WEAKER):
        v += WEAKER
    return v


def _sums(reviews: DataFrame, words: dict[str, Word]) -> DataFrame:
    """``reviews`` (_row, _body) with _sum, for words that every task can hold."""
    lexicon = Lexicon(words)

    @F.arrow_udf("double")
    def summed(texts: pa.Array) -> pa.Array:
        return pa.array([polarity(t.as_py(), lexicon) for t in texts], pa.float64())

    return reviews.withColumn("_sum", summed("_body"))


def _sums_by_own_words(reviews: DataFrame, words: DataFrame) -> DataFrame:
    """As ``_sums``, for words of any number: each review gets those that it holds from a join on its different tokens."""

    @F.arrow_udf("array<string>")
    def different(texts: pa.Array) -> pa.Array:
        words = [{w.lower() for w in tokens(t.as_py() or "")} for t in texts]
        return pa.array([sorted(w) for w in words], pa.list_(pa.string()))

    @F.arrow_udf("double")
    def summed(texts: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([
            polarity(t.as_py(), Lexicon({w["word"]: (w["valence"], w["boost"], w["negates"]) for w in listed.as_py() or ()}))
            for t, listed in zip(texts, own, strict=True)
        ], pa.float64())

    # numbers are frozen in the saved table, so a task that is run again gives the same ones
    numbered = save(reviews.withColumn("_rid", F.monotonically_increasing_id()))
    held = numbered.select("_rid", F.explode(different("_body")).alias("word"))
    known = join_spread(held, words, "word", "_rid")
    own = known.groupBy("_rid").agg(F.collect_list(F.struct("word", "valence", "boost", "negates")).alias("_own"))
    return numbered.join(own, "_rid", "left").withColumn("_sum", summed("_body", "_own"))


def _carried(lexicon: DataFrame, boost_words: DataFrame, negation_words: DataFrame) -> dict[str, Word] | None:
    """The words of all three tables, a word that is listed twice with its mean; none if they are more than LEXICON_WORDS."""
    tables = [lexicon.select("word", "valence"), boost_words.select("word", "boost"), negation_words.select("word", F.lit(True))]
    values: list[dict[str, list]] = [{}, {}, {}]
    for table, role in zip(tables, values, strict=True):
        rows = table.select(F.lower("word"), table.columns[1]).limit(LEXICON_WORDS + 1).collect()
        if len(rows) > LEXICON_WORDS:
            return None
        for word, value in rows:
            if value is not None:
                role.setdefault(word, []).append(value)
    mean = lambda listed: sum(listed) / len(listed) if listed else None
    return {w: (mean(values[0].get(w)), mean(values[1].get(w)), w in values[2]) for w in set().union(*values) if w is not None}


def score_reviews(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    key: Sequence[str],
    keep: Sequence[str] = (),
    boost_words: DataFrame | None = None,
    negation_words: DataFrame | None = None,
) -> DataFrame:
    """(key, keep, compound_score, sentiment), one row per review.

    Every row is scored for itself, so keys may repeat or be missing. ``lexicon`` has columns (word, valence),
    ``boost_words`` (word, boost) and ``negation_words`` (word), the last two with published defaults.
    """
    names = list(dict.fromkeys([*key, *keep]))
    spark = df.sparkSession
    boost_words = boosters(spark) if boost_words is None else boost_words
    negation_words = negations(spark) if negation_words is None else negation_words
    reviews = df.select(F.struct(*[col(n) for n in names]).alias("_row"), col(text_col).cast("string").alias("_body"))
    carried = _carried(lexicon, boost_words, negation_words)
    if carried is None:
        summed = _sums_by_own_words(reviews, save(words_table(lexicon, boost_words, negation_words)))
    else:
        summed = _sums(reviews, carried)

    compound = F.round(F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + NORMALISER), 4)
    scored = summed.select(*[F.col("_row")[n].alias(n) for n in names], compound.alias("compound_score"))
    return scored.withColumn("sentiment", sentiment_class(F.col("compound_score")))


def sentiment_class(compound: Column) -> Column:
    return F.when(compound >= POSITIVE, "Positive").when(compound <= NEGATIVE, "Negative").otherwise("Neutral")


def product_text(df: DataFrame, product_col: str) -> Column:
    return F.coalesce(known(df, product_col).cast("string"), F.lit(NO_PRODUCT))


def display_text(text_col: str) -> Column:
    return strip(F.coalesce(col(text_col).cast("string"), F.lit("")))


def scored_table(
    df: DataFrame, text_col: str, lexicon: DataFrame,
    boost_words: DataFrame | None = None, negation_words: DataFrame | None = None,
) -> DataFrame:
    """The whole table, every row of it, with sentiment and compound_score, as for an export."""
    scored = score_reviews(df, text_col, lexicon, df.columns, (), boost_words, negation_words)
    return scored.select(*[col(c) for c in df.columns], "sentiment", "compound_score")


def _tallies() -> list[Column]:
    count = lambda name: F.count_if(F.col("sentiment") == name)
    return [count("Positive").alias("positive"), count("Neutral").alias("neutral"), count("Negative").alias("negative")]


def _percent(part: str) -> Column:
    return F.coalesce(F.bround(F.try_divide(part, "total") * 100, 1), F.lit(0.0))


def sentiment_totals(scores: DataFrame) -> DataFrame:
    """(total, and count and percentage per class) over all reviews; one row."""
    counts = scores.agg(F.count(F.lit(1)).alias("total"), *_tallies())
    return counts.select("*", *[_percent(c).alias(f"{c}_pct") for c in ("positive", "neutral", "negative")])


def sentiment_by_product(scores: DataFrame, product: str, top: int = TOP_PRODUCTS) -> DataFrame:
    """The products with most reviews: counts, percentages and "n / total (p%)" texts."""
    counts = scores.groupBy(col(product).alias("product_name")).agg(F.count(F.lit(1)).alias("total"), *_tallies())
    listed = counts.orderBy(F.desc("total"), "product_name").limit(top)
    # numbered after the limit, so the window sees only the listed rows
    place = F.row_number().over(Window.orderBy(F.desc("total"), "product_name")) - 1
    classes = ("positive", "neutral", "negative")
    shares = listed.select(
        F.concat(F.lit("prod_"), place.cast("string")).alias("prod_id"),
        "*",
        *[_percent(c).alias(f"{c}_pct") for c in classes],
    )
    return shares.select(
        "*",
        *[
            F.concat(
                F.col(c).cast("string"), F.lit(" / "), F.col("total").cast("string"),
                F.lit(" ("), F.col(f"{c}_pct").cast("string"), F.lit("%)"),
            ).alias(f"{c}_str")
            for c in classes
        ],
    )


def comment_samples(
    df: DataFrame,
    text_col: str,
    scores: DataFrame,
    products: DataFrame,
    product: str,
    key: Sequence[str],
    order_by: Sequence[Column | str],
    per_class: int = SAMPLE_COMMENTS,
) -> DataFrame:
    """First reviews in row order per listed product and class, blank ones then left out.

    Rows are chosen on the narrow score table (the limit per group is applied before its
    shuffle); only the chosen rows' texts are looked up in ``df``.
    """
    listed = products.select("prod_id", F.col("product_name").alias(product))
    known_by = [*key, *[c for c in scores.columns if c == TEXT_HASH]]
    in_order = Window.partitionBy("prod_id", "sentiment").orderBy(*order_by)
    chosen = (
        scores.join(F.broadcast(listed), product)
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= per_class)
        .select("prod_id", F.col(product).alias("product_name"), "sentiment", "place", *[col(k).alias(f"_k_{k}") for k in known_by])
    )
    texts = df.select(*[col(k) for k in key], display_text(text_col).alias("comment"))
    same = reduce(Column.__and__, [col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    if TEXT_HASH in scores.columns:
        # keys may repeat; a row with the same key and text is the same comment
        same = same & (F.xxhash64("comment") == F.col(f"_k_{TEXT_HASH}"))
    # at most products x 3 classes x per_class rows
    return (
        texts.join(F.broadcast(chosen), same)
        .where(F.col("comment") != "")
        .select("prod_id", "product_name", "sentiment", "place", "comment")
        .dropDuplicates(["prod_id", "sentiment", "place"])
    )


def comments_map(samples: DataFrame) -> DataFrame:
    """One row per product with three ordered lists of comments."""

    def listed(name: str) -> Column:
        pairs = F.collect_list(F.when(F.col("sentiment") == name, F.struct("place", "comment")))
        return F.transform(F.array_sort(pairs), lambda p: p["comment"]).alias(name.lower())

    return samples.groupBy("prod_id", "product_name").agg(*[listed(n) for n in ("Positive", "Neutral", "Negative")])


def containing(samples: DataFrame, query: str, text_col: str = "comment") -> DataFrame:
    """Rows whose text contains the words, upper or lower case."""
    return samples.where(F.contains(F.lower(col(text_col)), F.lower(F.lit(query))))


@dataclass
class ReviewReport:
    totals: DataFrame
    product_breakdown: DataFrame | None
    comments: DataFrame | None


def review_report(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    key: Sequence[str],
    product_col: str | None = None,
    order_by: Sequence[str] | None = None,
) -> ReviewReport:
    """Totals and, with a product column, the breakdown and comment samples in the order of the columns ``order_by``."""
    if text_col not in df.columns:
        raise ValueError(f"review column {text_col!r} not found")
    if not product_col or product_col not in df.columns:
        scores = save(score_reviews(df, text_col, lexicon, key))
        return ReviewReport(sentiment_totals(scores), None, None)
    # what orders the samples travels with the scores
    order_by = list(order_by or key)
    extra = {"_product": product_text(df, product_col), TEXT_HASH: F.xxhash64(display_text(text_col))}
    named = df.withColumns(extra)
    scores = save(score_reviews(named, text_col, lexicon, key, keep=[*extra, *order_by]))
    products = save(sentiment_by_product(scores, "_product"))
    samples = comment_samples(df, text_col, scores, products, "_product", key, [col(c) for c in order_by])
    return ReviewReport(sentiment_totals(scores), products, samples)
