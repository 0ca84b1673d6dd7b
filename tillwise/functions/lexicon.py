"""Word tables for review polarity.

``words_table`` joins the three roles a word can play (polarity, strengthening, negation) into
one table. The polarity lexicon is an input; SEED_LEXICON is a small own list for trying out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2,
    "better": 1.9, "boring": -1.3, "broken": -2.1, "cheap": -0.8, "comfortable": 1.6, "damaged": -1.9,
    "defective": -2.1, "delighted": 2.9, "disappointed": -2.1, "disappointing": -2.2, "durable": 1.4,
    "easy": 1.9, "excellent": 2.7, "fail": -2.5, "failed": -2.3, "fantastic": 2.6, "faulty": -1.8,
    "fine": 0.8, "free": 2.3, "good": 1.9, "great": 3.1, "happy": 2.7, "hate": -2.7, "helpful": 1.8,
    "horrible": -2.5, "late": -0.7, "like": 1.5, "love": 3.2, "lovely": 2.8, "nice": 1.8, "noisy": -0.7,
    "perfect": 2.7, "pleased": 1.9, "poor": -2.1, "problem": -1.7, "recommend": 1.5, "refund": -0.6,
    "reliable": 1.6, "rubbish": -1.9, "sad": -2.1, "satisfied": 1.8, "slow": -0.7, "smooth": 1.1,
    "sturdy": 1.3, "stupid": -2.4, "superb": 3.1, "terrible": -2.1, "ugly": -2.3, "unhappy": -1.8,
    "useful": 1.9, "useless": -1.8, "waste": -1.8, "wonderful": 2.7, "worst": -3.1, "worth": 0.9,
    "wrong": -2.1,
}

# fixed values: published rule tables (Hutto & Gilbert 2014)
STRONGER = 0.293
WEAKER = -0.293
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping",
    "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly", "hella",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously",
    "uber", "unbelievably", "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sort of",
    "sorta", "sortof", "sort-of",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt",
    "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt",
    "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt",
    "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without",
    "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]


def boosters(spark: SparkSession) -> DataFrame:
    rows = [(w, STRONGER) for w in BOOSTERS_UP] + [(w, WEAKER) for w in BOOSTERS_DOWN]
    return spark.createDataFrame(rows, "word string, boost double")


def negations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in NEGATIONS], "word string")


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_LEXICON.items()), "word string, valence double")


def words_table(
    lexicon: DataFrame, boost_words: DataFrame | None = None, negation_words: DataFrame | None = None
) -> DataFrame:
    """(word, valence, boost, negates), one row per word; a word listed twice keeps its mean."""
    spark = lexicon.sparkSession
    boost_words = boosters(spark) if boost_words is None else boost_words
    negation_words = negations(spark) if negation_words is None else negation_words
    nothing = F.lit(None).cast("double")
    parts = [
        lexicon.select(F.lower("word").alias("word"), "valence", nothing.alias("boost"), F.lit(False).alias("n")),
        boost_words.select(F.lower("word").alias("word"), nothing.alias("valence"), "boost", F.lit(False).alias("n")),
        negation_words.select(
            F.lower("word").alias("word"), nothing.alias("valence"), nothing.alias("boost"), F.lit(True).alias("n")
        ),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("word").agg(
        F.avg("valence").alias("valence"), F.avg("boost").alias("boost"), F.bool_or("n").alias("negates")
    )
