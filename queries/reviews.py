"""Review sentiment over documents (product = source) and conversations (product = role).

The test texts are invented words, so the polarity lexicon here gives values to frequent ones;
a few frequent words also play the strengthening and negating roles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import table
from tillwise.functions.lexicon import BOOSTERS_DOWN, BOOSTERS_UP, NEGATIONS, STRONGER, WEAKER
from tillwise.operators import sentiment as s
from tillwise.plans.scratch import save

LEXICON = {
    "best": 3.2, "free": 2.3, "stupid": -2.4, "the": 0.4, "la": 1.5, "der": -1.2, "that": 0.8, "with": -0.6,
    "are": 1.1, "que": -1.8, "und": -0.9, "le": 1.3, "was": -0.7, "for": 0.9, "on": -1.4, "as": 0.5,
    "le.": 2.0, "this": 1.2, "et": -1.1, "re": -2.0, "th": 1.9, "an": -0.3, "es": -1.6, "die": -2.2,
}
MORE_BOOSTERS = {"of": 0.293, "in": -0.293}
MORE_NEGATIONS = ["de", "to"]
CLASSES = ("positive", "neutral", "negative")
# one punctuation mark before or after a word without any, spelt out apart from the operator's own pattern
MARK = r"""(?:!\?!\?|\?!\?!|!!!|\?\?\?|\?!\?|!\?!|!!|\?\?|[!"'\-.,:;?])"""
PLAIN = r"[^!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]{2,}"
ONE_MARK = f"^{MARK}({PLAIN})$|^({PLAIN}){MARK}$"


def words(spark):
    """(lexicon, boost words, negation words)"""
    boost = {w: STRONGER for w in BOOSTERS_UP} | {w: WEAKER for w in BOOSTERS_DOWN} | MORE_BOOSTERS
    return (
        spark.createDataFrame(list(LEXICON.items()), "word string, valence double"),
        spark.createDataFrame(list(boost.items()), "word string, boost double"),
        spark.createDataFrame([(w,) for w in [*NEGATIONS, *MORE_NEGATIONS]], "word string"),
    )


def _scores(spark, reviews, text, key, keep=()):
    lexicon, boost, negations = words(spark)
    return s.score_reviews(reviews, text, lexicon, key, keep, boost, negations)


def _documents(spark, folder):
    reviews = table(spark, folder, "documents").select("doc_id", "text", "source")
    return reviews.withColumn("product", s.product_text(reviews, "source"))


def _document_scores(spark, folder):
    return _scores(spark, _documents(spark, folder), "text", ["doc_id"], ["product"])


def _conversation_scores(spark, folder):
    talk = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return _scores(spark, talk, "text", ["conv_id", "turn"], ["role"])


def _totals(spark, folder):
    return s.sentiment_totals(_document_scores(spark, folder))


def _totals_talk(spark, folder):
    return s.sentiment_totals(_conversation_scores(spark, folder))


def _by_product(spark, folder):
    return s.sentiment_by_product(_document_scores(spark, folder), "product")


def _by_role(spark, folder):
    return s.sentiment_by_product(_conversation_scores(spark, folder), "role")


def _samples(spark, folder):
    documents = table(spark, folder, "documents")
    scores = save(_document_scores(spark, folder))
    products = s.sentiment_by_product(scores, "product")
    return s.comment_samples(documents, "text", scores, products, "product", ["doc_id"], ["doc_id"])


def _comments(spark, folder):
    return _samples(spark, folder).withColumn("comment", F.md5("comment"))


def _comments_by_length(spark, folder):
    """Samples in the order of another column than the key."""
    docs = table(spark, folder, "documents")
    scores = save(_scores(spark, docs.withColumn("product", F.col("source")), "text", ["doc_id"], ["product", "n_chars"]))
    products = s.sentiment_by_product(scores, "product")
    samples = s.comment_samples(docs, "text", scores, products, "product", ["doc_id"], ["n_chars", "doc_id"])
    return samples.select("prod_id", "sentiment", "place", F.md5("comment").alias("comment"))


def _repeated(spark, folder):
    """Scores where keys repeat or are missing: every row is counted."""
    docs = table(spark, folder, "documents").withColumn("doc_id", F.expr("CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END"))
    scores = _scores(spark, docs, "text", ["doc_id"])
    return scores.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "sentiment").agg(F.count(F.lit(1)).alias("n"))


def _comments_map(spark, folder):
    lists = s.comments_map(_samples(spark, folder))
    joined = [F.md5(F.array_join(c, "|")).alias(f"{c}_digest") for c in CLASSES]
    return lists.select("prod_id", "product_name", *[F.size(c).cast("long").alias(c) for c in CLASSES], *joined)


def _containing(spark, folder):
    return s.containing(_samples(spark, folder), "BEST").withColumn("comment", F.md5("comment"))


def _containing_all(spark, folder):
    found = s.containing(table(spark, folder, "documents"), "Free", "text")
    return found.select("doc_id", "source")


def _words_sql():
    boost = {w: STRONGER for w in BOOSTERS_UP} | {w: WEAKER for w in BOOSTERS_DOWN} | MORE_BOOSTERS
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    rows = []
    for w in sorted(set(LEXICON) | set(boost) | set(NEGATIONS) | set(MORE_NEGATIONS)):
        negates = w in NEGATIONS or w in MORE_NEGATIONS
        rows.append(
            f"({quote(w)}, {LEXICON.get(w, 'NULL')}::DOUBLE, {boost.get(w, 'NULL')}::DOUBLE, {str(negates).lower()})"
        )
    return ", ".join(rows)


def _capital_sql(token):
    return f"({token} = upper({token}) AND {token} <> lower({token}))"


def _scores_sql(source, key, keep, text):
    mark = ONE_MARK.replace("'", "''")
    steps = []
    previous = "hits"
    for i, decay in s.DECAY.items():
        t = f"t{i}"
        counts = f"({t} <> '' AND w{i}.valence IS NULL)"
        loud = (
            f"CASE WHEN {_capital_sql(t)} AND mixed THEN CASE WHEN v > 0 THEN {s.CAPITALS} ELSE -{s.CAPITALS} END ELSE 0 END"
        )
        boosted = (
            f"v + CASE WHEN {counts} AND w{i}.boost IS NOT NULL THEN "
            f"(CASE WHEN v < 0 THEN -w{i}.boost ELSE w{i}.boost END + {loud}) * {decay} ELSE 0 END"
        )
        negates = f"(coalesce(w{i}.negates, false) OR contains(lower({t}), 'n''t'))"
        factor = f"CASE WHEN {counts} AND {negates} THEN {s.NEGATED} ELSE 1 END"
        extra = "0"
        if i == 2:
            factor = f"CASE WHEN {counts} AND t2 = 'never' AND t1 IN ('so', 'this') THEN 1.5 ELSE {factor} END"
        if i == 3:
            factor = (
                f"CASE WHEN {counts} AND t3 = 'never' AND (t1 IN ('so', 'this') OR t2 IN ('so', 'this')) "
                f"THEN 1.25 ELSE {factor} END"
            )
            pairs = "('just enough', 'kind of', 'sort of')"
            extra = (
                f"CASE WHEN {counts} AND (lower(t3 || ' ' || t2) IN {pairs} OR lower(t2 || ' ' || t1) IN {pairs}) "
                f"THEN {WEAKER} ELSE 0 END"
            )
        steps.append(
            f"s{i} AS (SELECT h.* EXCLUDE (v), ({boosted}) * ({factor}) + {extra} AS v"
            + (", w1.valence IS NULL AS t1_plain" if i == 1 else "")
            + f" FROM {previous} h LEFT JOIN words w{i} ON w{i}.word = lower(h.t{i}))"
        )
        previous = f"s{i}"
    return f"""
    words(word, valence, boost, negates) AS (VALUES {_words_sql()}),
    pieces AS (SELECT {key}, unnest(regexp_extract_all({text}, '\\S+')) AS piece,
               generate_subscripts(regexp_extract_all({text}, '\\S+'), 1) AS i FROM {source}),
    tok AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos,
            regexp_replace(piece, '{mark}', '\\1\\2') AS t0 FROM pieces WHERE length(piece) > 1),
    ctx AS (SELECT *, coalesce(lag(t0, 1) OVER w, '') AS t1, coalesce(lag(t0, 2) OVER w, '') AS t2,
            coalesce(lag(t0, 3) OVER w, '') AS t3, coalesce(lead(t0, 1) OVER w, '') AS nxt FROM tok
            WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
    doc AS (SELECT {key}, min(CASE WHEN lower(t0) = 'but' THEN pos END) AS but,
            bool_or({_capital_sql('t0')}) AND bool_or(NOT {_capital_sql('t0')}) AS mixed FROM tok GROUP BY ALL),
    hits AS (SELECT ctx.*, but, mixed, words.valence + CASE WHEN {_capital_sql('t0')} AND mixed THEN
               CASE WHEN words.valence > 0 THEN {s.CAPITALS} ELSE -{s.CAPITALS} END ELSE 0 END AS v
             FROM ctx JOIN doc USING ({key}) JOIN words ON words.word = lower(t0)
             WHERE words.valence IS NOT NULL AND words.boost IS NULL AND NOT (lower(t0) = 'kind' AND lower(nxt) = 'of')),
    {', '.join(steps)},
    sums AS (SELECT {key}, round(sum(v * CASE WHEN lower(t1) = 'least' AND t1_plain AND lower(t2) NOT IN ('at', 'very')
               THEN {s.NEGATED} ELSE 1 END * CASE WHEN pos < but THEN 0.5 WHEN pos > but THEN 1.5 ELSE 1 END), 9) AS x
             FROM s3 GROUP BY ALL),
    loudness AS (SELECT {key}, {keep}, {text} AS body,
               least(length({text}) - length(replace({text}, '!', '')), 4) * {s.EXCLAMATION} AS bangs,
               length({text}) - length(replace({text}, '?', '')) AS asked FROM {source}),
    total AS (SELECT {key}, {keep}, body, coalesce(x, 0) + sign(coalesce(x, 0)) * (bangs + CASE WHEN asked < 2 THEN 0
               WHEN asked <= 3 THEN asked * {s.QUESTION} ELSE {s.MANY_QUESTIONS} END) AS y
             FROM loudness LEFT JOIN sums USING ({key})),
    scores AS (SELECT {key}, {keep}, body, round(y / sqrt(y * y + 15), 4) AS compound_score FROM total),
    classed AS (SELECT *, CASE WHEN compound_score >= 0.05 THEN 'Positive' WHEN compound_score <= -0.05 THEN 'Negative'
               ELSE 'Neutral' END AS sentiment FROM scores)"""


DOCUMENTS = _scores_sql("documents", "doc_id", "source", "text")
TALK = _scores_sql("conversations", "conv_id, turn", "role", "text")
COUNTS = ", ".join(f"count(*) FILTER (sentiment = '{c.title()}') AS {c}" for c in CLASSES)
SHARES = ", ".join(f"round_even({c} / total * 100, 1) AS {c}_pct" for c in CLASSES)


def _totals_sql(scored):
    return f"WITH {scored}, c AS (SELECT count(*) AS total, {COUNTS} FROM classed) SELECT *, {SHARES} FROM c"


def _products_sql(scored, product):
    texts = ", ".join(f"concat({c}, ' / ', total, ' (', {c}_pct, '%)') AS {c}_str" for c in CLASSES)
    return f"""{scored},
    c AS (SELECT {product} AS product_name, count(*) AS total, {COUNTS} FROM classed GROUP BY 1
          ORDER BY total DESC, product_name LIMIT 15),
    shares AS (SELECT concat('prod_', row_number() OVER (ORDER BY total DESC, product_name) - 1) AS prod_id, *, {SHARES} FROM c),
    products AS (SELECT *, {texts} FROM shares)"""


SAMPLES = f"""{_products_sql(DOCUMENTS, 'source')},
    chosen AS (SELECT prod_id, product_name, sentiment, body, doc_id,
                 row_number() OVER (PARTITION BY prod_id, sentiment ORDER BY doc_id)::INT AS place
               FROM classed JOIN products ON source = product_name),
    samples AS (SELECT prod_id, product_name, sentiment, place, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS comment
                FROM chosen WHERE place <= 30 AND regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> '')"""

SAMPLES_BY_LENGTH = SAMPLES.replace("ORDER BY doc_id)::INT", "ORDER BY length(body), doc_id)::INT")

QUERIES = {
    "sentiment_scores": (
        _document_scores,
        f"WITH {DOCUMENTS} SELECT doc_id, source AS product, compound_score, sentiment FROM classed",
    ),
    "sentiment_scores_conversations": (
        _conversation_scores,
        f"WITH {TALK} SELECT conv_id, turn, role, compound_score, sentiment FROM classed",
    ),
    "sentiment_totals": (_totals, _totals_sql(DOCUMENTS)),
    "sentiment_totals_conversations": (_totals_talk, _totals_sql(TALK)),
    "sentiment_by_product": (_by_product, f"WITH {_products_sql(DOCUMENTS, 'source')} SELECT * FROM products"),
    "sentiment_by_role": (_by_role, f"WITH {_products_sql(TALK, 'role')} SELECT * FROM products"),
    "comment_samples": (
        _comments,
        f"WITH {SAMPLES} SELECT prod_id, product_name, sentiment, place, md5(comment) AS comment FROM samples",
    ),
    "comment_samples_by_length": (
        _comments_by_length,
        f"WITH {SAMPLES_BY_LENGTH} SELECT prod_id, sentiment, place, md5(comment) AS comment FROM samples",
    ),
    "comments_map": (
        _comments_map,
        f"WITH {SAMPLES} SELECT prod_id, product_name, "
        + ", ".join(f"count(*) FILTER (sentiment = '{c.title()}') AS {c}" for c in CLASSES)
        + ", "
        + ", ".join(
            f"md5(coalesce(string_agg(comment, '|' ORDER BY place) FILTER (sentiment = '{c.title()}'), '')) AS {c}_digest"
            for c in CLASSES
        )
        + " FROM samples GROUP BY 1, 2",
    ),
    "comments_containing": (
        _containing,
        f"WITH {SAMPLES} SELECT prod_id, product_name, sentiment, place, md5(comment) AS comment FROM samples "
        "WHERE contains(lower(comment), 'best')",
    ),
    "sentiment_repeated_keys": (
        _repeated,
        f"WITH {DOCUMENTS} SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 ELSE -1 END AS doc_id, sentiment, count(*) AS n "
        "FROM classed GROUP BY 1, 2",
    ),
    "documents_containing": (
        _containing_all,
        "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'free')",
    ),
}
