"""Column roles and suitability verdicts over the catalogue of all test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import TABLES, table
from tillwise.operators import roles as r


def _catalogue(spark, folder, **options):
    tables = {name: table(spark, folder, name) for name in TABLES}
    return r.catalogue(tables, {name: df.columns[:1] for name, df in tables.items()}, **options)


def _facts(spark, folder):
    measures = ["avg_words", "avg_len", "uniqueness", "non_null_ratio", "valid_ratio"]
    columns = ["dataset", "position", "column", "is_text", "is_date", "total_rows"]
    return _catalogue(spark, folder, measure_all=True).select(*columns, *[F.round(c, 6).alias(c) for c in measures])


def _over_catalogue(operator, **options):
    def run(spark, folder):
        found = operator(_catalogue(spark, folder, **options))
        if "missing_requirements" in found.columns:
            found = found.withColumn("missing_requirements", F.array_join("missing_requirements", "; "))
        return found

    return run


def _renamed(spark, folder):
    """Given tables under names that users write: plain, misspelt and numeric ones."""
    documents = table(spark, folder, "documents").withColumnsRenamed({"text": "reviewText", "source": "prodct"})
    labels = table(spark, folder, "labels").withColumnRenamed("quality", "rating")
    talk = table(spark, folder, "conversations").withColumnRenamed("text", "custmer_reveiw")
    tables = {"shop": documents.join(labels, "doc_id", "left"), "talk": talk}
    return r.review_roles(r.catalogue(tables, dates=False))


# text columns of the test tables, by table
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}
DATE_LIKE = r"\d{2,4}[-/.]\d{1,2}[-/.]\d{1,2}"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _catalogue_sql():
    named = " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, cid::INT AS position, name AS \"column\", type FROM pragma_table_info('{t}')" for t in TABLES
    )
    rows = " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS total_rows FROM {t}" for t in TABLES)
    texts = " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, '{c}' AS \"column\", avg(len(regexp_extract_all({c}, '\\S+'))) AS avg_words, "
        f"avg(length({c})) AS avg_len, count(DISTINCT {c}) / count({c}) AS uniqueness, "
        f"count({c}) / count(*) AS non_null_ratio, "
        f"avg(CASE WHEN regexp_matches({c}, '{NUMBER}') THEN 1.0 ELSE 0.0 END) AS valid_ratio, "
        f"(SELECT bool_or(regexp_matches({c}, '{DATE_LIKE}')) FROM (SELECT * FROM {t} ORDER BY 1 LIMIT 10)) AS seen FROM {t}"
        for t, columns in TEXTS.items()
        for c in columns
    )
    return f"""
    named AS ({named}), total AS ({rows}), texts AS ({texts}),
    dated AS (SELECT dataset, bool_or(regexp_matches(lower("column"), 'date|time|timestamp|dt|day')) AS by_name
              FROM named GROUP BY 1),
    facts AS (SELECT dataset, position, "column", type = 'VARCHAR' AS is_text,
                type = 'TIMESTAMP' OR (coalesce(seen, false) AND NOT by_name) AS is_date, total_rows,
                coalesce(avg_words, 0) AS avg_words, coalesce(avg_len, 0) AS avg_len, coalesce(uniqueness, 0) AS uniqueness,
                coalesce(non_null_ratio, 0) AS non_null_ratio,
                coalesce(valid_ratio, CASE WHEN type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 1.0 ELSE 0.0 END) AS valid_ratio
              FROM named JOIN total USING (dataset) JOIN dated USING (dataset) LEFT JOIN texts USING (dataset, "column"))"""


FACTS = _catalogue_sql()


def _first_sql(role, keywords, extra_order=""):
    """First keyword with a hit, then the column order; one row per table."""
    place = " ".join(f"WHEN contains(lower(\"column\"), '{k}') THEN {i}" for i, k in enumerate(keywords))
    return f"""{role} AS (SELECT dataset, "column" AS {role} FROM (SELECT *, CASE {place} END AS k FROM facts)
      WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY k, {extra_order} position) = 1)"""


def _pattern_sql(role, patterns):
    return f"""{role} AS (SELECT dataset, "column" AS {role} FROM facts WHERE regexp_matches(lower("column"), '{'|'.join(patterns)}')
      QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY position) = 1)"""


def _words_sql(keywords):
    return "list_has_any(words, [" + ", ".join(f"'{k}'" for k in keywords) + "])"


PREFERRED = "regexp_matches(lower(\"column\"), '" + "|".join(r.ID_PREFERRED) + "')"
SEGMENTATION = f"""{FACTS}, {_first_sql('id_col', r.ID_KEYWORDS, f'NOT {PREFERRED},')},
    {_first_sql('date_name', r.DATE_KEYWORDS)}, {_first_sql('amount_col', r.AMOUNT_KEYWORDS)},
    date_seen AS (SELECT dataset, "column" AS date_seen FROM facts WHERE is_date
      QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY position) = 1),
    roles AS (SELECT dataset, id_col, coalesce(date_name, date_seen) AS date_col, amount_col FROM total
      LEFT JOIN id_col USING (dataset) LEFT JOIN date_name USING (dataset) LEFT JOIN date_seen USING (dataset)
      LEFT JOIN amount_col USING (dataset))"""
RECOMMENDATION = f"""{FACTS}, {_pattern_sql('invoice_col', r.INVOICE_PATTERNS)}, {_pattern_sql('user_col', r.USER_PATTERNS)},
    {_pattern_sql('item_col', r.ITEM_PATTERNS)}, {_pattern_sql('qty_col', r.QTY_PATTERNS)},
    roles AS (SELECT dataset, invoice_col, user_col, item_col, qty_col FROM total LEFT JOIN invoice_col USING (dataset)
      LEFT JOIN user_col USING (dataset) LEFT JOIN item_col USING (dataset) LEFT JOIN qty_col USING (dataset))"""
# no column of the test tables is near enough to a keyword to match by similarity alone
REVIEW = f"""{FACTS}, worded AS (SELECT *, regexp_split_to_array(lower(regexp_replace("column", '([a-z0-9])([A-Z])', '\\1_\\2', 'g')),
      '[^a-z0-9]+') AS words FROM facts),
    scored AS (SELECT *, CASE WHEN {_words_sql(r.STRONG_REVIEW)} THEN 100 WHEN {_words_sql(r.WEAK_REVIEW)} THEN 20 ELSE 0 END AS review,
      CASE WHEN {_words_sql(r.STRONG_PRODUCT)} THEN 100 WHEN {_words_sql(r.WEAK_PRODUCT)} THEN 20 ELSE 0 END AS product FROM worded),
    review_pick AS (SELECT dataset, "column" AS review_col FROM scored WHERE is_text AND review > 0 AND NOT {_words_sql(r.ID_LIKE)}
      AND avg_words >= 3 AND non_null_ratio >= 0.05 QUALIFY row_number() OVER
      (PARTITION BY dataset ORDER BY review DESC, least(avg_words, 25) + uniqueness * 5 DESC, position) = 1),
    product_pick AS (SELECT dataset, "column" AS product_col FROM scored LEFT JOIN review_pick USING (dataset)
      WHERE "column" IS DISTINCT FROM review_col AND product > 0 AND NOT {_words_sql(r.PERSON)} QUALIFY row_number() OVER
      (PARTITION BY dataset ORDER BY product DESC, CASE WHEN is_text THEN avg_len ELSE 0 END, position) = 1),
    rating_pick AS (SELECT dataset, "column" AS rating_col FROM scored LEFT JOIN review_pick USING (dataset)
      LEFT JOIN product_pick USING (dataset) WHERE "column" IS DISTINCT FROM review_col AND "column" IS DISTINCT FROM product_col
      AND {_words_sql(r.RATING)} AND valid_ratio > 0.5 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY position) = 1),
    roles AS (SELECT dataset, review_col, product_col, rating_col, total_rows FROM total LEFT JOIN review_pick USING (dataset)
      LEFT JOIN product_pick USING (dataset) LEFT JOIN rating_pick USING (dataset))"""

QUERIES = {
    "column_catalogue": (
        _facts,
        f"WITH {FACTS} SELECT dataset, position, \"column\", is_text, is_date, total_rows, "
        + ", ".join(
            f"round({c}, 6) AS {c}" for c in ("avg_words", "avg_len", "uniqueness", "non_null_ratio", "valid_ratio")
        )
        + " FROM facts",
    ),
    "segmentation_roles": (_over_catalogue(r.segmentation_roles, content=False), f"WITH {SEGMENTATION} SELECT * FROM roles"),
    "recommendation_roles": (_over_catalogue(r.recommendation_roles, content=False, dates=False), f"WITH {RECOMMENDATION} SELECT * FROM roles"),
    "review_roles": (
        _over_catalogue(r.review_roles, dates=False),
        f"WITH {REVIEW} SELECT dataset, review_col, product_col, rating_col FROM roles",
    ),
    "review_roles_renamed": (
        _renamed,
        "SELECT * FROM (VALUES ('shop', 'reviewText', 'prodct', (SELECT CASE WHEN count(quality) * 2 > count(*) THEN 'rating' END "
        "FROM documents LEFT JOIN labels USING (doc_id))), ('talk', 'custmer_reveiw', NULL, NULL)) "
        "AS t(dataset, review_col, product_col, rating_col)",
    ),
    "segmentation_suitability": (
        _over_catalogue(r.segmentation_suitability, content=False),
        f"WITH {SEGMENTATION} SELECT *, concat_ws('; ', CASE WHEN id_col IS NULL THEN '{r.NEEDS_ID}' END, "
        f"CASE WHEN date_col IS NULL THEN '{r.NEEDS_DATE}' END, CASE WHEN amount_col IS NULL THEN '{r.NEEDS_AMOUNT}' END) "
        "AS missing_requirements, id_col IS NOT NULL AND date_col IS NOT NULL AND amount_col IS NOT NULL AS is_suitable "
        "FROM roles",
    ),
    "recommendation_suitability": (
        _over_catalogue(r.recommendation_suitability, content=False, dates=False),
        f"WITH {RECOMMENDATION} SELECT *, item_col IS NOT NULL AND (user_col IS NOT NULL OR invoice_col IS NOT NULL) "
        "AS is_suitable FROM roles",
    ),
    "review_suitability": (
        _over_catalogue(r.review_suitability, dates=False),
        f"WITH {REVIEW} SELECT roles.dataset, review_col, product_col, rating_col, CASE WHEN review_col IS NOT NULL THEN '' "
        f"WHEN t.has_text THEN '{r.NO_PROSE}' ELSE '{r.NO_TEXT}' END AS missing_requirements, "
        "review_col IS NOT NULL AS is_suitable FROM roles JOIN "
        "(SELECT dataset, bool_or(is_text) AS has_text FROM facts GROUP BY 1) t ON t.dataset = roles.dataset",
    ),
}
