"""Popular items, market baskets and similar customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import table
from tillwise.operators import baskets as b
from tillwise.operators import neighbours as n
from tillwise.operators.popularity import popular_items
from tillwise.operators.recommend import recommend
from tillwise.plans.scratch import save


def _lines(spark, folder):
    return table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def _sales(spark, folder):
    """Lines with their customer, as the reports need them."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = _lines(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_custkey", "l_orderkey", "l_partkey", "p_name", "p_brand", "p_type", "l_quantity")


def _popular(qty):
    return lambda spark, folder: popular_items(_lines(spark, folder), "p_name", qty)


def _itemsets(item):
    def run(spark, folder):
        found = b.frequent_itemsets(b.build_baskets(_lines(spark, folder), "l_orderkey", item, "l_quantity"))
        return found.select(F.array_join("items", ", ").alias("items"), "freq", F.round("support", 9).alias("support"))

    return run


def _itemsets_limited(spark, folder):
    """Only the ten items in the most baskets take part."""
    found = b.frequent_itemsets(b.build_baskets(_lines(spark, folder), "l_orderkey", "p_brand", "l_quantity", item_limit=10))
    return found.select(F.array_join("items", ", ").alias("items"), "freq", F.round("support", 9).alias("support"))


def _rules(item):
    def run(spark, folder):
        rules = b.association_rules(b.build_baskets(_lines(spark, folder), "l_orderkey", item, "l_quantity"))
        return rules.select(
            F.array_join("antecedents", ", ").alias("antecedents"),
            F.array_join("consequents", ", ").alias("consequents"),
            *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")],
        )

    return run


def _top_rules(item):
    def run(spark, folder):
        baskets = b.build_baskets(_lines(spark, folder), "l_orderkey", item, "l_quantity")
        return b.top_rules(b.association_rules(baskets))

    return run


def _baskets(spark, folder):
    """Sizes of the baskets when low quantities count as not given."""
    lines = _lines(spark, folder).withColumn("qty", F.expr("CASE WHEN l_quantity > 10 THEN l_quantity END"))
    baskets = b.build_baskets(lines, "l_orderkey", "p_type", "qty")
    sizes = baskets.rows.groupBy(F.size("items").alias("items")).agg(F.count(F.lit(1)).alias("baskets"))
    return sizes.withColumn("all_baskets", F.lit(baskets.total).cast("long"))


def _weights(spark, folder):
    return n.user_item_weights(_sales(spark, folder), "o_custkey", "p_name", "l_quantity")


def _weights_by_rows(spark, folder):
    return n.user_item_weights(_sales(spark, folder), "o_custkey", "p_brand")


def _similar(spark, folder):
    """The preview: the first users only."""
    weights = save(_weights(spark, folder))
    near = n.similar_users(weights, n.first_users(weights))
    return near.select("user", "neighbour", F.round("similarity", 9).alias("similarity"), "place")


def _similar_all(spark, folder):
    near = n.similar_users(save(_weights(spark, folder)))
    return near.select("user", "neighbour", F.round("similarity", 9).alias("similarity"), "place")


def _candidates(spark, folder):
    weights = save(_weights(spark, folder))
    return n.candidate_items(weights, n.similar_users(weights))


def _served(spark, folder):
    return n.recommend_to_users(_sales(spark, folder), "o_custkey", "p_name", "l_quantity")


def _served_many(spark, folder):
    """All customers, one of them with nothing but weights of zero."""
    sales = _sales(spark, folder).withColumn("qty", F.expr("CASE WHEN o_custkey = 4 THEN 0 ELSE l_quantity END"))
    return n.recommend_to_users(sales, "o_custkey", "p_name", "qty")


def _served_cold(spark, folder):
    return n.recommend_to_users(table(spark, folder, "events"), "user_id", "event_type", "value")


def _choice(spark, folder):
    """Which method each kind of item column leads to."""
    sales = save(_sales(spark, folder))
    parts = []
    for item, options in {
        "p_type": {"user_col": "o_custkey", "invoice_col": "l_orderkey", "qty_col": "l_quantity"},
        "l_partkey": {"user_col": "o_custkey", "invoice_col": "l_orderkey", "qty_col": "l_quantity"},
        "p_brand": {},
    }.items():
        chosen = recommend(sales, item, **options, targets=n.first_users(n.user_item_weights(sales, "o_custkey", item)))
        parts.append(
            chosen.popular_items.select(
                F.lit(item).alias("item_col"), F.lit(chosen.algorithm_code).alias("algorithm_code"), "item", "score"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LINES = "lines AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
SALES = f"{LINES}, sales AS (SELECT lines.*, o_custkey FROM lines JOIN orders ON l_orderkey = o_orderkey)"


def _itemsets_sql(item):
    return f"""WITH RECURSIVE {LINES}, pairs AS (SELECT DISTINCT l_orderkey AS o, {item}::VARCHAR AS i FROM lines),
    total AS (SELECT count(DISTINCT o)::DOUBLE AS n FROM pairs),
    often AS (SELECT i FROM pairs GROUP BY i HAVING count(*) / (SELECT n FROM total) >= 0.01),
    kept AS (SELECT o, i FROM pairs SEMI JOIN often USING (i)),
    sets(o, items, tail) AS (
      SELECT o, [i], i FROM kept
      UNION ALL SELECT s.o, list_append(s.items, p.i), p.i FROM sets s JOIN kept p ON p.o = s.o AND p.i > s.tail),
    frequent AS (SELECT items, count(*) AS freq, count(*) / (SELECT n FROM total) AS support
                 FROM sets GROUP BY items HAVING count(*) / (SELECT n FROM total) >= 0.01),
    rules AS (SELECT array_to_string(a.items, ', ') AS antecedents, array_to_string(c.items, ', ') AS consequents,
                s.support, s.support / a.support AS confidence, s.support / a.support / c.support AS lift
              FROM frequent s JOIN frequent a ON len(a.items) < len(s.items) AND list_has_all(s.items, a.items)
              JOIN frequent c ON len(c.items) = len(s.items) - len(a.items) AND list_has_all(s.items, c.items)
                AND NOT list_has_any(a.items, c.items)
              WHERE s.support / a.support / c.support >= 1.0)"""


def _rules_sql(item):
    return (
        f"{_itemsets_sql(item)} SELECT antecedents, consequents, round(support, 9) AS support, "
        "round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM rules"
    )


def _top_rules_sql(item):
    return (
        f"{_itemsets_sql(item)} SELECT antecedents AS if_bought, consequents AS recommended, "
        "round_even(confidence * 100, 1) AS confidence, round_even(lift, 2) AS lift FROM (SELECT * FROM rules "
        "ORDER BY rules.lift DESC, rules.confidence DESC, antecedents, consequents LIMIT 10)"
    )


def _found_sql(item):
    return (
        f"{_itemsets_sql(item)} SELECT array_to_string(items, ', ') AS items, freq, round(support, 9) AS support "
        "FROM frequent"
    )


def _similar_sql(source, user, item, qty, targets="true"):
    return f"""{source},
    w AS (SELECT {user} AS u, {item} AS i, sum({qty}) AS w FROM sales GROUP BY 1, 2),
    norm AS (SELECT u, sqrt(sum(w * w)) AS n FROM w GROUP BY u),
    target AS (SELECT u AS t, n AS tn FROM norm WHERE {targets}),
    dots AS (SELECT t, b.u, sum(a.w * b.w) AS dot FROM target JOIN w a ON a.u = t JOIN w b ON b.i = a.i GROUP BY t, b.u),
    sim AS (SELECT t, norm.u, coalesce(dot / nullif(tn * n, 0), 0) AS s FROM target CROSS JOIN norm
            LEFT JOIN dots USING (t, u) WHERE t <> norm.u),
    near AS (SELECT t, u, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, u) AS place FROM sim
             QUALIFY row_number() OVER (PARTITION BY t ORDER BY s DESC, u) <= 5),
    offered AS (SELECT t, i, sum(w) AS score FROM near JOIN w ON w.u = near.u GROUP BY t, i HAVING sum(w) > 0),
    fresh AS (SELECT t, i, score, row_number() OVER (PARTITION BY t ORDER BY score DESC, i) AS place FROM offered o
              WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.u = o.t AND w.i = o.i AND w.w > 0)),
    popular AS (SELECT {item} AS i, sum({qty}) AS q FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
    cold AS (SELECT t, i, row_number() OVER (PARTITION BY t ORDER BY q DESC, i) AS place FROM target CROSS JOIN popular
             WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.t = target.t)),
    served AS (SELECT t AS "user", i AS item, place::INT AS place, 'similar customers' AS source FROM fresh WHERE place <= 5
               UNION ALL SELECT t, i, place::INT, 'best sellers' FROM cold)"""


SIMILAR = _similar_sql(SALES, "o_custkey", "p_name", "l_quantity")
SIMILAR_FIRST = _similar_sql(SALES, "o_custkey", "p_name", "l_quantity", "true ORDER BY u LIMIT 10")
SIMILAR_EVENTS = _similar_sql("sales AS (SELECT * FROM events)", "user_id", "event_type", "value")

SIMILAR_MANY = _similar_sql(SALES, "o_custkey", "p_name", "CASE WHEN o_custkey = 4 THEN 0 ELSE l_quantity END")

QUERIES = {
    "popular_by_quantity": (
        _popular("l_quantity"),
        f"WITH {LINES} SELECT p_name AS item, trunc(sum(l_quantity))::BIGINT AS score FROM lines GROUP BY 1 "
        "ORDER BY sum(l_quantity) DESC, 1 LIMIT 5",
    ),
    "popular_by_rows": (
        _popular(None),
        f"WITH {LINES} SELECT p_name AS item, count(*) AS score FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "basket_sizes": (
        _baskets,
        f"WITH {LINES}, b AS (SELECT l_orderkey, count(DISTINCT p_type) AS items FROM lines WHERE l_quantity > 10 GROUP BY 1) "
        "SELECT items::INT AS items, count(*) AS baskets, (SELECT count(DISTINCT l_orderkey) FROM lines) AS all_baskets "
        "FROM b GROUP BY 1",
    ),
    "itemsets_type": (_itemsets("p_type"), _found_sql("p_type")),
    "itemsets_brand": (_itemsets("p_brand"), _found_sql("p_brand")),
    "itemsets_limited": (
        _itemsets_limited,
        _found_sql("p_brand").replace(
            "often AS (SELECT i FROM pairs GROUP BY i HAVING count(*) / (SELECT n FROM total) >= 0.01)",
            "often AS (SELECT i FROM pairs GROUP BY i ORDER BY count(*) DESC, i LIMIT 10)",
        ),
    ),
    "itemsets_none": (_itemsets("l_partkey"), _found_sql("l_partkey")),
    "association_rules": (_rules("p_type"), _rules_sql("p_type")),
    "association_rules_brand": (_rules("p_brand"), _rules_sql("p_brand")),
    "top_rules": (_top_rules("p_type"), _top_rules_sql("p_type")),
    "top_rules_none": (_top_rules("p_name"), _top_rules_sql("p_name")),
    "user_item_weights": (
        _weights,
        f'WITH {SALES} SELECT o_custkey AS "user", p_name AS item, sum(l_quantity) AS weight FROM sales GROUP BY 1, 2',
    ),
    "user_item_counts": (
        _weights_by_rows,
        f'WITH {SALES} SELECT o_custkey AS "user", p_brand AS item, count(*)::DOUBLE AS weight FROM sales GROUP BY 1, 2',
    ),
    "similar_users": (
        _similar,
        f'WITH {SIMILAR_FIRST} SELECT t AS "user", u AS neighbour, round(s, 9) AS similarity, place::INT AS place FROM near',
    ),
    "similar_users_all": (
        _similar_all,
        f'WITH {SIMILAR} SELECT t AS "user", u AS neighbour, round(s, 9) AS similarity, place::INT AS place FROM near',
    ),
    "candidate_items": (
        _candidates,
        f'WITH {SIMILAR} SELECT t AS "user", i AS item, score, place::INT AS place FROM fresh WHERE place <= 5',
    ),
    "recommend_to_users": (_served, f"WITH {SIMILAR} SELECT * FROM served"),
    "recommend_to_users_many": (_served_many, f"WITH {SIMILAR_MANY} SELECT * FROM served"),
    "recommend_best_sellers": (_served_cold, f"WITH {SIMILAR_EVENTS} SELECT * FROM served"),
    "recommend_choice": (
        _choice,
        f"""WITH {SALES}, total AS (SELECT count(DISTINCT l_orderkey) AS n FROM sales),
        most AS (SELECT max(c) AS c FROM (SELECT count(DISTINCT l_orderkey) AS c FROM sales GROUP BY l_partkey)),
        types AS (SELECT p_type AS item, sum(l_quantity) AS q FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
        keys AS (SELECT l_partkey::VARCHAR AS item, sum(l_quantity) AS q FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
        brands AS (SELECT p_brand AS item, count(*) AS q FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT 'p_type' AS item_col, 'apriori' AS algorithm_code, item, trunc(q)::BIGINT AS score FROM types
        UNION ALL SELECT 'l_partkey', CASE WHEN c / n >= 0.01 THEN 'apriori' ELSE 'collaborative' END, item,
          trunc(q)::BIGINT FROM keys, total, most
        UNION ALL SELECT 'p_brand', 'popularity', item, q FROM brands""",
    ),
}
