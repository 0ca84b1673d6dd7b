"""Customer segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import table
from tillwise.operators import segments as s


def _orders(spark, folder):
    return table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice"


def _events(spark, folder):
    return table(spark, folder, "events"), "user_id", "ts", "value"


def _refunds(spark, folder):
    """Orders of some customers taken back, so that their sum is not positive."""
    amount = F.expr("CASE WHEN o_custkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END")
    return table(spark, folder, "orders").withColumn("amount", amount), "o_custkey", "o_orderdate", "amount"


def _text_dates(spark, folder):
    """Order days written as texts, day first."""
    orders = table(spark, folder, "orders").withColumn("placed", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return orders, "o_custkey", "placed", "o_totalprice"


def _regions(spark, folder):
    """Five buyers only: orders by region."""
    t = {n: table(spark, folder, n) for n in ("orders", "customer", "nation", "region")}
    joined = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined, "r_name", "o_orderdate", "o_totalprice"


def _money(df):
    return df.withColumn("Monetary", F.round("Monetary", 2))


def _table(source):
    return lambda spark, folder: _money(s.rfm_table(*source(spark, folder)))


def _segments(source, find_whales=True):
    return lambda spark, folder: _money(s.rfm_segments(*source(spark, folder), find_whales=find_whales))


def _summary(spark, folder):
    return s.segment_summary(s.rfm_segments(*_orders(spark, folder)))


def _lof(spark, folder):
    scored = s.with_outlier_scores(s.rfm_table(*_orders(spark, folder)))
    return scored.select("o_custkey", F.round("lof_score", 6).alias("lof_score"), "is_outlier")


def _whales(spark, folder):
    return _money(s.whales(s.rfm_table(*_orders(spark, folder))))


def _rfm_sql(source, key, date, amount):
    return f"""
    anchor AS (SELECT max({date}) + INTERVAL 1 DAY AS a FROM {source}),
    rfm AS (
      SELECT {key}, date_sub('day', max({date}), (SELECT a FROM anchor)) AS "Recency",
             count(*) AS "Frequency", sum({amount}) AS "Monetary"
      FROM {source} GROUP BY {key} HAVING sum({amount}) > 0)"""


def _lof_sql(key):
    return f"""
    f AS (SELECT {key} AS id, ln(1 + "Recency") AS x, ln(1 + "Frequency") AS y, ln(1 + "Monetary") AS z FROM rfm),
    d AS (SELECT a.id AS q, b.id AS nb, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
          FROM f a JOIN f b ON a.id <> b.id),
    nn AS (SELECT q, nb, d FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, nb)
           <= least(20, (SELECT count(*) - 1 FROM f))),
    kd AS (SELECT q, max(d) AS kd FROM nn GROUP BY q),
    lrd AS (SELECT nn.q, 1 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.q = nn.nb GROUP BY nn.q),
    lof AS (SELECT nn.q AS id, -avg(b.lrd) / any_value(a.lrd) AS lof_score
            FROM nn JOIN lrd a ON a.q = nn.q JOIN lrd b ON b.q = nn.nb GROUP BY nn.q),
    flags AS (SELECT id, lof_score, lof_score < (SELECT quantile_cont(lof_score, 0.02) FROM lof) AS is_outlier FROM lof),
    whale AS (SELECT rfm.*, is_outlier AND "Monetary" >= (SELECT quantile_cont("Monetary", 0.9) FROM rfm) AS w
              FROM rfm JOIN flags ON flags.id = rfm.{key})"""


def _segments_sql(key, whale_table):
    return f"""
    caps AS (SELECT quantile_cont("Monetary", 0.99) AS mc, quantile_cont("Frequency", 0.99) AS fc, count(*) AS n FROM rfm),
    ranks AS (SELECT w.*, n,
                row_number() OVER (ORDER BY "Recency", {key}) AS r,
                row_number() OVER (ORDER BY least("Frequency", fc), {key}) AS f,
                row_number() OVER (ORDER BY least("Monetary", mc), {key}) AS m
              FROM {whale_table} w, caps),
    scores AS (SELECT *, 5 - greatest(1, (4*(r-1)+n-2) // (n-1))::INT AS "R_Score",
                 greatest(1, (4*(f-1)+n-2) // (n-1))::INT AS "F_Score",
                 greatest(1, (4*(m-1)+n-2) // (n-1))::INT AS "M_Score" FROM ranks),
    segments AS (SELECT {key}, "Recency", "Frequency", round("Monetary", 2) AS "Monetary",
        "R_Score", "F_Score", "M_Score", concat("R_Score", "F_Score", "M_Score") AS "RFM_Score",
        CASE WHEN w THEN 'VIP / Whale'
             WHEN "R_Score" + "F_Score" + "M_Score" >= 11 THEN 'Premium / Champion'
             WHEN "F_Score" >= 3 THEN 'Loyal Customer'
             WHEN "R_Score" >= 3 AND "M_Score" <= 2 THEN 'Discount Seeker'
             WHEN "R_Score" = 2 THEN 'At Risk' ELSE 'Lost Customer' END AS "Segment" FROM scores)"""


ORDERS = _rfm_sql("orders", "o_custkey", "o_orderdate", "o_totalprice")
EVENTS = _rfm_sql("events", "user_id", "ts", "value")
REGIONS = (
    "regions AS (SELECT r_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),"
    + _rfm_sql("regions", "r_name", "o_orderdate", "o_totalprice")
)
REFUNDS = (
    "refunds AS (SELECT o_custkey, o_orderdate, CASE WHEN o_custkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount "
    "FROM orders)," + _rfm_sql("refunds", "o_custkey", "o_orderdate", "amount")
)
TEXT_DATES = (
    "days AS (SELECT o_custkey, date_trunc('day', o_orderdate)::TIMESTAMP AS placed, o_totalprice FROM orders),"
    + _rfm_sql("days", "o_custkey", "placed", "o_totalprice")
)
MONEY = 'round("Monetary", 2) AS "Monetary"'
PLAIN = "calm AS (SELECT *, false AS w FROM rfm),"

QUERIES = {
    "rfm_table": (_table(_orders), f'WITH {ORDERS} SELECT o_custkey, "Recency", "Frequency", {MONEY} FROM rfm'),
    "rfm_table_events": (_table(_events), f'WITH {EVENTS} SELECT user_id, "Recency", "Frequency", {MONEY} FROM rfm'),
    "rfm_table_refunds": (
        _table(_refunds),
        f'WITH {REFUNDS} SELECT o_custkey, "Recency", "Frequency", {MONEY} FROM rfm',
    ),
    "rfm_table_text_dates": (
        _table(_text_dates),
        f'WITH {TEXT_DATES} SELECT o_custkey, "Recency", "Frequency", {MONEY} FROM rfm',
    ),
    "rfm_segments_without_whales": (
        _segments(_orders, find_whales=False),
        f"WITH {ORDERS}, {PLAIN} {_segments_sql('o_custkey', 'calm')} SELECT * FROM segments",
    ),
    "rfm_segments": (
        _segments(_orders),
        f"WITH {ORDERS}, {_lof_sql('o_custkey')}, {_segments_sql('o_custkey', 'whale')} SELECT * FROM segments",
    ),
    "rfm_segments_events": (
        _segments(_events),
        f"WITH {EVENTS}, {_lof_sql('user_id')}, {_segments_sql('user_id', 'whale')} SELECT * FROM segments",
    ),
    "rfm_segments_few_customers": (
        _segments(_regions),
        f'WITH {REGIONS} SELECT r_name, "Recency", "Frequency", {MONEY}, '
        "'Standard Customer' AS \"Segment\" FROM rfm",
    ),
    "segment_summary": (
        _summary,
        f"WITH {ORDERS}, {_lof_sql('o_custkey')}, {_segments_sql('o_custkey', 'whale')} "
        'SELECT "Segment", count(*) AS customers, round(sum("Monetary"), 2) AS revenue FROM segments GROUP BY "Segment"',
    ),
    "lof_scores": (
        _lof,
        f"WITH {ORDERS}, {_lof_sql('o_custkey')} SELECT id AS o_custkey, round(lof_score, 6) AS lof_score, is_outlier "
        "FROM flags",
    ),
    "whales": (
        _whales,
        f"WITH {ORDERS}, {_lof_sql('o_custkey')} SELECT o_custkey, \"Recency\", \"Frequency\", {MONEY} FROM whale WHERE w",
    ),
}
