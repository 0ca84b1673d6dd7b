"""The operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    chat, decontaminate, exact_dedup, licenses, lm_score, mixing, odd_sketch, periodic_runs, quality, spelling, token_counts,
    toxicity, url_filter,
)
from tillwise.llm.common import fold, lower_ascii, whole, words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_rate", "host_rejected",
    )


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", lm_score.held_out())
    scored = lm_score.score(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_common", "n_item")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"])
    held_out = fold(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_chat_texts(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_texts(table(spark, folder, "conversations"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), keep=["doc_id"])


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def _misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of seven letters or more, every 31st (by checksum of document and word) with a letter left out."""
    found = docs.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(whole(F.col("text"))), F.lit(r"[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("id", "run").cast("binary"))
    gone = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))
    written = found.select(F.when(h % 31 == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    return written.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.spelling_variants(_misspelt_words(table(spark, folder, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by checksum of the id) with a tail that repeats a stretch of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    drawn = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    sized = drawn.select("*", F.size("w").alias("n")).select(
        "*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a")
    ).select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), 1, F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(table(spark, folder, "documents")), keep=["doc_id"])
    # the greatest exponent, compared exactly
    higher = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]
    by = lambda a, b: F.when(higher(a, b) != 0, F.sign(higher(a, b))).when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(a["period"] - b["period"])).cast("int")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", F.get(F.array_sort("runs", by), 0))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


W = r"'[^\x20\x09-\x0D]+'"

QUALITY_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {W}) AS w
  FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, {W}) GROUP BY r),
runs AS (SELECT r, i, w[i:i + 4] AS run FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS u(k) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines ON lines.r = w.r LEFT JOIN covered ON covered.r = w.r),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 10 * n_symbols > n_words AS symbols,
    10 * n_dup_lines > 3 * n_lines AS dup, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS len FROM m),
rates AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS k FROM (
    SELECT source, unnest(['base', 'symbols', 'lines', 'length']) AS rule, unnest([base, symbols, dup, len]) AS failed
    FROM f WHERE source IS NOT NULL) GROUP BY source, rule),
means AS (SELECT rule, sum(k) / sum(n) AS p FROM rates GROUP BY rule),
priors AS (
  SELECT rule, any_value(p) AS p, sum(n * (pow(k / n - p, 2) - p * (1 - p) / n)) / sum(n) AS v FROM rates JOIN means USING (rule) GROUP BY rule),
shrunk AS (
  SELECT source, rule, p, n + s AS weight, (k + p * s) / (n + s) AS rate FROM rates JOIN (
    SELECT rule, p, CASE WHEN v > 0 THEN least(greatest(p * (1 - p) / v - 1, 1), 1000) ELSE 1000 END AS s FROM priors) USING (rule)),
hosts AS (
  SELECT source, round(max(rate) FILTER (rule = 'base'), 6) AS host_rate,
    bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > greatest(0.5, 4 * p / (1 - p + 4 * p))) AS rejected
  FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND NOT coalesce(rejected, false) AS kept, host_rate, coalesce(rejected, false) AS host_rejected
FROM f LEFT JOIN hosts USING (source)
"""

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {W}) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], chr(10))) AS h FROM w, unnest(range(1, len(w) - 3)) AS u(i)
  UNION ALL SELECT doc_id, 'short ' || array_to_string(w, chr(10)) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN edges ON edges.a = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

LEAKS_SQL = rf"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {W}) AS w
  FROM t),
s AS (
  SELECT DISTINCT k, id, array_to_string(w[i:i + 4], chr(10)) AS h FROM w, unnest(range(1, len(w) - 3)) AS u(i)
  UNION ALL SELECT k, id, 'short ' || array_to_string(w, chr(10)) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY id),
c AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM s AS d JOIN s AS b ON d.h = b.h AND d.k = 'd' AND b.k = 'b' GROUP BY ALL)
SELECT doc_id, item_id, n_common, n AS n_item FROM c JOIN n ON n.id = item_id WHERE 100 * n_common >= 75 * n
"""

CHAT_SQL = r"""
WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM said),
prefixes AS (
  SELECT conv_id, k, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10))
    OVER (PARTITION BY conv_id ORDER BY k) AS chat, k = count(*) OVER (PARTITION BY conv_id) AS own FROM placed),
whole AS (SELECT chat, min(conv_id) AS conv_id, any_value(k) AS n_turns, count(*) AS n_copies FROM prefixes WHERE own GROUP BY chat)
SELECT conv_id, n_turns, n_copies, chat FROM whole ANTI JOIN (SELECT chat FROM prefixes WHERE NOT own) AS longer USING (chat)
"""

def _crc32_sql(text):
    """DuckDB has no crc32: bytes are added to the checksum one by one, each followed by eight shifts (marked -1)."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, strlen({text})),
      lambda i: [('0x' || substr(hex({text}), (2 * i + 1)::BIGINT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


SPELLING_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')) AS run FROM documents),
c AS (SELECT d || run AS k, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_crc32_sql('k')} AS h FROM c),
v AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS bn FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT w.word, d.word, d.n FROM w JOIN d ON d.rest = w.word
  UNION SELECT d.word, w.word, w.n FROM w JOIN d ON d.rest = w.word),
near AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(k := -bn, b := b)) AS best FROM pairs GROUP BY a),
f AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.k >= 10 * n THEN best.b END AS form,
    CASE WHEN -best.k >= 10 * n THEN -best.k END::BIGINT AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

COPIES_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

RUNS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {W}) AS w, {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (
  SELECT r, i, CASE WHEN a IS NOT NULL AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM p, unnest(range(0, n)) AS u(i)),
five AS (
  SELECT r, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) ||
    lead(word, 4) OVER o AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
met AS (SELECT b.r, b.i, b.i - a.i AS lag FROM five AS a JOIN five AS b ON a.r = b.r AND a.k = b.k AND a.i < b.i),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS isle FROM met),
long AS (
  SELECT r, lag AS period, min(i) - lag AS start, count(*) + 4 + lag AS length FROM isles GROUP BY r, lag, isle
  HAVING count(*) + 4 + lag >= greatest(6, 4 * lag)),
runs AS (SELECT r, start, length, min(period) AS period FROM long GROUP BY ALL),
best AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -(length::DOUBLE / period), s := start, p := period)) AS best FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY i)) AS s FROM w ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(s, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, QUALITY_SQL),
    "op2_lm_score": (op2_lm_score, None),
    "op3_mix_sources": (op3_mix_sources, None),
    "op4_near_duplicates": (op4_near_duplicates, NEAR_SQL),
    "op5_decontaminate": (op5_decontaminate, LEAKS_SQL),
    "op6_url_filter": (op6_url_filter, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_chat_texts": (op8_chat_texts, CHAT_SQL),
    "op9_license_scan": (op9_license_scan, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_spelling_variants": (op11_spelling_variants, SPELLING_SQL),
    "op12_exact_duplicates": (op12_exact_duplicates, COPIES_SQL),
    "op13_periodic_runs": (op13_periodic_runs, RUNS_SQL),
}
