"""Benchmark items inside documents: size-partitioned MinHash containment search, exact verification.

A short item inside a long document has hardly any resemblance to it, so the search is one-sided: each item is
represented by its MinHash minima, the smallest of its shingle hashes, and these are looked up among all shingles of
the documents. Items fall into partitions by the power of two of their set's size, each with its own number of minima:
enough that an item contained to the threshold cannot lose them all, or, beyond MOST_MINIMA, loses them all with a
probability under (1 - threshold) ** MOST_MINIMA. Candidates are verified on the full shingle sets. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import lower_ascii, windows, words
from tillwise.plans.scratch import save

WIDTH = 5
CONTAINED = 75
MOST_MINIMA = 64
# items are broadcast up to this many bytes of minima, and joined by shuffle beyond
SMALL_BYTES = 16 << 20


def shingles(text: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """(words, distinct shingle hashes given words as column ``w``); under ``width`` words make one shingle."""
    w = F.col("w")
    size = F.size(w)
    short = F.array(F.xxhash64(F.concat_ws("\n", w), size))
    none = F.array().cast("array<bigint>")
    hashes = F.when(size >= width, F.array_distinct(windows(w, size, width))).when(size > 0, short).otherwise(none)
    return words(lower_ascii(text)).alias("w"), hashes.alias("shingles")


def minima(items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """``items`` (item_id, shingles) with n, part (size partition) and minima, the smallest hashes."""
    n = F.size("shingles")
    # the largest set of the partition may lack this many shingles and still be contained
    part = F.floor(F.log2(n)).cast("int")
    lacking = F.floor((100 - contained) * (F.pow(F.lit(2.0), part + 1) - 1) / 100).cast("int")
    few = F.least(F.lit(MOST_MINIMA), lacking + 1)
    return items.where(n > 0).select(
        "item_id", "shingles", n.cast("long").alias("n"), part.alias("part"), F.slice(F.sort_array("shingles"), F.lit(1), few).alias("minima")
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", contained: int = CONTAINED,
) -> DataFrame:
    """doc_id, text_hash, item_id, n_common, n_item: items of which a document holds ``contained`` % or more.

    Sets are distinct five-word shingles of whole texts, A-Z lower-cased; a text of fewer words is one shingle of its
    own. A missing or empty text holds nothing and is held by nothing. text_hash (xxhash64) tells rows with one id
    apart; repeated rows give one result row. Missing ids are values like any other. Empty tables give no rows.
    """
    listed, hashes = shingles(col(item_text))
    items = benchmark.select(col(item_id).alias("item_id"), listed).select("item_id", hashes).distinct()
    items = save(minima(items, contained))
    wanted = items.select("item_id", F.xxhash64("shingles").alias("item_set"), F.explode("minima").alias("h"))
    wanted = save(wanted)

    listed, hashes = shingles(col(text))
    identity = [col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("text_hash")]
    found = docs.select(*identity, listed).select("doc_id", "text_hash", F.explode(hashes).alias("h"))
    # 24 bytes a minimum; beyond the bound Spark joins by shuffle, splitting hot shingles
    small = wanted.count() * 24 <= SMALL_BYTES
    pairs = found.join(F.broadcast(wanted) if small else wanted, "h")
    pairs = save(pairs.select("doc_id", "text_hash", "item_id", "item_set").distinct())

    few = pairs.select("doc_id", "text_hash").distinct()
    few = few.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"))
    same = col(doc_id).eqNullSafe(F.col("c_id")) & (F.xxhash64(col(text)) == F.col("c_hash"))
    # the candidates' texts are read again; only they are split into shingles
    full = docs.join(few, same, "left_semi").select(*identity, listed).select("doc_id", "text_hash", hashes)
    full = full.dropDuplicates(["doc_id", "text_hash"])
    named = pairs.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "item_id", "item_set")
    sets = items.select(F.col("item_id").alias("i_id"), F.xxhash64("shingles").alias("i_set"), F.col("shingles").alias("wanted"), "n")
    both = named.join(full, F.col("p_id").eqNullSafe(F.col("doc_id")) & (F.col("p_hash") == F.col("text_hash")))
    both = both.join(sets, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_set") == F.col("i_set")))
    common = F.size(F.array_intersect("shingles", "wanted")).cast("long")
    checked = both.select("doc_id", "text_hash", "item_id", common.alias("n_common"), F.col("n").alias("n_item"))
    checked = checked.where(100 * F.col("n_common") >= contained * F.col("n_item"))
    # an item listed twice with other texts counts by its best match
    best = F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_common", "n_item"))
    found = checked.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "text_hash", "item_id", "b.n_common", "b.n_item")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; see contaminated()."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    bad = contaminated(docs, benchmark, **names).select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"))
    bad = save(bad.distinct())
    same = col(doc_id).eqNullSafe(F.col("b_id")) & (F.xxhash64(col(text)) == F.col("b_hash"))
    return docs.join(bad, same, "left_anti")
