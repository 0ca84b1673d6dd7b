"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by hash, hundreds a source at any size, so that the blocks of a small source hold a document or
two. Blocks of a source stand in a fixed random order, and the source's target says how many block draws it gives: whole
rounds over all its blocks and a last partial round. A tree splits these exact quotas: each node deals half of its draws,
of all sources at random, to either child, down to the output shards. A shard then takes the next blocks of each source's
order, so shards are disjoint and together exact, and shuffles them locally. The last round ends inside the random order,
whatever the sizes of the documents before its end; only the few nearest to it are chosen so that their sizes meet the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import WORD, free_name, whole
from tillwise.plans.ordering import with_global_rank
from tillwise.plans.scratch import save

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# a block holds about BLOCK_WORDS where that makes FEWEST_BLOCKS to MOST_BLOCKS of a source
BLOCK_WORDS, FEWEST_BLOCKS, MOST_BLOCKS = 65_536, 512, 1 << 16
SHARD_DRAWS = 64
# documents on either side of the end of the last round that are chosen by size
NEAREST = 16
# they are looked for in the blocks that come within FILL_WORDS of the end; more than LAST_ROWS documents there are first cut
# by further bits of the hash
FILL_WORDS, LAST_ROWS, CUT, HASH_CUTS = 65_536, 200_000, 4096, 4


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(whole(col(text)), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Sources in code point order, NULL last, weigh WEIGHTS in turn. Targets share the sum of all sizes by weight; one
    that passes MOST_COPIES times its source's size stops there and the rest is shared again by weight.
    """
    ordered = with_global_rank(sources, [F.col("source").cast("binary").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    table = save(ordered.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")))
    limit = F.col("source_size") * F.lit(float(MOST_COPIES))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # a full source stays full: each pass fills at least one more, few passes are needed in practice
    level, filled = 0.0, -1
    while True:
        state = table.agg(
            F.sum(F.when(F.col("full"), limit).otherwise(0.0)).alias("used"),
            F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.col("full").cast("int")).alias("filled"),
        ).first()
        if not state["open"] or state["filled"] == filled:
            break
        filled = state["filled"]
        level = (total - state["used"]) / state["open"]
        table = table.withColumn("full", F.col("full") | (F.col("weight") * F.lit(level) > limit))
    return table.select("source", "source_size", "weight", F.when(F.col("full"), limit).otherwise(F.col("weight") * level).alias("target"))


def _halve(quota: np.ndarray, draws: int, path: list[int]) -> np.ndarray:
    """How many of ``draws`` random draws, of the multiset ``quota``, each source gets."""
    rng = np.random.default_rng([20240611, *path])
    out, left, need = np.zeros_like(quota), int(quota.sum()), draws
    for i, q in enumerate(quota.tolist()):
        if need == 0:
            break
        left -= q
        # conditional on the sources before it, one source's share is hypergeometric
        out[i] = q if left == 0 and need == q else _draw(rng, q, left, need)
        need -= int(out[i])
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, need: int) -> int:
    """Numpy's draw is exact up to a billion in all; blocks are so few (see _rounds) that a mix stays below it."""
    if good == 0 or need == 0:
        return 0
    return need if bad == 0 else int(rng.hypergeometric(good, bad, need))


def _split(nodes: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for node in nodes:
        out = []
        for lo, hi, place, quota in zip(node["lo"], node["hi"], node["place"], node["quota"], strict=True):
            place, quota = np.asarray(place, np.int64), np.asarray(quota, np.int64)
            if hi - lo == 1:
                out.append((lo, hi, place, quota))
                continue
            middle = (lo + hi) // 2
            draws = int(quota.sum()) * (middle - lo) // (hi - lo)
            first = _halve(quota, draws, [lo, hi])
            for start, end, part in ((lo, middle, first), (middle, hi, quota - first)):
                some = part > 0
                out.append((start, end, place[some], part[some]))
        yield pd.DataFrame(out, columns=["lo", "hi", "place", "quota"])


def deal(quotas: DataFrame) -> DataFrame:
    """Shards' exact shares: place (of the source), shard, first, taken (draws), from ``quotas`` (place, draws).

    The tree's levels run as stages of row-wise splits. A node names only the sources it has draws of, so a level is never
    longer than all draws, however many sources and shards there are.
    """
    spark = quotas.sparkSession
    total = quotas.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-total // SHARD_DRAWS))
    packed = quotas.where("draws > 0").agg(F.sort_array(F.collect_list(F.struct("place", "draws"))).alias("q"))
    nodes = packed.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("q.place").alias("place"), F.col("q.draws").alias("quota"))
    schema = "lo long, hi long, place array<long>, quota array<long>"
    for level in range(max(shards - 1, 0).bit_length()):
        nodes = nodes.mapInPandas(_split, schema)
        if level % 6 == 5:
            nodes = save(nodes.repartition(spark.sparkContext.defaultParallelism))
    rows = save(nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("place", "quota")).alias("q")))
    rows = rows.select("shard", "q.place", F.col("q.quota").alias("taken"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("taken").over(before), F.lit(0)))


def _closest(sizes: list[int], wanted: int) -> list[bool]:
    """Which sizes add up to ``wanted`` or, failing that, closest below it; early ones stay rather than late ones."""
    unit = max(1, wanted >> 24)
    units, within = [-(-n // unit) for n in sizes], (1 << (wanted // unit + 1)) - 1
    # bit k: some of the sizes so far add up to k
    sums = [1]
    for n in units:
        sums.append((sums[-1] | sums[-1] << n) & within if n <= wanted // unit else sums[-1])
    taken, total = [False] * len(units), sums[-1].bit_length() - 1
    for i in range(len(units) - 1, -1, -1):
        if not sums[i] >> total & 1:
            taken[i], total = True, total - units[i]
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents before the end in the random order; of the NEAREST on either side of it, those that meet it best."""
    rows = rows.sort_values(["path", "h", "id"], kind="stable")
    wanted, size = int(rows["rest"].iloc[0] + 0.5), rows["size"].to_numpy()
    before = np.cumsum(size)
    end = int(np.searchsorted(before, wanted, side="right"))
    taken, start = np.arange(len(rows)) < end, max(0, end - NEAREST)
    around = slice(start, end + NEAREST)
    taken[around] = _closest(size[around].tolist(), wanted - int(before[start - 1] if start else 0))
    return rows.assign(last=taken)[["id", "place", "block", "last"]]


def _facts(docs: DataFrame, doc_id: str, source: str, text: str, keep: list[str]) -> DataFrame:
    """Written once: the kept columns, size, and what places a row (source, hash, row number)."""
    return save(docs.select(
        *map(col, keep), sizes(docs, text).alias("size"), col(source).cast("string").alias("_mix_source"),
        # the text tells rows with one id (or none) apart; rows alike in both are of one size
        F.xxhash64(col(doc_id).cast("string"), col(text), F.lit("mix")).alias("_mix_h"), F.monotonically_increasing_id().alias("_mix_row"),
    ))


def _rounds(facts: DataFrame) -> DataFrame:
    """Per source: its target as whole rounds over all its blocks and the words of a last, partial round."""
    # with very many sources each has fewer blocks, so that all draws stay below a billion
    sums = facts.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("size").alias("source_size"))
    size = F.col("source_size")
    rounds = F.when(size > 0, F.floor(F.col("target") / size + 1e-9)).otherwise(0).cast("int")
    sums = save(sums)
    most = max(1, min(MOST_BLOCKS, 300_000_000 // max(1, sums.count())))
    return save(source_targets(sums).select(
        F.col("source").alias("_mix_name"), "source_size", F.col("target").cast("double").alias("target"),
        F.xxhash64("source", F.col("source").isNull()).alias("_mix_place"),
        F.least(F.lit(most), F.greatest(F.lit(FEWEST_BLOCKS), F.ceil(size / BLOCK_WORDS))).cast("long").alias("_mix_blocks"),
        rounds.alias("_mix_rounds"), F.greatest(F.lit(0.0), F.col("target") - rounds * size).alias("_mix_rest"),
    ))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with size, source_size, target, taken, copies, shards (one per copy).

    A missing text has size 0, a missing source is a source of its own, documents without words are never taken.
    Repeated rows count each; rows with the same id, source and text fall into one block. The order is a hash of doc_id
    and text, blind to size, so reruns agree; rows alike in both are taken in any order. A source's sum comes
    as close below its target as the documents nearest to the end of its last round allow. No source and no document is taken more than MOST_COPIES times.
    An empty table gives an empty result. Columns of the input with the names of results are replaced.
    """
    results = {"size", "source_size", "target", "taken", "copies", "shards"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    # columns called like the ones used below stand aside
    if aside := {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower().startswith("_mix_")}:
        doc_id, source, text, *kept = [aside.get(c, c) for c in (doc_id, source, text, *keep)]
        return mix(docs.withColumnsRenamed(aside), doc_id, source, text, kept).withColumnsRenamed({v: c for c, v in aside.items()})
    facts = _facts(docs, doc_id, source, text, keep)
    targets = _rounds(facts)
    # one short row per source; far fewer than documents
    few = F.broadcast(targets) if targets.count() <= 100_000 else targets
    placed = facts.join(few, F.col("_mix_source").eqNullSafe(F.col("_mix_name")), "left")
    placed = placed.withColumn("_mix_block", F.pmod(F.col("_mix_h"), F.col("_mix_blocks")))

    # the random order of a source's blocks, and how many words stand before each
    per_source = [F.first(f"_mix_{c}").alias(c) for c in ("rest", "rounds")]
    table = placed.groupBy(F.col("_mix_place").alias("place"), F.col("_mix_block").alias("block"))
    table = save(table.agg(F.sum("size").alias("words"), *per_source))
    order = Window.partitionBy("place").orderBy(F.xxhash64("place", "block"), "block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    table = table.select(
        "*", (F.col("rest") - before).alias("left"), (F.row_number().over(order) - 1).cast("long").alias("pos"),
    )
    near = (F.col("rest") > 0) & (F.col("left") > -FILL_WORDS)
    part = F.when(F.col("left") - F.col("words") >= FILL_WORDS, "all").when(near, "some").otherwise("none")
    table = save(table.select("*", part.alias("part")))

    # the last round ends inside its order: the documents there are dealt one by one
    ends = table.where("part = 'some'")
    begin = ends.groupBy("place").agg(F.max("left").alias("rest"))
    ends = ends.select("place", "block", "pos").join(begin, "place").select(
        F.col("place").alias("_mix_place"), F.col("block").alias("_mix_block"), "pos", "rest"
    )
    border = placed.where("size > 0").select("_mix_row", "_mix_h", "size", "_mix_place", "_mix_block").join(ends, ["_mix_place", "_mix_block"])
    cut = _narrowed(border.select(
        F.col("_mix_row").alias("id"), F.col("_mix_place").alias("place"), F.col("_mix_block").alias("block"), "pos",
        F.col("_mix_h").alias("h"), "size", "rest",
    ))
    fitted = cut.where("sure IS NULL").groupBy("place").applyInPandas(_fit, "id long, place long, block long, last boolean")
    chosen = save(cut.where("sure").select("id", "place", "block").unionByName(fitted.where("last").drop("last")))
    hit = chosen.select("place", "block", F.lit(True).alias("hit")).distinct()
    again = (F.col("part") == "all") | F.coalesce("hit", F.lit(False))
    table = save(table.join(hit, ["place", "block"], "left").select("*", (F.col("rounds") + again.cast("int")).alias("copies")))

    # a source's draws: whole rounds, then the blocks of the last one
    shares = deal(save(table.groupBy("place").agg(F.sum("copies").cast("long").alias("draws"))))
    spots = shares.select("place", "shard", F.explode(F.sequence("first", F.col("first") + F.col("taken") - 1)).alias("spot"))
    drawn = table.where("copies > 0").select("place", "block", "pos", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    drawn = drawn.withColumn("spot", F.row_number().over(Window.partitionBy("place").orderBy("copy", "pos")).cast("long") - 1).join(spots, ["place", "spot"])
    shards = drawn.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("s"))
    blocks = table.join(shards, ["place", "block"], "left").select(
        F.col("place").alias("_mix_place"), F.col("block").alias("_mix_block"), F.col("part").alias("_mix_part"),
        F.col("s.shard").alias("_mix_shards"),
    )
    rows = placed.join(save(blocks), ["_mix_place", "_mix_block"], "left")

    chosen = chosen.select(F.col("id").alias("_mix_row"), F.lit(True).alias("_mix_chosen"))
    rows = rows.join(chosen, "_mix_row", "left")
    once = (F.col("_mix_part") == "all") | F.coalesce("_mix_chosen", F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("_mix_rounds") + once.cast("int")).otherwise(0)
    shards = F.slice(F.coalesce("_mix_shards", F.array().cast("array<bigint>")), F.lit(1), F.col("copies"))
    rows = rows.withColumn("copies", copies)
    taken = F.col("size") * F.col("copies")
    return rows.select(*map(col, keep), "size", "source_size", "target", taken.alias("taken"), "copies", shards.alias("shards"))


def _narrowed(rows: DataFrame) -> DataFrame:
    """``rows`` with path (their order) and sure: true (surely in), false (surely out) or NULL (dealt by document).

    Where more than LAST_ROWS documents of a source stand around its end, they are cut into pieces in order: blocks first,
    then further bits of the hash, and of the row for rows alike. Pieces that end over FILL_WORDS before the end are in,
    those that start as far after it out. Every document has a word, so what is left at last is small.
    """
    done, level = None, 0
    rows = save(rows.select("*", F.lpad(F.hex("pos"), 6, "0").alias("path")))
    while True:
        large = save(rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LAST_ROWS).select("place"))
        if large.isEmpty():
            break
        bits = F.pmod(F.xxhash64("h" if level <= HASH_CUTS else "id", F.lit(level)), F.lit(CUT))
        path = F.col("path") if level == 0 else F.concat("path", F.lpad(F.hex(bits), 6, "0"))
        cut = rows.join(large, "place", "left_semi").withColumn("path", path)
        sums = cut.groupBy("place", "path").agg(F.sum("size").alias("w"), F.first("rest").alias("r"))
        run = F.sum("w").over(Window.partitionBy("place").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
        left = F.col("r") - F.coalesce(run, F.lit(0))
        sums = sums.select("place", "path", "w", left.alias("left"))
        sure = F.when(F.col("left") - F.col("w") >= FILL_WORDS, True).when(F.col("left") <= -FILL_WORDS, False)
        sums = save(sums.withColumn("sure", sure))
        begin = sums.where("sure IS NULL").groupBy("place").agg(F.max("left").alias("rest"))
        cut = save(cut.drop("rest").join(sums.select("place", "path", "sure"), ["place", "path"]).join(begin, "place", "left"))
        settled = cut.where("sure IS NOT NULL").select(*rows.columns, "sure")
        done = settled if done is None else done.unionByName(settled)
        small = rows.join(large, "place", "left_anti")
        rows, level = save(small.unionByName(cut.where("sure IS NULL").select(*rows.columns))), level + 1
    rows = rows.withColumn("sure", F.lit(None).cast("boolean"))
    return rows if done is None else rows.unionByName(done)


def draw(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: one row per copy taken, with the columns of ``mix`` but shards, and copy (from 0), shard and place
    (its order in the shard, a hash). Documents that are not taken, and so those without words, have no row; repeated
    rows are drawn each; an empty table gives an empty result. Columns of the input with the names of results are replaced.
    """
    results = {"copy", "shard", "place"}
    keep = [c for c in docs.columns if c.lower() not in results]
    # the named columns may be called as a result
    asked = {name: free_name(docs, f"_mix_{role}") for name, role in ((doc_id, "id"), (source, "from"), (text, "body")) if name.lower() in results}
    named = docs.select(*map(col, keep), *[col(c).alias(a) for c, a in asked.items()])
    mixed = mix(named, asked.get(doc_id, doc_id), asked.get(source, source), asked.get(text, text))
    kept = [c for c in mixed.columns if c != "shards" and c not in asked.values()]
    spread = [*map(col, kept), F.posexplode("shards").alias("copy", "shard")]
    key = free_name(mixed, "_mix_key")
    rows = mixed.select(col(asked.get(doc_id, doc_id)).cast("string").alias(key), *spread)
    return rows.select(*map(col, kept), "copy", "shard", F.xxhash64(key, "copy", "shard").alias("place"))
