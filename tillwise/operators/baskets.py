"""Market baskets: frequent itemsets and association rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import known
from tillwise.operators.popularity import item_text
from tillwise.plans.ordering import shuffle_width
from tillwise.plans.scratch import save, temporary

# fixed values
MIN_SUPPORT = 0.01
MIN_LIFT = 1.0

# items that go into bits of whole numbers, at most
MASKED, WORD = 1024, 64


@dataclass
class Baskets:
    """Distinct items per basket as small codes; ``total`` counts emptied baskets too.

    ``kinds`` has the baskets of equal items once, with their number ``n``. ``mined`` keeps the itemsets once they are found, for the
    reports made from them.
    """

    kinds: DataFrame
    names: list[str]
    total: int
    least: int
    mined: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """One row per basket."""
        return _each(self.kinds)


def _each(kinds: DataFrame) -> DataFrame:
    """A row per basket, in as many partitions as the session shuffles to: a kind of many baskets is dealt out in parts."""
    width = shuffle_width(kinds)
    parts = kinds.select("items", "n", F.least("n", F.lit(width)).alias("parts"))
    parts = parts.select("items", "n", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    size = F.expr("n div parts + if(part < n % parts, 1, 0)")
    dealt = parts.select("items", size.alias("size"), "part").repartition(width, "part", "items")
    return dealt.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "size"))).select("items")


def _least_count(total: int, share: float) -> int:
    """Smallest count whose share of ``total`` reaches the wanted one, in double arithmetic."""
    count = max(1, int(share * total) - 1)
    while count / total < share:
        count += 1
    return count


def build_baskets(
    df: DataFrame,
    invoice_col: str,
    item_col: str,
    qty_col: str | None = None,
    min_support: float = MIN_SUPPORT,
    item_limit: int | None = None,
) -> Baskets:
    """One array of item codes per basket that keeps any frequent item.

    An item with fewer rows than the least number of baskets is not frequent, so only items with enough rows are gathered per
    invoice: as bits of whole numbers, which tasks merge before anything is shuffled, so neither a huge invoice nor a hot item meets
    in one task. Beyond MASKED such items, distinct pairs spread by (invoice, item) are gathered. At most ``item_limit`` items are kept if
    given. Minimum support bounds the number of items by the average number of rows of a basket over ``min_support``.
    A quantity that is missing does not put its item into the basket.
    """
    lines = df.select(
        known(df, invoice_col).alias("invoice"),
        item_text(df, item_col).alias("item"),
        (known(df, qty_col).isNotNull() if qty_col and qty_col in df.columns else F.lit(True)).alias("bought"),
    ).where("invoice IS NOT NULL")
    with temporary() as own:
        lines = save(lines)
        total = lines.select("invoice").distinct().count()
        least = _least_count(total, min_support) if total else 1
        lines = lines.where("bought")
        often = lines.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        likely = sorted(r["item"] for r in often.select("item").collect())
        kinds = save(_kinds(lines, likely))
        counts = kinds.select(F.explode("items").alias("code"), "n").groupBy("code").agg(F.sum("n").alias("baskets"))
        counts = sorted((-r["baskets"], r["code"]) for r in counts.where(F.col("baskets") >= least).collect())
        kept = [code for _, code in counts][: item_limit or None]
        code = dict(zip(kept, range(len(kept)), strict=True))
        if kept:
            new = F.array(*[F.lit(code.get(k)).cast("int") for k in range(len(likely))])
            items = F.filter(F.transform("items", lambda c: F.element_at(new, c + 1)), lambda c: c.isNotNull())
            kinds = kinds.select(F.array_sort(items).alias("items"), "n").where(F.size("items") > 0)
            # baskets may be equal but for items that are left out
            kinds = kinds.groupBy("items").agg(F.sum("n").alias("n"))
        kinds = own.hand_over(kinds if kept else kinds.limit(0))
    return Baskets(kinds, [likely[code] for code in kept], total, least)


def _kinds(lines: DataFrame, likely: list[str]) -> DataFrame:
    """(items, n): the sets of codes (places in ``likely``) that baskets hold, and how many baskets hold just that set."""
    codes = lines.sparkSession.createDataFrame(list(enumerate(likely)), "code int, item string")
    coded = lines.join(F.broadcast(codes), "item").select("invoice", "code")
    if len(likely) > MASKED:
        gathered = coded.distinct().groupBy("invoice").agg(F.array_sort(F.collect_list("code")).alias("items"))
        return gathered.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    words = [f"_w{k}" for k in range(-(-len(likely) // WORD) or 1)]
    bit = F.expr(f"shiftleft(1L, code % {WORD})")
    inside = [F.when(F.floor(F.col("code") / WORD) == k, bit).otherwise(F.lit(0)) for k in range(len(words))]
    masks = coded.groupBy("invoice").agg(*[F.bit_or(i).alias(w) for i, w in zip(inside, words, strict=True)])
    masks = masks.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    held = [f"transform(filter(sequence(0, {WORD - 1}), c -> (shiftright({w}, c) & 1) = 1), c -> c + {k * WORD})" for k, w in enumerate(words)]
    return masks.select(F.concat(*[F.expr(h) for h in held]).alias("items"), "n")


def _coded_itemsets(baskets: Baskets) -> DataFrame:
    """Saved (codes, freq) of every frequent itemset, codes ascending."""
    if baskets.mined is None:
        baskets.mined = _mine(baskets)
    return baskets.mined


def _mine(baskets: Baskets) -> DataFrame:
    if not baskets.names:
        return baskets.kinds.sparkSession.createDataFrame([], "codes array<int>, freq long")
    with temporary() as own:
        kinds = baskets.kinds
        singles = kinds.select(F.explode("items").alias("code"), "n").groupBy("code").agg(F.sum("n").alias("freq"))
        singles = singles.where(F.col("freq") >= baskets.least).select(F.array("code").alias("codes"), "freq")
        # an item that is in no frequent pair is in no larger set, so the miner need not see it
        twos = kinds.select("items", "n", F.explode("items").alias("a"))
        twos = twos.select("a", "n", F.explode(F.filter("items", lambda x: x > F.col("a"))).alias("b"))
        twos = save(twos.groupBy("a", "b").agg(F.sum("n").alias("freq")).where(F.col("freq") >= baskets.least))
        paired = sorted({r["code"] for r in twos.select(F.explode(F.array("a", "b")).alias("code")).distinct().collect()})
        if not paired:
            return own.hand_over(singles)
        taking = F.array(*[F.lit(c) for c in paired])
        kinds = save(kinds.select(F.array_intersect("items", taking).alias("items"), "n").where(F.size("items") > 1))
        filled = kinds.agg(F.sum("n")).first()[0]
        rows = _each(kinds)
        # the miner rounds its threshold up from a share of the rows it sees
        share = (baskets.least - 0.5) / filled
        # few items to divide the work by, so more tasks than cores gain nothing
        parts = min(shuffle_width(kinds), kinds.sparkSession.sparkContext.defaultParallelism)
        miner = FPGrowth(itemsCol="items", minSupport=min(1.0, share), numPartitions=parts)
        found = miner.fit(rows).freqItemsets.where(F.size("items") > 1)
        found = found.select(F.array_sort("items").alias("codes"), F.col("freq").cast("long"))
        return own.hand_over(singles.unionByName(found))


def _named(codes, names: list[str]):
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(""))
    return F.array_sort(F.transform(codes, lambda c: F.element_at(listed, c + 1)))


def frequent_itemsets(baskets: Baskets) -> DataFrame:
    """(items, freq, support) of every itemset of any size at or above the minimum support."""
    return _coded_itemsets(baskets).select(
        _named(F.col("codes"), baskets.names).alias("items"),
        "freq",
        (F.col("freq") / F.lit(float(max(1, baskets.total)))).alias("support"),
    )


def association_rules(baskets: Baskets, min_lift: float = MIN_LIFT) -> DataFrame:
    """Every split of every frequent itemset into antecedent and consequent, by lift.

    Both sides of a split are frequent themselves, so their supports come from equi-joins.
    """
    sets = _coded_itemsets(baskets).withColumn("support", F.col("freq") / F.lit(float(max(1, baskets.total))))
    # a split is a choice for the first half of a set's items and one for the rest, so no array is longer than the
    # square root of the number of splits
    half = "floor(size(codes) / 2)"
    splits = sets.where(F.size("codes") >= 2).select(
        "codes", "support", F.expr(f"explode(sequence(0L, shiftleft(1L, cast({half} AS int)) - 1))").alias("low")
    )
    splits = splits.select(
        "codes", "support", "low", F.expr(f"explode(sequence(0L, shiftleft(1L, cast(size(codes) - {half} AS int)) - 1))").alias("high")
    ).select("codes", "support", F.expr(f"low + shiftleft(high, cast({half} AS int))").alias("mask"))
    splits = splits.where(F.expr("mask > 0 AND mask < shiftleft(1L, size(codes)) - 1")).select(
        "support",
        F.expr("filter(codes, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("a"),
        F.expr("filter(codes, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("c"),
    )
    rules = splits.join(sets.select(F.col("codes").alias("a"), F.col("support").alias("sa")), "a").join(
        sets.select(F.col("codes").alias("c"), F.col("support").alias("sc")), "c"
    )
    confidence = F.col("support") / F.col("sa")
    return rules.select(
        _named(F.col("a"), baskets.names).alias("antecedents"),
        _named(F.col("c"), baskets.names).alias("consequents"),
        "support",
        confidence.alias("confidence"),
        (confidence / F.col("sc")).alias("lift"),
    ).where(F.col("lift") >= min_lift)


def top_rules(rules: DataFrame, top_n: int = 5) -> DataFrame:
    """Twice ``top_n`` rules of highest lift, formatted for display."""
    named = rules.select(
        F.array_join("antecedents", ", ").alias("if_bought"),
        F.array_join("consequents", ", ").alias("recommended"),
        F.bround(F.col("confidence") * 100, 1).alias("confidence"),
        F.bround("lift", 2).alias("lift"),
        F.col("lift").alias("_lift"),
        F.col("confidence").alias("_confidence"),
    )
    top = named.orderBy(F.desc("_lift"), F.desc("_confidence"), "if_bought", "recommended").limit(2 * top_n)
    return top.drop("_lift", "_confidence")
