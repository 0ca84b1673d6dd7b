"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

URLs with a known label, given as a table or by the rules that fit them, are what trees are boosted on (a bounded sample);
they judge the URLs that no rule fits. Features look at the URL's text only: length, depth, digits, entropy, parameters, and
how often its host's suffix occurs and was blocked. A URL's own host never takes part in its suffix statistics: hosts fall
into folds, and each fold sees the counts of the others, drawn towards the rate of all by a prior. So a suffix whose labels
all agree is evidence that grows with its number of labels, not proof.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import lower_ascii, whole
from tillwise.plans.scratch import save

# (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# labelled URLs the trees are fitted on, at most
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 11
# suffixes are unbounded, so their statistics are kept by hash bucket
BUCKETS = 512
# folds of hosts, and the weight of the rate of all URLs in a suffix's rate, in labels
FOLDS, PRIOR = 5, 20.0
FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "query_length", "secure",
    "suffix_block_rate", "suffix_share", "longest_label", "last_segment",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them; empty without ``://``."""
    after = F.regexp_extract(whole(url), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and a beginning of the path, else NULL."""
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for says, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = rule.when(fits, domain + start), verdict.when(fits, says)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution of characters; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """``urls`` (with host, path) and the FEATURES that need no statistics; all of a missing URL are 0."""
    text = whole(col(url))
    length = F.length(text)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    last = F.element_at(F.split("path", "/"), -1)
    counted = {
        "length": length, "host_length": F.length("host"), "depth": F.regexp_count(F.col("path"), F.lit("/[^/]")),
        "labels": F.size(labels), "digit_ratio": F.regexp_count(text, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
        # a URL's entropy is taken of its host and path, whose length is bounded in practice but not by a cap
        "entropy": entropy(F.concat("host", "path")), "parameters": F.regexp_count(query, F.lit("[^&]+")),
        "hyphens": F.regexp_count(F.col("host"), F.lit("-")), "query_length": F.length(query),
        "secure": text.startswith("https").cast("int"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))), "last_segment": F.length(last),
    }
    suffix = F.pmod(F.xxhash64(F.element_at(labels, -1)), F.lit(BUCKETS)).cast("int")
    return urls.select("*", suffix.alias("_u_suffix"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in counted.items()])


def _suffix_rates(facts: DataFrame) -> tuple[list[list[float]], list[float]]:
    """Block rate by fold and suffix bucket, from the labels of the other folds, and share of URLs by bucket.

    Reads BUCKETS x FOLDS rows, whatever the number of URLs.
    """
    n, labelled, blocked = [0] * BUCKETS, [[0.0] * BUCKETS for _ in range(FOLDS)], [[0.0] * BUCKETS for _ in range(FOLDS)]
    counts = facts.groupBy("_u_suffix", "_u_fold").agg(
        F.count(F.lit(1)).alias("n"), F.count("_u_label").alias("l"), F.coalesce(F.sum("_u_label"), F.lit(0.0)).alias("b")
    )
    for r in counts.collect():
        n[r["_u_suffix"]] += r["n"]
        labelled[r["_u_fold"]][r["_u_suffix"]] = r["l"]
        blocked[r["_u_fold"]][r["_u_suffix"]] = r["b"]
    every, bad, total = sum(map(sum, labelled)), sum(map(sum, blocked)), max(1, sum(n))
    rates = []
    for fold in range(FOLDS):
        l, b = every - sum(labelled[fold]), bad - sum(blocked[fold])
        mean = (b + 0.5) / (l + 1.0)
        others = [(sum(x[i] for x in labelled) - labelled[fold][i], sum(x[i] for x in blocked) - blocked[fold][i]) for i in range(BUCKETS)]
        rates.append([(bi + PRIOR * mean) / (li + PRIOR) for li, bi in others])
    return rates, [x / total for x in n]


def sampled(labelled: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those of lowest hash: a share by hash first, so that no task sorts more than about twice as many."""
    rows = labelled.count()
    space = 1 << 30
    share = F.pmod(key, F.lit(space)) < int(min(1.0, 1.5 * most / max(rows, 1)) * space)
    return labelled.where(share).orderBy(key, "_u_url").limit(most)


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 0.5, sample: int = SAMPLE, labels: DataFrame | None = None, held_out: int | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block; NULL where a rule decides).

    Labels are those of ``labels`` (url, blocked: any URLs, of which those of ``pages`` count as found there; the most frequent
    label of a URL, block on a tie) and, for other URLs, the rules'. A missing URL, or one without ``://``, has empty host
    and path, fits no rule and is judged by the trees. Trees are fitted on at most ``sample`` labelled URLs, the first by hash
    of page_id and URL; with labels of one kind only, that verdict goes to all others, and without any, allow. With
    ``held_out`` the hosts of that fold (of FOLDS) lend no labels, columns label and fold are added and every row gets its
    score: so the trees are measured on hosts they have not seen. Rows pass one by one, so repeated rows and ties come out alike;
    an empty table gives an empty result and other columns are not read.
    """
    host, path = host_and_path(F.col("_u_url"))
    base = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("_u_url"))
    base = base.select("*", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), says.alias("says"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("_u_fold"))
    by_rule = F.when(F.col("says").isNotNull(), (F.col("says") == "block").cast("double"))
    if labels is None:
        known = base.withColumn("_u_label", by_rule)
    else:
        given = labels.where("url IS NOT NULL AND blocked IS NOT NULL").groupBy(F.col("url").cast("string").alias("_u_of"))
        given = given.agg((F.avg(F.col("blocked").cast("double")) >= 0.5).cast("double").alias("_u_given"))
        known = base.join(given, F.col("_u_url") == F.col("_u_of"), "left").withColumn("_u_label", F.coalesce("_u_given", by_rule))
        known = known.drop("_u_of", "_u_given")
    result = ["page_id", "host", "path", "rule"]
    if held_out is not None:
        known = known.withColumn("label", F.col("_u_label")).withColumn("fold", F.col("_u_fold"))
        known = known.withColumn("_u_label", F.when(F.col("_u_fold") != held_out, F.col("_u_label")))
    facts = save(lexical(known, "_u_url"))
    counted = {r["_u_label"]: r["n"] for r in facts.groupBy("_u_label").agg(F.count(F.lit(1)).alias("n")).collect() if r["_u_label"] is not None}
    more = [] if held_out is None else ["label", "fold"]
    if len(counted) < 2:
        only = F.lit("block" if 1.0 in counted else "allow")
        return facts.select(*result, F.coalesce("says", only).alias("verdict"), F.lit(None).cast("double").alias("score"), *more)
    rates, shares = _suffix_rates(facts)
    rate = F.array(*[F.lit(x) for fold in rates for x in fold])
    at = F.col("_u_suffix") + 1
    full = facts.select(
        "*", F.element_at(rate, F.col("_u_fold") * BUCKETS + at).alias("suffix_block_rate"),
        F.element_at(F.array(*map(F.lit, shares)), at).alias("suffix_share"),
    )
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="_u_vector").transform(full)
    first = sampled(full.where("_u_label IS NOT NULL"), F.xxhash64("page_id", "_u_url"), sample)
    fitted = save(first.select(F.col("_u_label").alias("label"), "_u_vector").coalesce(1))
    trees = GBTClassifier(featuresCol="_u_vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)
    model = trees.fit(fitted.coalesce(2))
    model.setRawPredictionCol("_u_raw").setProbabilityCol("_u_p").setPredictionCol("_u_guess")
    score = vector_to_array("_u_p")[1]
    verdict = F.coalesce("says", F.when(score > threshold, "block").otherwise("allow"))
    shown = score if held_out is not None else F.when(F.col("rule").isNull(), score)
    return model.transform(full).select(*result, verdict.alias("verdict"), shown.alias("score"), *more)
