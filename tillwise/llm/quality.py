"""Quality rules judged per document and per host.

Every document is measured by a few rules. Failures are added up per host, the hosts' failure rates are shrunk
towards the corpus with a beta prior fitted to all hosts, and a host is rejected with all its documents where its posterior
says, with confidence, that most of its documents fail some rule and far more of them than elsewhere. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import WORD, attach, free_name, whole, windows, words
from tillwise.plans.scratch import save

SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
# a host goes where its rate is over half and over the rate of FACTOR times the corpus odds, CONFIDENCE deviations of the
# posterior below its mean (95 % on one side)
MAJORITY, FACTOR, CONFIDENCE = 0.5, 4.0, 1.645
# bounds of the prior's weight, in documents
WEAKEST, STRONGEST = 1.0, 1000.0


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES of the whole text, all long; a missing text has no words and no lines.

    n_repeat_words counts words inside five-word windows found at least twice in the text. Windows are compared
    by a 64-bit hash within one text. Columns of ``docs`` with these names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    names = {n: free_name(docs, n) for n in ("_w", "_runs", "_sorted", "_starts", "_lines")}
    w, runs, pairs, starts, lines = (F.col(names[n]) for n in names)
    body = whole(col(text))
    out = docs.select(
        *map(col, kept),
        words(col(text)).alias(names["_w"]),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias(names["_lines"]),
        (F.length(body) - F.regexp_count(body, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *map(col, kept), "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        windows(w, F.size(w)).alias(names["_runs"]),
    )
    # only texts with a repeated window sort their windows
    repeats = F.size(F.array_distinct(runs)) < F.size(runs)
    out = out.withColumn(
        names["_sorted"],
        F.when(repeats, F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )

    def found_again(x: Column, k: Column) -> Column:
        before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    out = out.withColumn(names["_starts"], F.sort_array(F.array_compact(F.transform(pairs, found_again))))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"))
    covered = F.aggregate(starts, start, step, lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select(*map(col, kept), *MEASURES)


def failures() -> dict[str, Column]:
    """Which rule a measured document breaks."""
    n = F.col("n_words")
    return {
        "base": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
    }


def host_verdicts(
    measured: DataFrame, host: str, majority: float = MAJORITY, factor: float = FACTOR, confidence: float = CONFIDENCE
) -> DataFrame:
    """Per host: host, n_docs, host_rate (shrunk base failure rate, 6 digits), host_rejected.

    The prior Beta(m s, (1 - m) s) of a rule has the corpus rate m; s follows from the spread of the hosts'
    rates, each by its documents, beyond what their sizes explain, kept between WEAKEST and STRONGEST. Of the posterior, its mean less
    ``confidence`` standard deviations must exceed ``majority`` and the rate whose odds are ``factor`` times those of m, so a
    few failures of a small host do not condemn it. Documents without a host belong to none and take no part.
    """
    failed = failures()
    rules = list(failed)
    hosts = (
        measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(failed[r].cast("long")).alias(r) for r in rules])
    )
    hosts = save(hosts)
    totals = hosts.agg(F.sum("n_docs").alias("n"), *[F.sum(r).alias(r) for r in rules]).first()
    if not totals["n"]:
        return hosts.select("host", "n_docs", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_rejected"))
    mean = {r: totals[r] / totals["n"] for r in rules}
    gap = lambda r: F.pow(F.col(r) / F.col("n_docs") - mean[r], 2) - mean[r] * (1 - mean[r]) / F.col("n_docs")
    spread = hosts.agg(*[(F.sum(F.col("n_docs") * gap(r)) / totals["n"]).alias(r) for r in rules]).first()

    def prior_weight(rule: str) -> float:
        m, v = mean[rule], spread[rule]
        return min(max(m * (1 - m) / v - 1, WEAKEST), STRONGEST) if v > 0 else STRONGEST

    def shrunk(rule: str) -> Column:
        weight = prior_weight(rule)
        return (F.col(rule) + mean[rule] * weight) / (F.col("n_docs") + weight)

    rejected = F.lit(False)
    for rule in rules:
        rate, m = shrunk(rule), mean[rule]
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + prior_weight(rule) + 1))
        rejected = rejected | (rate - confidence * deviation > max(majority, factor * m / (1 - m + factor * m)))
    return hosts.select("host", "n_docs", F.round(shrunk("base"), 6).alias("host_rate"), rejected.alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with MEASURES, base_failed, host_rate, host_rejected and kept.

    A document is kept unless it breaks the base rule (under 10 words, or over 20 % of its words repeated) or its
    host is rejected. No host: judged by its own text alone (host_rate NULL). Missing or empty text: base_failed.
    Repeated rows each count and each come out. An empty table gives an empty result. Columns of the input
    with the names of results are replaced.
    """
    results = {*MEASURES, "base_failed", "host_rate", "host_rejected", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    key = free_name(docs, "_host")
    taken = docs.select(*map(col, keep), col(text).alias("_text_"), col(host).cast("string").alias(key))
    measured = save(measures(taken, "_text_").drop("_text_"))
    verdicts = host_verdicts(measured, key).withColumnRenamed("host", key)
    joined = attach(measured, verdicts, key, "n_docs", list(MEASURES[:-1]))
    base = failures()["base"]
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(
        *map(col, keep), *MEASURES, base.alias("base_failed"), "host_rate", rejected.alias("host_rejected"),
        (~base & ~rejected).alias("kept"),
    )
