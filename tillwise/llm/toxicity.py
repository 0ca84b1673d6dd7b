"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters look for single words (a fixed list and words mined from labelled training rows), for stems (beginnings of several different
words, mined too) and for patterns. How often each fires, and each two together, is counted over all documents. Toxic texts of
different kinds or languages share no voters, so the label model has one toxic class per block of voters that fire together: within
a block the covariances of the votes are a rank-one matrix whose factor gives each voter's accuracy, anchored on the labelled
training rows; what the factor leaves over gives the correlated pairs, whose votes then count less. The posterior labels train a
logistic classifier on the votes and on whether any trusted voter fires.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col
from tillwise.llm.common import fold, in_small_batches, windows, words
from tillwise.plans.scratch import save

# fixed values: common English insults
SEED_WORDS = (
    "stupid", "idiot", "idiots", "moron", "morons", "loser", "losers", "pathetic", "disgusting", "scum", "trash", "clown",
    "worthless", "dumb", "imbecile", "vermin", "filthy", "bastard", "jerk", "fool",
)
WORDS = re.compile(r"[^\W\d_]+")
# labelled training documents that words are mined from, and different texts that the classifier is fitted on, at most
LABELLED, FITTED = 20_000, 20_000
LEAST_SUPPORT, LEAST_ODDS, LEAST_GAIN = 3, 2.5, 25.0
# voters mined at most, of so many candidates at most, the best first (inputs of the classifier; significance leaves far fewer)
MINED, CANDIDATES = 500, 20_000
# lengths of stems; a name that ends in * asks for one word of the stem, ** for two different ones
STEMS = (4, 5, 6)
# labelled rows that the counted accuracies weigh as much as; documents that a labelled row counts as for the classifier
ANCHOR, KNOWN = 20.0, 5.0
# how much likelier a voter must fire on toxic texts to count for the classifier's joint input
TRUSTED = 10.0
# excess correlation from which two voters are held to be dependent
CORRELATED = 0.2
PATTERNS = ("second_person", "shouting", "exclaims")
FLOOR = 1e-4
THRESHOLD = 0.3
SLICE = 1000


def features(low: str) -> set[str]:
    """The words of a text in lower case, and the stems of one or several of them."""
    found = set(WORDS.findall(low))
    stems = Counter(w[:k] for w in found for k in STEMS if len(w) > k)
    return found | {f"{p}*" for p in stems} | {f"{p}**" for p, n in stems.items() if n > 1}


@dataclass
class Voters:
    """Voters for words, stems and patterns; vote() marks those that fire on a text."""

    lexicon: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.lexicon) if not w.endswith("*")}
        self.stems = {w.rstrip("*"): (i, len(w) - len(w.rstrip("*"))) for i, w in enumerate(self.lexicon) if w.endswith("*")}
        self.lengths = sorted({len(p) for p in self.stems})
        self.names = [*self.lexicon, *PATTERNS]
        insult = "|".join(map(re.escape, self.place)) or r"(?!)"
        self.second = re.compile(rf"\b(?:you|this|that|such an?)\s+(?:are\s+|is\s+)?(?:an?\s+)?(?:{insult})\b")

    def vote(self, text: str | None) -> list[int]:
        text = text or ""
        low = text.lower()
        words = set(WORDS.findall(low))
        found = [self.place[w] for w in self.place.keys() & words]
        n = len(self.lexicon)
        if found and self.second.search(low):
            found.append(n)
        if self.stems:
            begun = Counter(p for k in self.lengths for w in words if (p := w[:k]) in self.stems and len(w) > k)
            found += [self.stems[p][0] for p, c in begun.items() if c >= self.stems[p][1]]
        letters = len(text)
        if letters >= 20 and sum(map(str.isupper, text)) * 2 > letters:
            found.append(n + 1)
        if text.count("!") * 100 > letters > 0:
            found.append(n + 2)
        return found

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)), np.float32)
        for i, text in enumerate(texts):
            out[i, self.vote(text)] = 1
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, bound: int) -> DataFrame:
    """text, toxic of at most ``bound`` labelled training rows, the first by hash of doc_id.

    Training rows are those whose crc32(doc_id) modulo 4 is not 2. Of several labels of an id the largest counts.
    """
    train = labels.where(col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    ids = train.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("_t_id"), "toxic")
    # the sample's ids are bounded, so the texts are not shuffled
    return docs.join(F.broadcast(ids), col(doc_id).cast("long") == F.col("_t_id")).select(col(text).alias("text"), "toxic")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic) rows: how many toxic and clean ones hold each feature."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(features(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(names, pa.string()), "c1": pa.array([counts[1][w] for w in names], pa.int64()),
            "c0": pa.array([counts[0][w] for w in names], pa.int64()),
        })


def mine_words(sample: DataFrame, most: int = MINED) -> tuple[list[str], float]:
    """Words and stems that mark toxic rows of the sample, best first, and the share of toxic rows.

    Copies count once: of rows whose least five-word shingle is the same, one is taken per label. A word or stem must be in
    LEAST_SUPPORT such toxic rows, LEAST_ODDS times (log) likelier there, with a log-likelihood gain of LEAST_GAIN. Of
    those that begin alike only the best is taken: a stem stands for its words.
    """
    totals = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["toxic"]: r["n"] for r in totals}
    share = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1.0)
    w = sample.select(words(col("text")).alias("w"), F.col("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    runs = windows(F.col("w"), F.size("w"))
    keyed = w.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), "toxic", F.coalesce(F.array_min(runs), F.xxhash64("text")).alias("k"))
    once = save(keyed.groupBy("k", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return [], share
    counted = once.mapInArrow(_feature_counts, "word string, c1 long, c0 long")
    found = counted.groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).where(F.col("c1") >= LEAST_SUPPORT)
    p1, p0, p = (F.col("c1") + 0.1) / (n1 + 0.2), (F.col("c0") + 0.1) / (n0 + 0.2), (F.col("c1") + F.col("c0") + 0.2) / (n1 + n0 + 0.4)
    gain = 2 * (F.col("c1") * F.log(p1 / p) + F.col("c0") * F.log(p0 / p))
    top = found.select("word", "c1", F.log(p1 / p0).alias("odds"), gain.alias("gain")).where(
        (F.col("odds") >= LEAST_ODDS) & (F.col("gain") >= LEAST_GAIN)
    )
    taken: list[str] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for r in top.orderBy(F.col("gain").desc(), "word").limit(CANDIDATES).collect():
        word, base = r["word"], r["word"].rstrip("*")
        if stems & {base[:k] for k in STEMS} or (word != base and base in begun):
            continue
        taken.append(word)
        begun |= {base[:k] for k in STEMS}
        if word != base:
            stems.add(base)
    return taken[:most], share


def _labelled_votes(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [voters.vote(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fired, pa.list_(pa.int32()))], names=["toxic", "fired"])

    return run


def _moments(voters: Voters):
    """One row per task: documents, and the counts of each two voters firing together (flat matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = 0, len(voters.names)
        both = np.zeros((v, v))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                votes = voters.matrix(batch.column(0).slice(at, SLICE).to_pylist())
                n += len(votes)
                both += votes.T @ votes
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([-1, *i.tolist()], pa.int32()), "j": pa.array([-1, *j.tolist()], pa.int32()),
            "n": pa.array([float(n), *both[i, j].tolist()]),
        })

    return run


@dataclass
class LabelModel:
    """Accuracies P(fires | class) and weights of the voters, from how often they fire alone and together."""

    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    block: np.ndarray
    shares: np.ndarray
    correlated: list[tuple[int, int]]

    @classmethod
    def fit(cls, both: np.ndarray, n: float, prior: float, votes: np.ndarray | None = None, labels: np.ndarray | None = None) -> LabelModel:
        """From ``both``, the counts of each two voters firing together on ``n`` documents, and the ``votes`` on labelled rows.

        Without labelled rows each block has the share ``prior`` of all documents.
        """
        v, n = len(both), max(n, 1.0)
        votes = np.zeros((0, v)) if votes is None else votes
        labels = np.zeros(len(votes)) if labels is None else labels
        fires = np.diag(both) / n
        cov = both / n - np.outer(fires, fires)
        spread = np.sqrt(np.maximum(fires * (1 - fires), 1e-12))
        mask = ~np.eye(v, dtype=bool) & (np.diag(both) > 0)[:, None] & (np.diag(both) > 0)[None, :]
        # what chance alone would leave of a covariance
        chance = np.sqrt(np.outer(fires, fires) / n)
        sure = mask & (cov > 4 * chance)
        block = _blocks(sure)
        mask &= block[:, None] == block[None, :]
        factor = np.zeros(v)
        for i in range(v):
            j, k = np.nonzero(np.triu(sure & sure[i][:, None] & sure[i][None, :], 1))
            if len(j):
                # of three independent voters any one's share follows; a low middle value stands correlated pairs
                factor[i] = math.sqrt(np.quantile(cov[i, j] * cov[i, k] / cov[j, k], 0.4))
        # a labelled toxic row is of the block with most votes on it
        count = block.max() + 1 if v else 0
        per_block = votes @ np.eye(count)[block] if v else np.zeros((len(votes), 0))
        kind = np.where((labels > 0) & (per_block.sum(axis=1) > 0), per_block.argmax(axis=1) if count else 0, -1)
        rows = np.bincount(kind[kind >= 0], minlength=count).astype(float)
        shares = (rows + 0.5) / (len(votes) + 1.0) if len(votes) else np.full(count, prior)
        share = np.clip(shares, 1e-4, 0.5)[block] if v else np.zeros(0)
        fired, innocent = np.zeros(v), labels <= 0
        for b in np.flatnonzero(rows):
            fired[block == b] = votes[kind == b][:, block == b].sum(axis=0)
        if len(votes):
            # in a block of one or two voters there are no three to tell the factor by: it follows from the labels
            gap = fired / np.maximum(rows[block], 1) - votes[innocent].mean(axis=0) if innocent.any() else np.zeros(v)
            factor = np.where(factor > 0, factor, np.maximum(gap, 0) * np.sqrt(share * (1 - share)))
        # what the class does not explain is a correlation of the two voters themselves
        rest = np.where(mask, (cov - np.outer(factor, factor)) / np.outer(spread, spread), 0)
        tied = rest >= CORRELATED
        for b in np.flatnonzero(rows >= ANCHOR):
            # labelled rows of the class tell whether two voters agree beyond it
            own = np.flatnonzero(block == b)
            fire = votes[kind == b][:, own]
            apart = fire - fire.mean(axis=0)
            size = np.sqrt(np.maximum((apart * apart).sum(axis=0), 1e-12))
            tied[np.ix_(own, own)] &= apart.T @ apart / np.outer(size, size) >= CORRELATED
        i, j = np.nonzero(np.triu(tied, 1))
        pairs = list(zip(i.tolist(), j.tolist(), strict=True))
        mask[i, j] = mask[j, i] = False
        for _ in range(200):
            square = np.where(mask, factor[None, :] ** 2, 0).sum(axis=1)
            new = np.where(mask, cov * factor[None, :], 0).sum(axis=1) / np.maximum(square, 1e-15)
            factor = 0.5 * factor + 0.5 * np.maximum(new, 0)

        toxic = fires + factor * np.sqrt((1 - share) / share)
        clean = fires - factor * np.sqrt(share / (1 - share))
        toxic, clean = np.clip(toxic, FLOOR, 1 - FLOOR), np.clip(clean, FLOOR, 1 - FLOOR)
        if len(votes):
            toxic = (ANCHOR * toxic + fired) / (ANCHOR + rows[block])
            clean = (ANCHOR * clean + votes[innocent].sum(axis=0)) / (ANCHOR + innocent.sum())
            toxic, clean = np.clip(toxic, FLOOR, 1 - FLOOR), np.clip(clean, FLOOR, 1 - FLOOR)
        # a voter that neither follows its block nor the labels says nothing
        idle = toxic <= clean if len(votes) else (factor <= 0) | (toxic <= clean)
        toxic, clean = np.where(idle, 0.5, toxic), np.where(idle, 0.5, clean)
        shared = np.zeros(v)
        for i, j in pairs:
            shared[i] += 1
            shared[j] += 1
        return cls(toxic, clean, 1 / (1 + shared), block, np.clip(shares, 1e-4, 0.5), pairs)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a row is of any toxic class, one for each block with a voter that says something."""
        yes, no = np.log(self.toxic / self.clean) * self.weight, np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        telling = [b for b in range(len(self.shares)) if (self.toxic[self.block == b] != self.clean[self.block == b]).any()]
        if not telling:
            return np.full(len(votes), self.shares.max() if len(self.shares) else 0.0)
        odds = np.stack([
            math.log(self.shares[b]) + votes[:, self.block == b] @ yes[self.block == b] + (1 - votes[:, self.block == b]) @ no[self.block == b]
            for b in telling
        ])
        innocent = math.log(max(1e-3, 1 - self.shares[telling].sum()))
        total = np.logaddexp.reduce(odds, axis=0) - innocent
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _blocks(linked: np.ndarray) -> np.ndarray:
    """The number of each voter's block: voters that are linked, directly or through others."""
    block, count = np.full(len(linked), -1), 0
    for start in range(len(linked)):
        if block[start] >= 0:
            continue
        block[start], todo = count, [start]
        while todo:
            fresh = np.flatnonzero(linked[todo.pop()] & (block < 0))
            block[fresh] = count
            todo += fresh.tolist()
        count += 1
    return block


def inputs(votes: np.ndarray, labels: LabelModel) -> np.ndarray:
    """The classifier's input: all votes, and whether any voter that the label model trusts fires."""
    trusted = labels.toxic >= TRUSTED * labels.clean
    return np.hstack([votes, (votes[:, trusted] > 0).any(axis=1, keepdims=True)])


def train_linear(votes: np.ndarray, soft: np.ndarray, penalty: float = 1e-4, count: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic weights and bias on soft labels of ``count`` documents each (one by default), by Newton steps; equal vote
    rows are pooled first."""
    count = np.ones(len(votes)) if count is None else count
    rows, where = np.unique(votes, axis=0, return_inverse=True)
    n = np.bincount(where.ravel(), weights=count, minlength=len(rows))
    y = np.bincount(where.ravel(), weights=soft * count, minlength=len(rows)) / n
    x = np.hstack([rows, np.ones((len(rows), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = penalty * n.sum() * np.ones_like(w)
    ridge[-1] = 1e-9 * n.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        fired = inputs(self.voters.matrix(texts), self.labels)
        return 1 / (1 + np.exp(-np.clip(fired @ self.weights + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Voters, label model and classifier. Labels give words and the prior; votes are counted over all of ``docs``."""
    docs = in_small_batches(docs)
    sample = save(labelled_sample(docs, labels, doc_id, text, LABELLED))
    mined, prior = mine_words(sample)
    prior = min(max(prior, 0.005), 0.5)
    voters = Voters(sorted({*SEED_WORDS, *mined}))
    v = len(voters.names)
    # v x v numbers, whatever the number of documents
    sums = docs.select(col(text).cast("string")).mapInArrow(_moments(voters), "i int, j int, n double")
    sums = sums.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((v, v)), 0.0
    for r in sums:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    seen = sample.select("text", "toxic").mapInArrow(_labelled_votes(voters), "toxic int, fired array<int>").collect()
    marked = np.zeros((len(seen), v), np.float32)
    for i, r in enumerate(seen):
        marked[i, r["fired"]] = 1
    model = LabelModel.fit(both, n, prior, marked, np.array([r["toxic"] for r in seen], float))
    votes, copies = _votes(docs, text, voters, FITTED)
    weights, bias = np.zeros(v + 1), math.log(prior / (1 - prior))
    if len(votes) or len(marked):
        # where a label is known it is the posterior
        truth = np.array([r["toxic"] > 0 for r in seen], float)
        every = inputs(np.vstack([votes, marked]), model)
        weights, bias = train_linear(
            every, np.r_[model.posterior(votes), truth], count=np.r_[copies, np.full(len(marked), KNOWN)]
        )
    return Model(voters, model, weights, bias)


def _votes(docs: DataFrame, text: str, voters: Voters, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes on at most ``bound`` different texts, the first by hash, and the number of documents with each.

    Twice the bound's share of all hashes is looked at, so that tasks do not each send as many rows as the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fired = [voters.vote(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fired, pa.list_(pa.int32()))], names=["h", "fired"])

    hashed = docs.select(F.xxhash64(col(text), F.lit("fit")).alias("h"), col(text).cast("string").alias("text"))
    texts = hashed.agg(F.approx_count_distinct("h", 0.05).alias("n")).first()["n"]
    # hashes spread evenly over the 64-bit numbers
    limit = int(-(1 << 63) + min(1.0, 2 * bound / max(texts, 1)) * ((1 << 64) - 1))
    hashed = hashed.where(F.col("h") <= F.lit(min(limit, (1 << 63) - 1)))
    counted = hashed.mapInArrow(run, "h long, fired array<int>").groupBy("h").agg(F.min("fired").alias("fired"), F.count(F.lit(1)).alias("n"))
    picked = counted.orderBy("h").limit(bound).collect()
    out = np.zeros((len(picked), len(voters.names)), np.float32)
    for i, r in enumerate(picked):
        out[i, r["fired"]] = 1
    return out, np.array([r["n"] for r in picked], float)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with score, the probability that the whole text is toxic.

    Missing and empty texts get the score of a text on which no voter fires. A column named score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    taken = docs.select(col(text).cast("string").alias("_text_"), *map(col, keep))
    schema = T.StructType([*taken.drop("_text_").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rest = [part.column(i) for i in range(1, part.num_columns)]
                score = pa.array(model.score(part.column(0).to_pylist()).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*rest, score], names=schema.names)

    return taken.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default) with score and predicted (1 if score >= threshold, else 0).

    Rows without a doc_id are scored but give no label. Repeated rows are scored alike. Without labels the fixed word list
    and a prior of one half vote alone. Empty tables give empty results. Columns named as results are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    result = scored(docs, fit(docs, labels, doc_id, text), text, keep)
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
