"""Log-bilinear language model: noise-contrastive training in numpy, normalised scores of every text.

Words are counted over all training text. The most frequent ones and a few word-shape classes are the model's symbols.
Counts of (two symbols before, symbol) over all training text are gathered in Spark; numpy learns embeddings of
the symbols and a matrix per context position from them by noise-contrastive estimation. Matrix products over all
contexts at once then give a table of normalised log-probabilities. A frequent word's probability is its symbol's;
any other word's is its class's times its smoothed share of the class, so a text's probabilities are exact over all
words, unseen ones included. Rare words meet their counts in a join; nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col
from tillwise.llm.common import fold, in_small_batches
from tillwise.plans.scratch import save

START, END, CLASSES = 0, 1, 28
SYMBOLS = 128
SHORT = SYMBOLS - 2 - CLASSES
# words whose counts travel with the tasks: at most a fixed number, so a bounded size
HEAD = 1 << 16
FLUSH = 200_000
DIM, NOISE, STEPS, RATE = 24, 12, 400, 0.1
SLICE = 500


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    """Word-shape class: closing punctuation or not, and a bucket of the last two bytes before it."""
    bare = word.rstrip(b".,;:!?\"')|")
    tail = bare[-2:]
    bucket = (tail[0] * 31 + tail[-1] * 7 + len(tail)) % (CLASSES // 2) if tail else 0
    return 2 + SHORT + bucket * 2 + (len(bare) < len(word))


@dataclass
class Head:
    """Counts and symbols of the most frequent training words."""

    counts: dict[bytes, int]
    short: dict[bytes, int]

    def symbols(self, distinct: list[bytes]) -> np.ndarray:
        short = self.short
        return np.fromiter((short.get(w) or shape(w) for w in distinct), np.int64, len(distinct))


def _flat(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code per token, distinct words, words per text)"""
    lists = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.array([w for listed in lists for w in listed], dtype=object)
    if not len(flat):
        return np.empty(0, np.int64), [], sizes
    codes, distinct = pd.factorize(flat)
    return codes, list(distinct), sizes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(list(found), pa.binary()), "c": pa.array(list(found.values()), pa.int64())}
        )

    for part in _slices(batches):
        codes, distinct, _ = _flat(part.column(0).to_pylist())
        for word, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist(), strict=True):
            found[word] = found.get(word, 0) + n
        if len(found) > FLUSH:
            yield out()
            found.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c over the whole texts of the only column."""
    return texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sequences(codes: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with an END after each text, the two before each (START at the front), and each place's text."""
    n = len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    total = int(ends[-1]) + 1 if n else 0
    out = np.full(total, END, np.int64)
    is_word = np.ones(total, bool)
    is_word[ends] = False
    out[is_word] = symbols[codes] if len(codes) else 0
    text = np.repeat(np.arange(n), sizes + 1)
    first = np.full(total, START, np.int64)
    second = np.full(total, START, np.int64)
    first[1:] = np.where(text[1:] == text[:-1], out[:-1], START)
    second[2:] = np.where(text[2:] == text[:-2], out[:-2], START)
    return out, first, second, text


def _triples(head: Head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in _slices(batches):
            codes, distinct, sizes = _flat(part.column(0).to_pylist())
            out, first, second, _ = _sequences(codes, sizes, head.symbols(distinct))
            keys, n = np.unique((second * SYMBOLS + first) * SYMBOLS + out, return_counts=True)
            total[keys] += n
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"triple": pa.array(keys, pa.int64()), "n": pa.array(total[keys], pa.int64())})

    return run


def train(triples: np.ndarray, n: np.ndarray, seed: int = 20240611) -> np.ndarray:
    """log10 P(symbol | two before) for all contexts, from counted triples; START is never predicted.

    Score of symbol w after (u, v): (A r_u + B r_v) . q_w + b_w. Trained to tell counted triples from ones whose last
    symbol is drawn from the symbols' frequencies, NOISE to one, by Adagrad. Each of the STEPS steps takes all counted triples
    and the noise's expectation over all symbols, so nothing is drawn and no triple is left out.
    """
    rng = np.random.default_rng(seed)
    out = triples % SYMBOLS
    freq = np.bincount(out, weights=n, minlength=SYMBOLS) + 0.1
    freq[START] = 0
    freq /= freq.sum()
    every = np.arange(SYMBOLS)
    log_noise = np.log(np.maximum(freq, 1e-30))
    p = {
        "r": rng.normal(0, 0.1, (SYMBOLS, DIM)), "q": rng.normal(0, 0.1, (SYMBOLS, DIM)),
        "A": np.eye(DIM) * 0.5, "B": np.eye(DIM), "b": log_noise.copy(),
    }
    seen = {k: np.full_like(v, 1e-8) for k, v in p.items()}
    if len(n):
        contexts, row = np.unique(triples // SYMBOLS, return_inverse=True)
        u, v = contexts // SYMBOLS, contexts % SYMBOLS
        true = np.bincount(row * SYMBOLS + out, weights=n / n.sum(), minlength=len(u) * SYMBOLS)
        true = true.reshape(len(u), SYMBOLS).astype(np.float32)
        false = NOISE * true.sum(axis=1)[:, None] * freq[None, :].astype(np.float32)
        both = true + false
        is_u, is_v = ((x[:, None] == every).astype(np.float32) for x in (u, v))
        for _ in range(STEPS):
            ru, rv = p["r"][u], p["r"][v]
            h = ru @ p["A"].T + rv @ p["B"].T
            score = (h @ p["q"].T + (p["b"] - log_noise - math.log(NOISE))).astype(np.float32)
            error = both / (1 + np.exp(-np.clip(score, -30, 30))) - true
            dh = error @ p["q"]
            grad = {
                "q": error.T @ h, "b": error.sum(axis=0), "A": dh.T @ ru, "B": dh.T @ rv,
                "r": is_u.T @ (dh @ p["A"]) + is_v.T @ (dh @ p["B"]),
            }
            for k, g in grad.items():
                seen[k] += g * g
                p[k] -= RATE * g / np.sqrt(seen[k])
    left, right = p["r"] @ p["A"].T, p["r"] @ p["B"].T
    table = np.empty((SYMBOLS, SYMBOLS, SYMBOLS), np.float32)
    for u in range(SYMBOLS):
        score = (left[u] + right) @ p["q"].T + p["b"]
        score[:, START] = -np.inf
        top = score.max(axis=1, keepdims=True)
        score -= top + np.log(np.exp(score - top).sum(axis=1, keepdims=True))
        table[u] = score / math.log(10)
    return table.reshape(-1)


# columns made beside the kept ones
SCORED = "_lm_part double, _lm_base double, n_tokens long, _lm_known long, _lm_rare array<struct<word:binary,n:int>>"


def _score(head: Head, table: np.ndarray, class_log: np.ndarray, ends: int, names: list[str]):
    """Per text: parts of both scores that need no join, and its words outside the head with their counts."""
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            codes, distinct, sizes = _flat(part.column(0).to_pylist())
            symbols = head.symbols(distinct)
            counted = np.fromiter((head.counts.get(w, -1) for w in distinct), np.int64, len(distinct))
            out, first, second, text = _sequences(codes, sizes, symbols)
            n = len(sizes)
            model = np.bincount(text, weights=table[(second * SYMBOLS + first) * SYMBOLS + out].astype(np.float64), minlength=n)
            doc = np.repeat(np.arange(n), sizes)
            log_c = np.log10(np.maximum(counted, 0) + 1.0)
            is_class = symbols >= 2 + SHORT
            within = np.where(is_class, log_c - class_log[symbols], 0.0)
            base = np.bincount(doc, weights=log_c[codes], minlength=n) + math.log10(ends + 1)
            model += np.bincount(doc, weights=within[codes], minlength=n)
            known = np.bincount(doc, weights=(counted > 0)[codes], minlength=n).astype(np.int64) + (ends > 0)
            rare_at = np.flatnonzero((counted < 0)[codes])
            keys, times = np.unique(doc[rare_at] * max(len(distinct), 1) + codes[rare_at], return_counts=True)
            owner, which = np.divmod(keys, max(len(distinct), 1))
            offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays(
                [pa.array([distinct[i] for i in which.tolist()], pa.binary()), pa.array(times, pa.int32())], ["word", "n"]
            )
            rare = pa.ListArray.from_arrays(pa.array(offsets), rare).cast(rare_type)
            rest = [part.column(i) for i in range(1, part.num_columns)]
            columns = [*rest, pa.array(model), pa.array(base), pa.array(sizes + 1), pa.array(known), rare]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _class_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = shape(word)
            total[k] = total.get(k, 0) + c + 1
    yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "m": pa.array(list(total.values()), pa.int64())})


def _most_frequent(counts: DataFrame) -> list[Row]:
    """The words down to the frequency from which on there are at most HEAD, most frequent first.

    The frequency is found from the number of words per sixteenth of a doubling, so no task sends more than its part.
    """
    step = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, words = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        words += row["n"]
        if words > HEAD:
            break
        least = row["step"]
    if least is None:
        return []
    return sorted(counts.where(step >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def score(
    docs: DataFrame, training: Column | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (all by default) with n_tokens, n_known, train_tokens, base_score, score of the whole text.

    Learns from the rows where ``training`` holds (all by default). Tokens are words, A-Z lower-cased, then one end.
    base_score is the add-one unigram log10 probability, score the model's; n_known counts tokens seen in training.
    A missing text is empty: its only token is the end. Without training rows the counts are zero and both scores
    fall back to equal shares. Repeated rows count each time. Columns named as results are replaced.
    """
    results = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    training = F.lit(True) if training is None else training
    docs = in_small_batches(docs)
    learned = docs.where(F.coalesce(training, F.lit(False))).select(col(text).cast("string").alias("text"))
    counts = save(word_counts(learned))
    facts = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learned.count()
    n, v = (facts["n"] or 0) + ends, facts["v"] + (ends > 0)
    top = _most_frequent(counts)
    head = Head(
        {bytes(r["word"]): r["c"] for r in top}, {bytes(r["word"]): 2 + i for i, r in enumerate(top[:SHORT])},
    )
    found = learned.mapInArrow(_triples(head), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    # at most SYMBOLS ** 3 rows of two numbers: 32 MB
    found = found.toPandas().sort_values("triple")
    table = train(found["triple"].to_numpy(np.int64), found["n"].to_numpy(np.int64))

    # words of each class outside the shortlist, and one slot for unseen words
    masses = counts.mapInArrow(_class_masses, "k int, m long").groupBy("k").agg(F.sum("m").alias("m")).collect()
    mass = np.ones(SYMBOLS)
    for row in masses:
        mass[row["k"]] += row["m"]
    for word in head.short:
        mass[shape(word)] -= head.counts[word] + 1
    taken = docs.select(col(text).cast("string").alias("_text_"), *map(col, keep))
    fields = T.StructType([*taken.drop("_text_").schema.fields, *T.StructType.fromDDL(SCORED).fields])
    run = _score(head, table, np.log10(mass), ends, fields.names)
    scored = save(taken.mapInArrow(run, fields).withColumn("_lm_uid", F.monotonically_increasing_id()))

    rare = scored.select("_lm_uid", F.explode("_lm_rare").alias("r")).select("_lm_uid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    tail = rare.join(counts, "word").groupBy("_lm_uid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_more"), F.sum("n").alias("_seen")
    )
    more, seen = F.coalesce("_more", F.lit(0.0)), F.coalesce("_seen", F.lit(0))
    return scored.join(tail, "_lm_uid", "left").select(
        *map(col, keep), "n_tokens", (F.col("_lm_known") + seen).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_lm_base") + more - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("_lm_part") + more).alias("score"),
    )


def held_out(doc_id: str = "doc_id", folds: int = 7, remainder: int = 2) -> Column:
    return fold(col(doc_id), folds) == remainder
