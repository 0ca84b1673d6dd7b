"""Spelling variants, exact copies and periodic runs against brute force and on edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import values

from tillwise.llm import exact_dedup, periodic_runs, spelling

LONG = " ".join(f"w{i % 5000}" for i in range(60_000))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(n_of, ratio=10):
    rows = {}
    for w, n in n_of.items():
        met = [v for v in n_of if near(w, v)]
        best = min(met, key=lambda v: (-n_of[v], v), default=None)
        form = best if best is not None and n_of[best] >= ratio * n else None
        rows[w] = [n, len(met), form, n_of.get(form)]
    for w, row in rows.items():
        root = w
        while rows[root][2] is not None:
            root = rows[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in rows.items()}


@pytest.mark.parametrize("letters", [spelling.TILE_LETTERS, 40])
def test_spelling_by_brute_force(spark, letters):
    rng = random.Random(5)
    n_of = {}
    for abc in ("ab", "etaé", "×Ÿ一\U0001f600x", "abcdefghijklmnopqrstuvwxyzà"):
        for _ in range(90):
            n_of["".join(rng.choices(abc, k=rng.randrange(1, 6)))] = 10 ** rng.randrange(0, 7) * rng.choice([1, 1, 2])
    n_of |= {"x" * 3000: 5, "x" * 2999 + "y": 50, "chain": 1, "chains": 10, "chainsa": 100, "chainsab": 1000}
    rows = [(w, n - 1, "form") for w, n in n_of.items()] + [(w, 1, None) for w in n_of]
    table = spark.createDataFrame(rows, "word string, n long, form string")
    out = spelling.spelling_variants(table, letters=letters).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in out} == variants(n_of)
    assert len(out) == len(n_of)
    assert next(r["root"] for r in out if r["word"] == "chain") == "chainsab"


def test_spelling_edges(spark):
    rows = [(None, 4), ("", 9), ("", 1), ("lone", 3), ("word", None), ("tie", 1), ("tia", 10), ("tib", 10)]
    table = spark.createDataFrame(rows, "word string, n int")
    out = {r["word"]: r for r in spelling.spelling_variants(table).collect()}
    assert set(out) == {"lone", "tie", "tia", "tib"} and out["tie"]["form"] == "tia" and out["tia"]["form"] is None
    assert (out["lone"]["n_near"], out["lone"]["root"], out["lone"]["form_n"]) == (0, "lone", None)
    assert spelling.spelling_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(table, ratio=1)


def test_classes_cover_every_move():
    for words in (0, 1, 50_000, 10**6, 10**9, 10**12):
        coarse, fine = spelling.class_numbers(words)
        assert 3 <= coarse <= fine <= 16 and set(spelling.classes_of_bins(fine)) == set(range(fine))
    assert spelling.class_numbers(10**9) > spelling.class_numbers(10**6) > spelling.class_numbers(10**4)


SCHEMA = "doc_id long, text string, keep_id string, kept string, group_size string, row string, id string, digest string, n string, h string, best string"


def copies(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


@pytest.mark.parametrize(("share", "counters"), [(1000, 4000), (4, 8), (2, 3)])
def test_exact_copies_by_brute_force(spark, share, counters):
    rng = random.Random(share)
    rows = [(i, "Huge GROUP") for i in range(200)] + [(1000 + i, f"text {rng.randrange(150)}") for i in range(200)]
    rows += [(2000 + i, "second group") for i in range(90)] + [(3000, "É"), (3001, "é"), (3002, None), (3003, ""), (None, ""), (3004, LONG)]
    rows += [(7, "huge group"), (199, "huge group"), (None, None), (None, "no id at all"), (None, "No id at all")]
    rng.shuffle(rows)
    docs = copies(spark, rows).repartition(7)
    out = exact_dedup.exact_duplicates(docs, share=share, counters=counters).collect()
    assert len(out) == len(rows) and set(docs.columns) <= set(out[0].asDict())
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    stays = collections.Counter()
    for r in out:
        own = groups[lower(r["text"])]
        most = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (most, len(own))
        assert r["text_sha256"] == hashlib.sha256(lower(r["text"]).encode()).hexdigest()
        assert not r["kept"] or r["doc_id"] == most
        stays[r["text_sha256"]] += r["kept"]
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs, share=share, counters=counters)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    assert {(r["doc_id"], lower(r["text"])) for r in kept.collect()} == {(max((i for i in own if i is not None), default=None), t) for t, own in groups.items()}


def test_exact_copies_of_nothing(spark):
    none = copies(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_summaries_miss_no_heavy_hitter(spark):
    rng = np.random.default_rng(1)
    stream = np.r_[rng.integers(0, 1 << 40, 3000), np.repeat([7, 8, 9], [400, 300, 60])]
    rng.shuffle(stream)
    counts = {}
    for part in np.array_split(stream, 50):
        counts = exact_dedup.misra_gries(counts, part, 20)
        assert len(counts) <= 20
    true = collections.Counter(stream.tolist())
    assert all(0 < n <= true[v] for v, n in counts.items())
    assert all(counts.get(v, 0) >= n - len(stream) / 21 for v, n in true.items())
    table = spark.createDataFrame([(str(v),) for v in stream.tolist()], "digest string").repartition(5)
    found = {r["h"] for r in exact_dedup.heavy_hitters(table, share=10, counters=40).collect()}
    heavy = table.where("digest IN ('7')").selectExpr("xxhash64(digest) AS h").first()["h"]
    assert heavy in found and len(found) <= 14


def runs(w):
    out = []
    for q in range(1, len(w)):
        j = q
        while j < len(w):
            at = j
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = at - q, j - at + q
            part = w[start : start + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
            j += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(9)
    texts = []
    for _ in range(1500):
        n, kinds, w = rng.choice([0, 1, 5, 6, 12, 40, 70]), rng.choice([1, 2, 3, 6]), []
        while len(w) < n:
            w += [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
        texts.append(w[:n])
    for w in texts:
        assert list(map(tuple, periodic_runs.find_runs(np.array(w, np.int64)).tolist())) == runs(w)
    # texts behind each other do not mix
    found = list(periodic_runs._looked_at([" ".join(map(str, w)).encode() for w in texts]))
    assert [list(map(tuple, own.tolist())) for _, own in found] == [runs(w) for w in texts]


def test_long_texts_take_no_square(spark):
    same = periodic_runs.find_runs(np.zeros(300_000, np.int64))
    assert same.tolist() == [[0, 300_000, 1]]
    nested = np.tile(np.r_[np.zeros(50), 1, np.zeros(50), 2].astype(np.int64), 1000)
    found = periodic_runs.find_runs(nested)
    assert [102_000, 102] in found[:, 1:].tolist() and (found[:, 2] == 1).sum() == 2000


def test_periodic_runs_table(spark):
    texts = ["a b " * 4 + "c", None, "", " \n ", "x " * 6, "x " * 5, "A a A a A a A a", "one\x0btwo\x1cthree " * 7, LONG, "x " * 6]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in enumerate(texts)], "doc_id long, text string, row string, runs string")
    out = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert len(out) == len(texts) and out[0]["row"] == "r" and out[0]["text"] == texts[0]
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        want = runs(w) if len(w) < 100 else [(0, 60_000, 5000)]
        assert [tuple(r) for r in out[i]["runs"]] == want and out[i]["n_words"] == len(w)
        gone = {k for start, length, q in want for k in range(start + q, start + length)}
        assert out[i]["collapsed"] == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    assert out[0]["collapsed"] == "a b c" and out[4]["collapsed"] == "x" and out[5]["collapsed"] == "x x x x x"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert values(periodic_runs.periodic_runs(docs, keep=[]).where("size(runs) > 0"), "n_words")[0] == (6,)
