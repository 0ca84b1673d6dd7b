import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import values
from pyspark.sql import functions as F

from tillwise.operators import baskets as b
from tillwise.operators import neighbours as n
from tillwise.operators.popularity import popular_items
from tillwise.operators.recommend import recommend
from tillwise.plans import space


@pytest.fixture(scope="module")
def lines(spark):
    bought = ["ab", "abc", "ac", "b", "abd", "cd", "a", "bc"]
    rows = [(f"i{k}", item, 1) for k, items in enumerate(bought) for item in items]
    rows += [("i0", " a ", 2), ("empty", "a", None), ("empty", "b", None), (None, "a", 1)]
    return spark.createDataFrame(rows, "inv string, item string, qty int")


def expected_sets(least):
    bought = ["ab", "abc", "ac", "b", "abd", "cd", "a", "bc", ""]
    counts = {}
    for items in bought:
        for size in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), size):
                counts[part] = counts.get(part, 0) + 1
    return {k: v for k, v in counts.items() if v / len(bought) >= least}, len(bought)


@pytest.mark.parametrize("support", [0.1, 0.2, 0.34])
def test_itemsets_and_rules_match_enumeration(lines, support):
    baskets = b.build_baskets(lines, "inv", "item", "qty", min_support=support)
    want, total = expected_sets(support)
    assert baskets.total == total
    got = {tuple(r["items"]): r["freq"] for r in b.frequent_itemsets(baskets).collect()}
    assert got == want
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in b.association_rules(baskets).collect()}
    share = {k: v / total for k, v in want.items()}
    expected = {}
    for whole in want:
        for size in range(1, len(whole)):
            for a in itertools.combinations(whole, size):
                c = tuple(x for x in whole if x not in a)
                lift = share[whole] / share[a] / share[c]
                if lift >= 1.0:
                    expected[(a, c)] = (share[whole] / share[a], lift)
    assert rules.keys() == expected.keys()
    for key, (confidence, lift) in expected.items():
        assert (rules[key]["confidence"], rules[key]["lift"]) == pytest.approx((confidence, lift))


def test_item_limit_keeps_emptied_baskets(lines):
    baskets = b.build_baskets(lines, "inv", "item", "qty", item_limit=2)
    assert baskets.total == 9 and baskets.names == ["a", "b"]
    assert baskets.rows.count() == 7


def test_one_invoice_holding_a_third_of_all_rows(spark):
    rows = [("big", f"p{i}", 1) for i in range(300)] + [(f"i{i}", f"p{i % 7}", 1) for i in range(600)]
    baskets = b.build_baskets(spark.createDataFrame(rows, "inv string, item string, qty int"), "inv", "item")
    assert baskets.total == 601
    assert {tuple(r["items"]) for r in b.frequent_itemsets(baskets).collect()} == {(f"p{i}",) for i in range(7)}


def test_top_rules_are_formatted(lines):
    rules = b.top_rules(b.association_rules(b.build_baskets(lines, "inv", "item", "qty", 0.1)), top_n=1).collect()
    assert len(rules) == 2 and set(rules[0].asDict()) == {"if_bought", "recommended", "confidence", "lift"}


def test_popularity(lines):
    assert [tuple(r) for r in popular_items(lines, "item", "qty", 2).collect()] == [("a", 8), ("b", 5)]
    assert [tuple(r) for r in popular_items(lines, "item", None, 2).collect()] == [("a", 8), ("b", 6)]


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(6)
    rows = [
        (f"u{u:02d}", f"p{i:02d}", float(rng.integers(-1, 5)))
        for u in range(40) for i in range(25) if rng.random() < 0.25
    ]
    rows += [("u90", "only", 3.0), ("u91", "p01", 0.0), ("u92", "p01", None), (None, "p02", 5.0), ("u93", " p02 ", 2.0)]
    return spark.createDataFrame(rows, "who string, item string, qty double")


def matrix(ratings):
    frame = ratings.toPandas().dropna(subset=["who"])
    frame["item"] = frame["item"].str.strip()
    return frame.pivot_table(index="who", columns="item", values="qty", aggfunc="sum", fill_value=0, dropna=False).fillna(0)


def cosine(m, user):
    norms = np.sqrt((m**2).sum(axis=1))
    dots = m.to_numpy() @ m.loc[user].to_numpy()
    scale = norms * norms[user]
    return pd.Series(np.divide(dots, scale, out=np.zeros(len(m)), where=scale.to_numpy() > 0), index=m.index)


@pytest.mark.parametrize("targets", [None, ["u90", "u91", "u92", "u93", "u05"]])
def test_neighbours_and_candidates_match_the_dense_matrix(ratings, targets):
    m = matrix(ratings)
    weights = n.save(
        n.user_item_weights(ratings, "who", "item", "qty")
    )
    named = targets and weights.sparkSession.createDataFrame([(t,) for t in targets], "u string")
    near = n.similar_users(weights, named)
    users = targets or sorted(m.index)
    found = {}
    for row in near.orderBy("user", "place").collect():
        found.setdefault(row["user"], []).append((row["neighbour"], row["similarity"]))
    assert sorted(found) == sorted(users)
    offered = n.candidate_items(weights, near, top_n=4)
    items = {u: [] for u in users}
    for row in offered.orderBy("user", "place").collect():
        items[row["user"]].append(row["item"])
    for user in users:
        similarity = cosine(m, user).drop(user).round(12)
        order = sorted(similarity.index, key=lambda u: (-similarity[u], u))[:5]
        assert [u for u, _ in found[user]] == order
        assert [s for _, s in found[user]] == pytest.approx(list(similarity[order]), abs=1e-9)
        total = m.loc[order].sum()
        fresh = [i for i in m.columns if total[i] > 0 and not m.loc[user, i] > 0]
        assert items[user] == sorted(fresh, key=lambda i: (-total[i], i))[:4]
        assert not any(m.loc[user, i] > 0 for i in items[user])


def test_users_with_zero_weights_among_many_targets(spark):
    rows = [(f"u{i:04d}", f"i{i % 7}", float(i % 5)) for i in range(1200)] + [("zero", "i1", 0.0), ("alone", "own", 1.0)]
    rows += [(f"u{i:04d}", "i0", -1.0) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "u string, i string, q double")
    weights = n.save(n.user_item_weights(df, "u", "i", "q"))
    near = n.similar_users(weights).collect()
    m = df.toPandas().pivot_table(index="u", columns="i", values="q", aggfunc="sum", fill_value=0)
    assert len(near) == 5 * len(m)
    lists = {}
    for r in sorted(near, key=lambda r: r["place"]):
        lists.setdefault(r["user"], []).append(r["neighbour"])
    for user in ("zero", "alone", "u0000", "u0035", "u0007"):
        similarity = cosine(m, user).drop(user).round(12)
        assert lists[user] == sorted(similarity.index, key=lambda u: (-similarity[u], u))[:5]


def test_users_without_news_get_best_sellers(spark):
    rows = [(u, i, 1.0) for u in ("a", "b", "c") for i in ("x", "y")] + [("a", "z", 9.0)]
    served = n.recommend_to_users(spark.createDataFrame(rows, "u string, i string, q double"), "u", "i", "q", top_n=2)
    assert values(served, "user", "place", "item", "source") == [
        ("a", 1, "z", "best sellers"), ("a", 2, "x", "best sellers"),
        ("b", 1, "z", "similar customers"), ("c", 1, "z", "similar customers"),
    ]


def test_method_follows_the_columns(lines, ratings):
    chosen = recommend(lines, "item", invoice_col="inv", qty_col="qty")
    assert chosen.algorithm_code == "apriori" and chosen.user_recommendations is None
    assert recommend(ratings, "item", user_col="who", qty_col="qty").algorithm_code == "collaborative"
    assert recommend(lines, "item").algorithm_used == "Popularity-Based Engine (Top Sellers)"
    with pytest.raises(ValueError, match="item column"):
        recommend(lines, "nope")


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_blocks_lose_no_neighbour(spark, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK_USERS", block)
    monkeypatch.setattr(n, "VISITORS", 7)
    monkeypatch.setattr(n, "CELLS", 64)
    rng = random.Random(block)
    rows = []
    for u in range(100):
        held = set(rng.choices(range(50), [1 / (j + 1) for j in range(50)], k=rng.randrange(1, 9)))
        rows += [(u, f"i{i}", float(rng.choice([1, 1, 2, 3, 5, 0, -1]))) for i in held]
    # a crowd of equal users, one that is like nobody, one without any weight
    rows += [(200 + k, "i0", 2.0) for k in range(12)] + [(300, "lone", 1.0), (301, "zero", 0.0)]
    held = {}
    for u, i, w in rows:
        held.setdefault(u, {})[i] = w
    norm = {u: sum(w * w for w in h.values()) ** 0.5 for u, h in held.items()}
    want = set()
    for t in held:
        by = []
        for u in held.keys() - {t}:
            scale = norm[t] * norm[u]
            by.append((-(sum(w * held[u].get(i, 0.0) for i, w in held[t].items()) / scale if scale else 0.0) + 0.0, u))
        want |= {(t, u, round(-x, 9) + 0.0, k) for k, (x, u) in enumerate(sorted(by)[:5], 1)}
    df = spark.createDataFrame(rows, "user long, item string, weight double")
    got = {(r["user"], r["neighbour"], round(r["similarity"], 9) + 0.0, r["place"]) for r in n.similar_users(df).collect()}
    assert got == want


def test_popular_items_do_not_lead_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_USERS", 32)
    # sixteen circles of users with items of their own, and one item that everybody buys a little of
    rows = [(u, f"c{u % 16}_{(u // 16 + k) % 5}", 5.0) for u in range(1024) for k in range(3)] + [(u, "all", 1.0) for u in range(1024)]
    weights = spark.createDataFrame(rows, "user long, item string, weight double")
    norms = weights.groupBy("user").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    targets = weights.select(F.col("user").alias("target")).distinct()
    found, visits = n.positive_neighbours(weights, norms, targets, 5)
    assert found.count() == 1024 * 5 and found.agg(F.min("similarity")).first()[0] > 0.9
    # of 32 blocks a user visits a few besides its own
    assert visits.count() < 4 * 1024


@pytest.mark.parametrize("items", [6, 60])
def test_products_of_all_tiles_give_the_same_neighbours(spark, monkeypatch, items):
    monkeypatch.setattr(n, "REACH", 0)
    for name, value in {"TILE": 16, "STRIP": 5, "CELLS": 64, "HELD_WEIGHTS": 40}.items():
        monkeypatch.setattr(n, name, value)
    rng = random.Random(items)
    rows = [
        (f"u{u:03d}", f"i{i}", float(rng.choice([1, 1, 2, 3, 5, 0, -1] if u % 2 else [1, 2, 3])))
        for u in range(120) for i in rng.sample(range(items), rng.randrange(1, 6))
    ]
    # a crowd of equal users, more than there are neighbours
    rows += [(f"v{k:02d}", "i0", 2.0) for k in range(12)] + [("lone", "lone", 1.0), ("zero", "zero", 0.0)]
    df = spark.createDataFrame(rows, "user string, item string, weight double")
    m = df.toPandas().pivot_table(index="user", columns="item", values="weight", aggfunc="sum", fill_value=0)
    for targets in (None, ["u001", "u064", "v03", "v11", "lone", "zero"]):
        named = targets and spark.createDataFrame([(t,) for t in targets], "u string")
        lists = {}
        for r in n.similar_users(df, named).orderBy("user", "place").collect():
            lists.setdefault(r["user"], []).append((r["neighbour"], round(r["similarity"], 9) + 0.0))
        assert sorted(lists) == sorted(targets or m.index)
        for user in lists:
            similarity = cosine(m, user).drop(user) + 0.0
            order = sorted(similarity.index, key=lambda u: (-similarity[u], u))[:5]
            assert lists[user] == [(u, round(similarity[u], 9) + 0.0) for u in order]


def test_customers_who_all_buy_the_same_items_visit_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_USERS", 16)
    rng = random.Random(3)
    rows = [(u, f"i{i}", float(rng.randrange(1, 50))) for u in range(600) for i in rng.sample(range(12), 6)]
    weights = spark.createDataFrame(rows, "user long, item string, weight double")
    norms = weights.groupBy("user").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    targets = weights.select(F.col("user").alias("target")).distinct()
    found, visits = n.positive_neighbours(weights, norms, targets, 5)
    assert found.count() == 600 * 5 and visits.count() < 8 * 600


def test_the_miner_sees_only_items_of_frequent_pairs(spark, monkeypatch):
    rows = [(k, i) for k in range(60) for i in ("a", f"s{k % 20}")]
    df = spark.createDataFrame(rows, "inv long, item string")

    def unused(*args, **options):
        raise AssertionError("no pair is frequent")

    with monkeypatch.context() as m:
        m.setattr(b, "FPGrowth", unused)
        found = b.frequent_itemsets(b.build_baskets(df, "inv", "item", min_support=0.051))
        assert values(found, "items", "freq") == [(["a"], 60)]
    more = df.unionByName(spark.createDataFrame([(k, "z") for k in range(0, 60, 4)], "inv long, item string"))
    found = b.frequent_itemsets(b.build_baskets(more, "inv", "item", min_support=0.051))
    assert values(found, "items", "freq") == [(["a"], 60), (["a", "z"], 15), (["z"], 15)]


@pytest.mark.parametrize("masked", [1024, 50])
def test_equal_baskets_are_one_row_in_any_form(spark, monkeypatch, masked):
    monkeypatch.setattr(b, "MASKED", masked)
    # more items than a word has bits, the first of them also in one basket that holds all; "rare" has rows enough but not baskets
    rows = [(k, f"p{k % 130:03d}") for k in range(1300)] + [(k, "p000") for k in range(1300)] + [(9999, f"p{k:03d}") for k in range(130)]
    rows += [(5, "rare")] * 40
    found = b.build_baskets(spark.createDataFrame(rows, "inv long, item string"), "inv", "item", min_support=11 / 1301)
    assert found.total == 1301 and found.names == [f"p{k:03d}" for k in range(130)]
    assert found.kinds.count() == 131 and found.rows.count() == 1301
    sets = {tuple(r["items"]): r["freq"] for r in b.frequent_itemsets(found).collect()}
    want = {("p000",): 1301} | {(f"p{k:03d}",): 11 for k in range(1, 130)} | {("p000", f"p{k:03d}"): 11 for k in range(1, 130)}
    assert sets == want


def test_choice_reads_best_sellers_once(spark, ratings, monkeypatch):
    def unused(*args):
        raise AssertionError("best sellers are known")

    monkeypatch.setattr(n, "popular_items", unused)
    chosen = recommend(ratings, "item", user_col="who", qty_col="qty")
    assert chosen.algorithm_code == "collaborative" and chosen.user_recommendations.count() > 0
    assert [tuple(r) for r in chosen.popular_items.collect()] == [tuple(r) for r in popular_items(ratings, "item", "qty").collect()]


def test_first_users_add_up_no_weights(ratings):
    first = n.first_users(n.user_item_weights(ratings, "who", "item", "qty"), 3)
    assert [r["user"] for r in first.collect()] == ["u00", "u01", "u02"]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "item" not in plan.split("Aggregate", 1)[1].split("Project")[0] and plan.count("Aggregate") == 1


@pytest.mark.parametrize("items", [2, 5])
def test_boxes_of_points_lose_no_neighbour(spark, monkeypatch, items):
    for name, value in {"REACH": 0, "POINTS": 1, "TILE": 16, "VISITORS": 7, "STRIP": 5, "CELLS": 64}.items():
        monkeypatch.setattr(n, name, value)
    monkeypatch.setattr(space, "LEAF_POINTS", 12)
    monkeypatch.setattr(n, "_products", None)
    rng = random.Random(items)
    rows = [
        (f"u{u:03d}", f"i{i}", float(rng.choice([1, 2, 3, 5, 0, -1, 0.37])) * (1 if u % 3 else rng.random()))
        for u in range(300) for i in rng.sample(range(items), rng.randrange(1, items + 1))
    ]
    # a crowd of equal users, one of users with a single item, users without weight
    rows += [(f"v{k:02d}", i, 2.0) for k in range(12) for i in ("i0", "i1")] + [(f"s{k:02d}", "i1", k + 0.3) for k in range(40)]
    rows += [("zero", "i1", 0.0), ("minus", "i0", -4.0), ("minus", "i1", -4.0)]
    df = spark.createDataFrame(rows, "user string, item string, weight double")
    m = df.toPandas().pivot_table(index="user", columns="item", values="weight", aggfunc="sum", fill_value=0)
    for targets in (None, ["u001", "u150", "v03", "v11", "s07", "minus", "zero"]):
        named = targets and spark.createDataFrame([(t,) for t in targets], "u string")
        lists = {}
        for r in n.similar_users(df, named).orderBy("user", "place").collect():
            lists.setdefault(r["user"], []).append((r["neighbour"], r["similarity"]))
        assert sorted(lists) == sorted(targets or m.index)
        for user in lists:
            similarity = cosine(m, user).drop(user)
            assert [s for _, s in lists[user]] == pytest.approx(sorted(similarity, reverse=True)[:5], abs=1e-12)
            assert [s for _, s in lists[user]] == pytest.approx([similarity[u] for u, _ in lists[user]], abs=1e-12)
        # users of that item alone are all at exactly one, so the smaller keys come first
        same = sorted(m.index[(m["i1"] > 0) & (m.drop(columns="i1") == 0).all(axis=1)].drop("s07"))
        assert [u for u, _ in lists["s07"]] == same[:5]


def test_points_visit_few_boxes(spark, monkeypatch):
    monkeypatch.setattr(n, "POINTS", 1)
    monkeypatch.setattr(space, "LEAF_POINTS", 64)
    visits = {}
    for users in (2000, 8000):
        rng = np.random.default_rng(users)
        rows = [(u, f"i{i}", float(w)) for u, five in enumerate(rng.uniform(1, 500, (users, 5))) for i, w in enumerate(five)]
        weights = n.save(spark.createDataFrame(pd.DataFrame(rows, columns=["user", "item", "weight"])))
        norms = weights.groupBy("user").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        targets = weights.select(F.col("user").alias("target")).distinct()
        found, reached = n.positive_neighbours(weights, norms, targets, 5)
        assert found.count() == 5 * users
        visits[users] = reached.count() / users
    # four times the users and boxes, about as many visits of each user; all boxes would be 31 and 125
    assert visits[8000] < 1.5 * visits[2000] < 1.5 * 20


def test_serving_all_reads_the_lines_once(spark, ratings):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    lines = ratings.mapInPandas(counted, ratings.schema)
    served = n.recommend_to_users(lines, "who", "item", "qty").collect()
    assert len(served) >= 5 * 44 - 10 and rows.value == ratings.count()


def test_popular_items_are_not_placed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_USERS", 1)
    monkeypatch.setattr(n, "_placed", None)
    rng = random.Random(11)
    rows = [(u, f"i{i}", float(rng.randrange(1, 50))) for u in range(200) for i in rng.sample(range(12), 6)] + [(500, "rare", 1.0)]
    near = n.similar_users(spark.createDataFrame(rows, "user long, item string, weight double"))
    lists = {}
    for r in near.orderBy("user", "place").collect():
        lists.setdefault(r["user"], []).append((r["neighbour"], round(r["similarity"], 9), r["place"]))
    m = pd.DataFrame(rows, columns=["u", "i", "w"]).pivot_table(index="u", columns="i", values="w", fill_value=0)
    assert sorted(lists) == sorted(m.index)
    for user in lists:
        similarity = cosine(m, user).drop(user)
        order = sorted(similarity.index, key=lambda u: (-similarity[u], u))[:5]
        assert lists[user] == [(u, round(similarity[u], 9), k) for k, u in enumerate(order, 1)]


def test_rows_reached_are_bounded_from_below(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_USERS", 4)
    # 100 targets, 5 of them with an item that needs one block; any other asks for an item of 25 blocks
    buyers = spark.createDataFrame([("all", 100), ("most", 96), ("rare", 2), ("few", 3)], "item string, buyers long")
    assert 95 * 16 <= n._rows_reached_at_least(buyers, 100) <= 95 * 24 + 5
    assert n._rows_reached_at_least(buyers.limit(0), 0) == 0


def test_users_without_weights_compare_with_nobody(spark, monkeypatch):
    monkeypatch.setattr(n, "REACH", 0)
    monkeypatch.setattr(n, "_similarities", None)
    rows = [(u, f"i{(u + k) % 12}", float(k + 1)) for u in range(40) for k in range(4)] + [(7000, "i1", 0.0), (7001, "lone", 2.0)]
    near = n.similar_users(spark.createDataFrame(rows, "user long, item string, weight double"))
    assert near.count() == 5 * 42
    for user in (7000, 7001):
        listed = near.where(F.col("user") == user).orderBy("place").collect()
        assert [(r["neighbour"], r["similarity"], r["place"]) for r in listed] == [(k, 0.0, k + 1) for k in range(5)]


@pytest.mark.parametrize("items", [10, 100_000])
def test_candidates_are_added_up_without_a_row_per_pair_and_item(spark, items):
    rng = np.random.default_rng(items)
    rows = [(f"u{u:03d}", f"p{i:06d}", float(w)) for u in range(90) for i, w in zip(rng.integers(0, items, 9), rng.integers(-1, 6, 9))]
    weights = spark.createDataFrame(rows, "u string, i string, q double").groupBy("u", "i").agg(F.sum("q").alias("q")).toDF("user", "item", "weight")
    weights = n.save(weights)
    users = [f"u{u:03d}" for u in range(90)]
    chosen = {u: [v for v in rng.choice(users, 6, replace=False) if v != u][:5] for u in users}
    pairs = [(u, str(v), 0.5, k) for u, some in chosen.items() for k, v in enumerate(some, 1)]
    offered = n.candidate_items(weights, spark.createDataFrame(pairs, "user string, neighbour string, similarity double, place int"), 3)
    assert "Generate" not in offered._jdf.queryExecution().toString()
    held = weights.toPandas().groupby("user")[["item", "weight"]].apply(lambda g: dict(zip(g["item"], g["weight"]))).to_dict()
    got = {u: [] for u in users}
    for r in offered.orderBy("user", "place").collect():
        got[r["user"]].append((r["item"], r["score"], r["place"]))
    for u in users:
        total = {}
        for v in chosen[u]:
            for i, w in held[str(v)].items():
                total[i] = total.get(i, 0) + w
        fresh = [i for i, s in total.items() if s > 0 and not held[u].get(i, 0) > 0]
        best = sorted(fresh, key=lambda i: (-total[i], i))[:3]
        assert got[u] == [(i, total[i], k) for k, i in enumerate(best, 1)]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_of_a_key_stay_together_whatever_the_batches(size):
    keys = ["a", "a", "a", "b", "c", "c", "c", "c", "c", "d"]
    rows = pa.RecordBatch.from_pydict({"key": keys, "row": list(range(10))})
    runs = list(n._in_runs(iter([rows.slice(at, size) for at in range(0, 10, size)]), "key"))
    assert [r for batch, _ in runs for r in batch.column("row").to_pylist()] == list(range(10))
    assert [batch.column("key")[int(s)].as_py() for batch, starts in runs for s in starts] == ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    ("numbers", "width"),
    [([1, 2, 255], 1), ([1, 256], 2), ([1, 1 << 20], 4), ([1, 1 << 40], 8), ([-1, 3], 8), ([0.5, 7.0], 4), ([0.1, 7.0], 8), ([1e300], 8)],
)
def test_numbers_of_a_tile_travel_as_bytes_of_the_narrowest_type(numbers, width):
    packed = n._bytes(np.array(numbers))
    assert len(packed) == 1 + width * len(numbers)
    back = n._numbers(pa.array([b"other", packed], pa.binary())[1])
    assert back.tolist() == numbers and back.dtype == np.array(numbers).dtype
