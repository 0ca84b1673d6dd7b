import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import history, outliers
from tillwise.plans import lookups, quantiles, scratch, space
from tillwise.plans.ordering import fill_in_order, with_global_rank
from tillwise.plans.quantiles import exact_quantiles


def test_global_rank_is_exact_with_a_third_of_rows_tied(spark):
    rng = random.Random(3)
    rows = [(i, 5 if i % 3 == 0 else rng.randint(0, 9)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r["id"]: r["rank"] for r in with_global_rank(df, ["v", "id"], "rank").collect()}
    want = {i: n for n, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == want


@pytest.mark.parametrize("backward", [False, True])
def test_fill_crosses_partitions_and_long_gaps(spark, backward):
    rng = random.Random(5)
    rows = [(i, i * 1.0 if (i < 50 or rng.random() < 0.01) and i > 3 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = fill_in_order(df, ["v"], ["id"], backward).orderBy("id").toPandas()["v"]
    series = pd.Series([v for _, v in rows], dtype=float)
    pd.testing.assert_series_equal(got, series.bfill() if backward else series.ffill(), check_names=False)


@pytest.mark.parametrize("backward", [False, True])
def test_fill_stays_within_key_even_when_one_key_holds_most_rows(spark, backward):
    rng = random.Random(8)
    rows = [
        ("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, float(i) if rng.random() < 0.02 else None)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = fill_in_order(df, ["v"], ["id"], backward, ["k"]).orderBy("id").toPandas()
    frame = pd.DataFrame(rows, columns=["k", "id", "v"])
    groups = frame.groupby("k", dropna=False)["v"]
    want = groups.bfill() if backward else groups.ffill()
    np.testing.assert_array_equal(got["v"].to_numpy(dtype=float), want.to_numpy(dtype=float))


@pytest.mark.parametrize("rows_looked_at", [20_000, 7])
def test_exact_quantiles_match_numpy(spark, monkeypatch, rows_looked_at):
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", rows_looked_at)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(1)
    sample = np.concatenate([rng.lognormal(size=400), np.full(250, 2.5), -rng.random(51) * 1e6])
    df = spark.createDataFrame(pd.DataFrame({"v": sample}))
    wanted = [0.0, 0.02, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    assert exact_quantiles(df, "v", wanted) == pytest.approx(list(np.quantile(sample, wanted)), rel=1e-12)


def test_quantiles_count_weights_and_skip_missing(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 6), (None, 5), (float("nan"), 2)], "v double, w int")
    flat = np.repeat([1.0, 2.0, 10.0], [3, 1, 6])
    assert exact_quantiles(df, "v", [0.3, 0.35, 0.5], "w") == pytest.approx(list(np.quantile(flat, [0.3, 0.35, 0.5])))
    assert exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]


@pytest.mark.parametrize("small", [1 << 20, -1])
def test_attach_gives_every_row_its_value(spark, monkeypatch, small):
    monkeypatch.setattr(lookups, "SMALL_BYTES", small)
    keys = ["hot"] * 500 + [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, id int")
    dim = df.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("code", F.length("key"))
    got = lookups.attach(df, dim, "key", "code", "rows").collect()
    assert sorted((r["id"], r["code"]) for r in got) == [(i, len(k)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("small", [1 << 20, -1])
def test_join_spread_is_the_plain_join(spark, monkeypatch, small):
    monkeypatch.setattr(lookups, "SMALL_BYTES", small)
    big = spark.range(600).select((F.col("id") % 3).alias("item"), F.col("id").alias("user"))
    small = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "item long, target string")
    got = lookups.join_spread(big, small, "item", "user")
    want = big.join(small, "item")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_boxes_stay_small_where_most_points_share_an_edge():
    rng = np.random.default_rng(1)
    n = 200_000
    points = np.column_stack([np.full(n, 100.0), rng.normal(size=n), rng.normal(size=n)])
    points[:10, 0] = rng.uniform(0, 50, 10)
    boxes = space.cut_sample(points[::20], n // 2048)
    counts = lambda b: dict(zip(*(x.tolist() for x in np.unique(b.leaf_of(points), return_counts=True))))
    while (fewer := space.without_thin_sides(boxes, counts(boxes), 21)) is not None:
        boxes = fewer
    sizes = counts(boxes).values()
    assert min(sizes) >= 21 and max(sizes) <= 3 * 2048


def test_boxes_route_every_ball_to_all_its_leaves():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) * 0.01])
    boxes = space.cut_sample(points[::5], 16)
    leaf = boxes.leaf_of(points)
    ids = np.unique(leaf)
    boxes = space.fit_to_counts(
        boxes,
        {i: int((leaf == i).sum()) for i in ids},
        {i: points[leaf == i].min(axis=0) for i in ids},
        {i: points[leaf == i].max(axis=0) for i in ids},
        21,
    )
    leaf = boxes.leaf_of(points)
    assert all((leaf == i).sum() >= 21 for i in np.unique(leaf))
    radius = np.full(len(points), 0.4)
    rows, leaves = boxes.leaves_near(points, radius)
    visited = set(zip(rows.tolist(), leaves.tolist()))
    close = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) <= 0.4
    assert all((i, leaf[j]) in visited for i, j in zip(*np.nonzero(close)))


def tables(spark):
    folder = pathlib.Path(scratch.shared_folder(spark))
    return {p.name for p in folder.glob("tillwise-*")}


def test_temporary_tables_go_and_the_one_handed_over_stays(spark):
    before = tables(spark)
    with scratch.temporary() as outer:
        with scratch.temporary() as own:
            first = scratch.save(spark.range(10))
            second = scratch.save(first.where("id > 4"))
            result = own.hand_over(second.join(first, "id"))
            assert len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 1 and len(outer.tables) == 1 and outer.is_read_by(result.where("id > 5"))
        assert not outer.is_read_by(spark.range(3))
        assert result.count() == 5
    assert tables(spark) == before
    with pytest.raises(ZeroDivisionError), scratch.temporary():
        scratch.save(spark.range(3))
        raise ZeroDivisionError
    assert tables(spark) == before


def test_operators_of_many_passes_leave_one_table(spark):
    points = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(200)], "id int, x double, y double")
    before = tables(spark)
    scored = outliers.outlier_scores(points, ["x", "y"])
    assert len(tables(spark) - before) == 1 and scored.agg(F.sum("copies")).first()[0] == 200
    with scratch.temporary():
        again = outliers.outlier_scores(points, ["x", "y"])
        assert sorted(again.collect()) == sorted(scored.collect())
    assert len(tables(spark) - before) == 1


def test_history_drops_its_tables_when_closed(spark):
    before = tables(spark)
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "id int, v double")
    with history.EditHistory(df) as edits:
        for _ in range(history.LINEAGE_LIMIT + 1):
            edits.apply(lambda t: t.where("id >= 0"))
        assert len(tables(spark) - before) == 1 and edits.current.count() == 20
    assert tables(spark) == before and edits.current is df
