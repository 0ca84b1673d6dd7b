import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import outliers, segments
from tillwise.plans import space


def brute_force(x, k):
    """Local outlier factor with neighbours by (distance, place in sorted order)."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    rank = np.lexsort(x.T[::-1]).argsort()
    near = np.array([np.lexsort((rank, row))[:k] for row in d])
    dist = np.take_along_axis(d, near, axis=1)
    reach = np.maximum(dist, dist[:, -1][near])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    return -(lrd[near] / lrd[:, None]).mean(axis=1)


@pytest.mark.parametrize("leaf_points, queries_per_task", [(2048, 8192), (40, 16)])
def test_outlier_scores_match_brute_force(spark, monkeypatch, leaf_points, queries_per_task):
    monkeypatch.setattr(space, "LEAF_POINTS", leaf_points)
    monkeypatch.setattr(outliers, "QUERIES_PER_TASK", queries_per_task)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(250, 3)), rng.normal(size=(150, 3)) * 0.02 + 2, rng.normal(size=(6, 3)) * 9])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    got = outliers.outlier_scores(df, ["a", "b", "c"]).toPandas().set_index(["a", "b", "c"]).sort_index()
    want = pd.Series(brute_force(x, 20), index=pd.MultiIndex.from_arrays(x.T)).sort_index()
    np.testing.assert_allclose(got["lof_score"].to_numpy(), want.to_numpy(), rtol=1e-9)
    assert got["is_outlier"].sum() == (want < np.quantile(want, 0.02)).sum()


def test_a_third_of_customers_on_one_point(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile([1.0, 1.0], (150, 1)), np.tile([4.0, 2.0], (5, 1)), rng.random((295, 2)) * 5])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    got = outliers.outlier_scores(df, ["a", "b"]).toPandas()
    assert got["copies"].sum() == len(x) and got["copies"].max() == 150
    want = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "s": brute_force(x, 20)}).groupby(["a", "b"])["s"].mean()
    both = got.set_index(["a", "b"])["lof_score"].sort_index()
    # points whose neighbours include the crowd depend on a density of 1e10: compare relatively
    np.testing.assert_allclose(both.to_numpy(), want.sort_index().to_numpy(), rtol=1e-6)
    assert both.loc[(1.0, 1.0)] == pytest.approx(-1.0)


@pytest.mark.parametrize("rows", [10, 11, 13, 40, 57, 399, 1000])
def test_quartiles_equal_pandas_cut_of_ranks(spark, rows):
    table = spark.range(1, rows + 1).withColumn("same", F.lit(7))
    # equal values are ranked by id
    scores = segments.quarters(table, "id", rows, {"q": F.col("id") * 2, "tied": F.col("same")})
    ranks = table.select("id", scores["q"].alias("q"), scores["tied"].alias("tied"))
    assert ranks.where("q <> tied").count() == 0
    want = pd.qcut(pd.Series(range(1, rows + 1), dtype=float), 4, labels=[1, 2, 3, 4]).astype(int)
    assert [r["q"] for r in ranks.orderBy("id").collect()] == want.tolist()


def sales(spark, customers, extra=()):
    rows = []
    for i in range(customers):
        for n in range(1 + i % 3):
            rows.append((f"c{i:03d}", f"2024-0{1 + (i + n) % 9}-1{n} 10:00:00", 10.0 * (i + 1) + n))
    return spark.createDataFrame(rows + list(extra), "who string, placed string, amount double")


def test_nine_customers_are_standard(spark):
    table = segments.rfm_segments(sales(spark, 9), "who", "placed", "amount")
    assert table.columns == ["who", "Recency", "Frequency", "Monetary", "Segment"]
    assert {r["Segment"] for r in table.collect()} == {"Standard Customer"}


def test_refunds_unknown_customers_and_partial_days(spark):
    extra = [
        ("refund", "2024-01-01 00:00:00", 5.0), ("refund", "2024-01-02 00:00:00", -5.0),
        (None, "2024-12-31 01:00:00", 3.0), ("late", "2024-12-29 23:00:00", 7.0), ("gap", "2024-12-30 12:00:00", None),
        ("gap", "2024-12-30 12:00:00", 4.0),
    ]
    rows = {r["who"]: r for r in segments.rfm_table(sales(spark, 10, extra), "who", "placed", "amount").collect()}
    assert "refund" not in rows and None not in rows
    # the newest date belongs to a row without a customer; 2 days 2 hours later than "late"
    assert rows["late"]["Recency"] == 2
    assert (rows["gap"]["Frequency"], rows["gap"]["Monetary"]) == (2, 4.0)


def test_segments_match_pandas(spark):
    df = sales(spark, 60)
    got = segments.rfm_segments(df, "who", "placed", "amount").toPandas().set_index("who").sort_index()
    frame = df.toPandas()
    frame["placed"] = pd.to_datetime(frame["placed"])
    newest = frame["placed"].max() + pd.Timedelta(days=1)
    base = frame.groupby("who").agg(
        Recency=("placed", lambda d: (newest - d.max()).days), Frequency=("who", "count"), Monetary=("amount", "sum")
    )
    scores = {}
    for name, column, labels in (("R", "Recency", [4, 3, 2, 1]), ("F", "Frequency", [1, 2, 3, 4]), ("M", "Monetary", [1, 2, 3, 4])):
        capped = base[column] if name == "R" else base[column].clip(upper=base[column].quantile(0.99))
        scores[name] = pd.qcut(capped.rank(method="first"), 4, labels=labels).astype(int)
    for name in "RFM":
        assert got[f"{name}_Score"].tolist() == scores[name].tolist()
    assert (got["RFM_Score"] == scores["R"].astype(str) + scores["F"].astype(str) + scores["M"].astype(str)).all()
    totals = sum(scores.values())
    assert (got.loc[(totals >= 11) & (got["Segment"] != "VIP / Whale"), "Segment"] == "Premium / Champion").all()


def test_summary_counts_everyone(spark, orders):
    table = segments.rfm_segments(orders, "o_custkey", "o_orderdate", "o_totalprice")
    summary = segments.segment_summary(table).collect()
    assert sum(r["customers"] for r in summary) == table.count()
    assert [r["customers"] for r in summary] == sorted((r["customers"] for r in summary), reverse=True)
