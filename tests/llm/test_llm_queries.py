"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import sys

import duckdb
import pytest
from conftest import DATA, ROOT

sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check import compare  # noqa: E402
from queries import TABLES  # noqa: E402
from tillwise.llm.queries import QUERIES  # noqa: E402

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, db, name):
    query, sql = QUERIES[name]
    assert compare(query(spark, str(FOLDER)).toPandas(), db.execute(sql).df()) == "same"


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= entry.queries().keys()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(FOLDER)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = ({r["doc_id"]: r for r in before.collect()}, docs.collect())
        if name != "mixing":
            assert docs.columns == before.columns

    from tillwise.llm import quality, toxicity

    before, after = seen["quality rules"]
    judged = quality.judge(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in judged}
    before, after = seen["toxicity"]
    gone = before.keys() - {r["doc_id"] for r in after}
    scores = toxicity.toxicity(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert gone == {r["doc_id"] for r in scores.where("predicted = 1").collect()} and gone

    before, after = seen["near duplicates"]
    sets = {d: shingles(r["text"]) for d, r in before.items()}
    kept = {r["doc_id"] for r in after}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    parent = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and linked(a, b):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    assert kept == {d for d in sets if parent[d] == d}

    before, after = seen["benchmark decontamination"]
    items = [shingles(t) for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    bad = {d for d, r in before.items() if any(100 * len(shingles(r["text"]) & i) >= 75 * len(i) > 0 for i in items)}
    assert {r["doc_id"] for r in after} == before.keys() - bad

    before, after = seen["mixing"]
    places = [(r["shard"], r["place"], r["doc_id"], r["copy"]) for r in after]
    assert len(set(places)) == len(places) and all(r["copies"] <= 3 for r in after)
    taken = {}
    for r in after:
        taken.setdefault(r["source"], [0, r["target"]])[0] += r["size"]
    largest = max(len((r["text"] or "").split()) for r in before.values())
    assert all(abs(n - target) <= max(largest, 0.05 * target) for n, target in taken.values())


def test_a_stage_drops_the_tables_of_the_one_before(spark, tmp_path):
    import pathlib

    from tillwise.plans.scratch import shared_folder

    tables = lambda: {p.name for p in pathlib.Path(shared_folder(spark)).glob("tillwise-*")}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(50)
    corpus_pipeline._last.drop()
    before = tables()
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(FOLDER))
    made = tables() - before
    # its result has not been written yet: nothing goes
    corpus_pipeline.STAGES[3][1](spark, first, str(FOLDER))
    assert made and made <= tables()
    first.write.parquet(str(tmp_path / "first"))
    corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(str(tmp_path / "first")), str(FOLDER)).count()
    assert not made & tables()


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, str(FOLDER))
    assert {"doc_id", "text", "shard", "copy", "taken"} <= set(rows.columns) and rows.count() > 0
