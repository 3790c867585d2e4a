"""Near-duplicates and the pipeline against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import components, minhash
from tests.llm import exact


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 5)))
    out = []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.choice([1, 3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [word()], [w[k], word()], [w[k].upper()]])
            if rng.random() < 0.2:
                w = w[rng.randint(0, 20) :]
            out.append(rng.choice([" ", "\n"]).join(w))
    out += [None, "", " \t", "a b", "A b", "a  B", "one", "a b c d", "a b c d e", "é É x y z", "É é x y z"]
    rng.shuffle(out)
    return [(k + 5, t) for k, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "star", "percent"), [(1, 1 << 22, 85), (2, 500, 80), (3, 2000, 85)])
def test_components(spark, seed, star, percent):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(docs[0][0], docs[0][1], "again", 2)], "doc_id long, text string, id string, keys int")
    got = minhash.near_duplicates(df, star_shingles=star, percent=percent).collect()
    assert len(got) == len(docs) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == exact.components(docs, percent)
    kept = minhash.drop_near_duplicates(df, star_shingles=star, percent=percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, v in exact.components(docs, percent).items() if v[2]}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(3, None), (4, " ")], "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(blank).collect()} == {(3, 0, 3, True), (4, 0, 4, True)}


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(30)] + [(500, 500)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert set(rows) <= set(before)
        if k == 1:
            assert set(rows) == {i for i, v in exact.components(sorted(before.items()), 80).items() if v[2]}
        if k == 3:
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {i for i, t in before.items() if any(x in " ".join((t or "").lower().split()) for x in items)}
            assert set(rows) == set(before) - leaks
        before = rows
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(before)


def test_no_join_with_a_written_table_is_broadcast(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2}x{j}" for j in range(30)) + f" {k}") for k in range(40)], "doc_id long, text string")
    found = minhash.near_duplicates(docs)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == [k - k % 2 for k in range(40)]
    nodes = minhash.written(minhash.signatures(docs, "doc_id", "text", 10, 2), "nodes").select(F.col("doc_id").alias("id"), "keys")
    stars = minhash.tensor_stars(nodes, 10)
    compared = minhash.compare(stars, docs.withColumnRenamed("doc_id", "id"))
    for d in (found, stars, compared):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().sparkPlan().toString()
