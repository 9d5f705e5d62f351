"""The vector index and the posting blocks against exhaustive searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import vector_index
from eventloom.operators.postings import blocks_read, keyword_search, posting_blocks
from eventloom.operators.vector_index import build_index, recall, search


def neighbours(rows, queries, k, keep=lambda i: True):
    """(query, id, rank) by plain loops."""
    out = set()
    for q, v in queries:
        if v is None or not np.any(v):
            continue
        cos = lambda x: round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 9)
        best = sorted((-cos(x), i) for i, x in rows if x is not None and len(x) == len(v) and np.any(x) and keep(i))[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    return out


def clustered(n=400, d=16, seed=2):
    draw = np.random.default_rng(seed)
    at = draw.normal(0, 1, (12, d))
    rows = [(i, [float(x) for x in at[i % 12] * (3 if i % 3 else 1) + draw.normal(0, 0.4, d)]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a common vector
    return rows + [(2000, None), (2001, [0.0] * d)]


def test_every_vector_is_in_one_list(spark, tmp_path):
    rows = clustered()
    index = build_index(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", str(tmp_path / "index"), 10)
    lists = index.vectors().groupBy("id").agg(F.count("*").alias("n"), F.min("list").alias("list")).collect()
    assert {r["id"] for r in lists} == {i for i, _ in rows} and all(r["n"] == 1 for r in lists)
    assert {r["id"] for r in lists if r["list"] == -1} == {2000, 2001}
    sizes = {r["list"]: r["size"] for r in index.centres().collect()}
    assert len(sizes) == 10 and sum(sizes.values()) == len(rows) - 2


@pytest.mark.parametrize("part", [50_000, 20])
def test_exact_search(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART_ROWS", part)
    rows = clustered()
    df = spark.createDataFrame([(i, v, i % 2) for i, v in rows], "i long, v array<double>, side int")
    index = build_index(df, "i", "v", str(tmp_path / "index"), 12, ["side"])
    asked = [*rows[::17], (3000, None), (3001, [0.0] * 16), (3002, [1.0] * 3)]
    queries = spark.createDataFrame(asked, "q long, w array<double>")
    asked = asked[:-1]
    got = {(r["q"], r["id"], r["rank"]) for r in search(index, queries, "q", "w", 7, 1, exact=True).collect()}
    assert got == neighbours(rows, asked, 7)
    got = {(r["q"], r["id"], r["rank"]) for r in search(index, queries, "q", "w", 7, 2, exact=True, where="side = 1").collect()}
    assert got == neighbours(rows, asked, 7, lambda i: i % 2 == 1)
    some = {(r["q"], r["id"], r["rank"]) for r in search(index, queries, "q", "w", 700, 1, exact=True).collect()}
    assert some == neighbours(rows, asked, 700)


def test_recall_of_few_lists(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = build_index(vectors, "vec_id", "embedding", str(tmp_path / "index"), 40, sample=1000)
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    truth = spark.createDataFrame([(q, i) for q, i, _ in neighbours(rows, [r for r in rows if r[0] % 20 == 0], 10)], "q long, id long")
    assert recall(search(index, queries, "q", "embedding", 10, 16), truth, "q") >= 0.9
    assert recall(search(index, queries, "q", "embedding", 10, 1), truth, "q") < 1
    assert recall(search(index, queries, "q", "embedding", 10, 1, exact=True), truth, "q") == 1


def test_scan_prunes_lists(spark, tmp_path):
    rows = clustered()
    index = build_index(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", str(tmp_path / "index"), 10)
    one = spark.createDataFrame(rows[3:4], "q long, w array<double>")
    plan = search(index, one, "q", "w", 3, 2)._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in plan.split("PartitionFilters: [")[1:] if x.startswith(("list", "isnotnull(list"))or " IN (" in x[:80]]
    assert any(" IN (" in x[:120] for x in pruned)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "i long, v array<double>")
    index = build_index(empty, "i", "v", str(tmp_path / "index"), 4)
    assert search(index, spark.createDataFrame([(1, [1.0])], "q long, w array<double>"), "q", "w").count() == 0


# keyword search


def weighted(n=600, terms=60, seed=5):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        held = np.unique(np.minimum(draw.geometric(0.12, 12), terms))
        w = draw.random(len(held)) * held  # frequent terms weigh little
        rows += [(i, f"t{t}", float(x)) for t, x in zip(held, w / np.linalg.norm(w))]
    return rows + [(5000 + i, "t1", 1.0) for i in range(300)]  # a common term, in many equal rows


def best_by_loops(rows, asked, k):
    by_doc, out = {}, set()
    for i, t, w in rows:
        by_doc.setdefault(i, {})[t] = w
    queries = {}
    for q, t, w in asked:
        queries.setdefault(q, {})[t] = w
    for q, terms in queries.items():
        scores = sorted((-round(sum(w * d[t] for t, w in terms.items() if t in d), 6), i) for i, d in by_doc.items() if terms.keys() & d.keys())
        out |= {(q, i, r + 1, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_keyword_search_reads_fewer_postings(spark, k):
    rows = weighted()
    weights = spark.createDataFrame(rows, "i long, term string, weight double").cache()
    asked = [(i, t, w) for i, t, w in rows if i % 20 == 0 and i < 5000] + [(9000, "t1", 1.0), (9001, "absent", 1.0)]
    queries = spark.createDataFrame(asked, "query_id long, term string, weight double").cache()
    blocks = posting_blocks(weights, "i", 16).cache()
    assert blocks.agg(F.sum("n")).first()[0] == len(rows) and blocks.agg(F.max("n")).first()[0] < 60
    got = {(r["query_id"], r["i"], r["rank"], r["score"]) for r in keyword_search(blocks, weights, queries, "i", k).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in best_by_loops(rows, asked, k)}
    known = spark.createDataFrame([(q, min(s for p, _, _, s in got if p == q)) for q in {x[0] for x in got}], "query_id long, least double")
    postings = lambda read: read.agg(F.sum("n")).first()[0]
    assert postings(blocks_read(blocks, queries, known)) < (0.35 if k == 1 else 0.6) * postings(blocks_read(blocks, queries, known.limit(0)))


def test_keyword_search_of_nothing(spark):
    weights = spark.createDataFrame([], "i long, term string, weight double")
    queries = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight double")
    assert keyword_search(posting_blocks(weights, "i"), weights, queries, "i").count() == 0
