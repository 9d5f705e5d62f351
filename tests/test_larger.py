"""What fails on larger tables only: columns that don't vary, keys made for each row, products of all pairs."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from eventloom.functions import responses
from eventloom.operators import features, metrics, models, portfolio, products, ranking, vector_index
from eventloom.plans import fixtures, study_queries


def test_correlation_where_a_column_does_not_vary(spark):
    rows = [(-5.0, 1.0), (-5.0, 2.0), (0.5, 1.0), (0.7, 2.0), (0.1, 9.0), (4.0, None)]
    got = {r["bucket"]: r["corr"] for r in metrics.metrics_by_magnitude(spark.createDataFrame(rows, "a double, p double"), "a", "p").collect()}
    assert math.isnan(got[">=5"]) and got["3-5"] == 0 and got["<1"] == pytest.approx(np.corrcoef([0.5, 0.7, 0.1], [1, 2, 9])[0, 1])
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)], "id int, a double, b double")
    assert all(math.isnan(r["rolling_corr"]) for r in ranking.rolling_corr(flat, [], ["id"], "a", "b", 3).filter("id > 1").collect())
    assert math.isnan(metrics.regression_metrics(flat, "a", "b").first()["pearson"])


def test_a_range_is_found_by_a_binary_search(spark):
    df = ranking.ordered_parts(spark.range(500).withColumn("_h", ranking.draw(1, "id")), ["_h", "id"], 40)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "aggregate([32,16,8,4,2,1]" in plan  # six comparisons a row, not one for each cut
    keys = sorted((r["_h"], r["id"], r["_part"]) for r in df.collect())
    assert [k[2] for k in keys] == sorted(k[2] for k in keys) and {k[2] for k in keys} == set(range(40))


def test_drawdown_over_ranges(spark):
    moves = np.random.default_rng(4).normal(0, 1, 400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(moves)], "id int, r double").repartition(3)
    total = moves.cumsum()
    top = np.maximum.accumulate(total)
    assert portfolio.max_drawdown(df, ["id"], ["r"], legacy=False).first()["r"] == pytest.approx((total - top).min())
    assert portfolio.max_drawdown(df, ["id"], ["r"]).first()["r"] == pytest.approx(((total - top) / (top + 0.01) * 100).min())


@pytest.mark.parametrize("distance", [False, True])
def test_best_products_against_all_pairs(spark, distance, monkeypatch):
    monkeypatch.setattr(products, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    at = rng.integers(-3, 4, (700, 3)).astype(float) / 8  # many ties
    rows = spark.createDataFrame([(i % 2, i, [float(x) for x in v]) for i, v in enumerate(at)], "g int, id long, v array<double>")
    got = {}
    for r in products.best_products(rows, rows.filter("id % 100 = 0").select(F.col("id").alias("q"), "v"), 4, 6, distance=distance).collect():
        got.setdefault((r["g"], r["q"]), []).append((r["score"] if distance else -r["score"], r["id"]))
    for g in (0, 1):
        for q in range(0, 700, 100):
            scores = np.round(1 - at @ at[q] if distance else -(at @ at[q]), 6) + 0.0
            assert sorted(got[g, q])[:4] == sorted((s, i) for i, s in enumerate(scores.tolist()) if i % 2 == g)[:4]


def test_a_slice_is_cut_before_its_terms_are_spelled(monkeypatch):
    spelled = []
    join = pc.binary_join_element_wise
    monkeypatch.setattr(pc, "binary_join_element_wise", lambda *x: spelled.append(len(x[0])) or join(*x))
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in np.minimum(rng.geometric(0.02, 80), 400)] for _ in range(500)]
    counted = {}
    for row in words:
        for term in [*row, *(f"{a} {b}" for a, b in zip(row, row[1:]))]:
            counted[term] = counted.get(term, 0) + 1
    keep = 300
    task = features._term_counter(2, keep)
    batch = pa.RecordBatch.from_arrays([pa.array(words)], ["_w"])
    rows = {t: n for part in task(iter([batch, batch])) for t, n in zip(part.column("term").to_pylist(), part.column("tf").to_pylist())}
    assert max(spelled) <= keep < len(counted)
    every = rows.pop(None)
    assert every == 2 * sum(counted.values()) and len(rows) <= keep
    assert all(2 * counted[t] - every / keep <= n <= 2 * counted[t] for t, n in rows.items())
    assert all(t in rows for t, n in counted.items() if 2 * n > every / keep)


def in_languages(n, seed=7):
    """Vectors of few of 200 terms, fifty to a language and some strays; one is common, some are alike."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        at = np.unique(np.concatenate([rng.integers(0, 50, 12) + 50 * (i % 4), rng.integers(0, 200, int(rng.random() < 0.1))]))
        weight = rng.integers(1, 9, len(at)).astype(float)
        rows.append([(int(a), float(w)) for a, w in zip(at, weight / np.linalg.norm(weight))])
    return [rows[3] if i % 10 == 3 else r for i, r in enumerate(rows)]


def test_best_shared_products_against_all_pairs(spark, monkeypatch):
    for name, size in {"SHARED_ROWS": 300, "SHARED_QUERIES": 40, "BLOCK_QUERIES": 8, "TILE_ROWS": 20, "PLACES": 6}.items():
        monkeypatch.setattr(products, name, size)
    vectors = [*in_languages(900), [(7, 1.0)], [(260, 1.0)], []]  # of one term, of a term of its own, of none
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<struct<at: int, weight: double>>")
    queries = rows.filter("id % 7 = 3 OR id >= 900").select(F.col("id").alias("q"), "v").unionByName(spark.createDataFrame([(5000, [(300, 1.0)])], "q long, v array<struct<at: int, weight: double>>"))
    got = {}
    for r in products.best_shared_products(rows, queries, 12, 4).collect():
        got.setdefault(r["q"], []).append((-r["score"], r["id"]))
    dense = np.zeros((len(vectors), 301))
    for i, v in enumerate(vectors):
        for at, w in v:
            dense[i, at] = w
    asked = [i for i in range(902) if i % 7 == 3 or i >= 900]
    assert got.keys() == set(asked)
    for q in asked:
        scores = dense @ dense[q]
        assert sorted(got[q])[:12] == sorted((-round(s, 4), i) for i, s in enumerate(scores.tolist()) if s > 0)[:12]


def test_terms_that_few_share_are_not_multiplied():
    vectors, spent = in_languages(4000), []
    held = lambda name: pa.table([pa.array(range(len(vectors))), pa.array([[a for a, _ in v] for v in vectors], pa.list_(pa.int32())), pa.array([[w for _, w in v] for v in vectors], pa.list_(pa.float64()))], [name, "at", "weight"])
    found = products._shared_comparer(5, 6, spent)((), held("id"), held("q"))
    assert found.num_rows == 5 * len(vectors) and found.column("score").to_pylist()[0] == 1.0
    assert sum(spent) < 0.4 * len(vectors) ** 2 * 200


def test_a_task_of_the_index_holds_little():
    assert 3 * 8 * vector_index.QUERY_ROWS * vector_index.PART_ROWS < 400_000_000  # scores, their negatives and their order


def test_answers_are_parsed_once_in_compiled_columns(spark):
    rows = spark.createDataFrame([(1, "tone", "success", "{}")], "id long, task string, status string, response string")
    plan = responses.assemble_features(rows, "id", list(responses.TASKS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("transform(") == 1  # the one lambda is that of code fences
    assert responses.assemble_features(rows, "id", list(responses.TASKS)).first()["tone_confidence"] == 0.5


def test_models_are_fitted_on_what_they_read(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "run_experiments", lambda train, test, *_: seen.append((train.columns, test.columns)) or train.count() * test.count())
    assert study_queries.tree_models(fixtures.Inputs(spark, "/root/testdata/sf0.001")) > 0
    assert seen == [(["features", "y"], ["features", "y"])]


def test_every_language_has_a_model(spark, monkeypatch):
    rows = [(i, f"l{i % 18:02d}", f"word{i // 18 % 2} text of many", i // 18 % 2, 20) for i in range(18 * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int, n_chars int")
    docs = docs.unionByName(docs.filter("lang = 'l03'").withColumn("lang", F.lit("")).withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(docs.limit(30).withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 20_000))
    labels, t = docs.select("doc_id", "quality", F.lit(0).alias("toxic")), fixtures.Inputs(spark, "unused")
    t.documents, t.labels = docs.drop("quality"), labels
    # which languages get a model, not what features: the label itself is the one feature
    monkeypatch.setattr(study_queries.features, "vocabulary", lambda *a, **kw: None)
    monkeypatch.setattr(models, "with_text_vector", lambda df, *a, **kw: VectorAssembler(inputCols=["y"], outputCol="text_vector").transform(df))
    got = {r["lang"]: (r["n"], r["accuracy"]) for r in study_queries.group_text_models(t).collect()}
    tests = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).filter("lang IS NOT NULL").groupBy("lang").count().collect()
    assert got == {r["lang"]: (r["count"], 1.0) for r in tests} and len(got) == 19
