"""Item texts and chunks against plain loops; models that only rows were known of."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import models, retrieval
from eventloom.plans import registry, study_queries  # noqa: F401

END = r"(?=item\s+\d+\.\d+|signature|\Z)"
FILINGS = [
    "Head Item 1.01 first part\nitem 2.02 second ITEM  9.01 third SIGNATURE Item 5.02 late",
    "no headers <TEXT> inside\n</TEXT> behind",
    "Item 2.02 a Item 2.02 b Item 2.02 c Item 5.02 d",
    "Item 3.03 other " * 14,
    "", None, "item two", "ITEM 7.01 é ü\n\nSignature",
]


def item_text(t, blocks=10, limit=50_000):
    found = re.findall(rf"(?is)(item\s+\d+\.\d+.*?){END}", t)
    body = re.search(r"(?is)<TEXT>(.*?)</TEXT>", t)
    return (" ".join(found[:blocks]) if found else body[1] if body else "")[:limit]


def key_items(t, items, each=2, fallback=5):
    block = lambda n: re.findall(rf"(?is)(item\s+{n}.*?){END}", t)
    named = [x for i in items for x in block(re.escape(i))[:each]]
    return " ".join(named or block(r"\d+\.\d+")[:fallback])


def test_item_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FILINGS)], "i int, t string")
    got = {r["i"]: (r["a"], r["b"], r["c"]) for r in df.select("i", text.extract_item_text(F.col("t")).alias("a"), text.extract_item_text(F.col("t"), 2, 20).alias("b"), text.extract_key_items(F.col("t"), ["2.02", "5.02"]).alias("c")).collect()}
    for i, t in enumerate(FILINGS):
        assert got[i] == ((None, None, None) if t is None else (item_text(t), item_text(t, 2, 20), key_items(t, ["2.02", "5.02"])))


def packed(t, separator, most=1000, least=300, overlap=100):
    parts = []
    for p in t.split(separator):
        p = p.strip(" ")
        parts += [x for x in (re.split(r"(?<=[.!?])\s+", p) if len(p) > most else [p]) if x]
    done, cur = [], ""
    for p in parts:
        if len(cur) + len(p) + 2 <= most:
            cur = f"{cur}\n\n{p}" if cur else p
        else:
            done += [cur] if cur else []
            cur = p
    chunks = [c for c in [*done, cur] if len(c) >= least]
    return [" ".join([chunks[i - 1][-overlap:] if i else "", c, chunks[i + 1][:overlap] if i + 1 < len(chunks) else ""]).strip(" ") for i, c in enumerate(chunks)]


def long_text(n):
    return "\n\n".join(f" Paragraph {i} " + " ".join(f"word{i}x{j}{'.' if j % 9 == 0 else ''}" for j in range(3 + 37 * i % 190)) for i in range(n))


def test_paragraph_chunks(spark):
    texts = ["", "short", long_text(1), long_text(9), long_text(20).replace("\n\n", "\n"), "x" * 2500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for separator in ("\n\n", "\n"):
        got = {(r["i"], r["chunk_position"]): r["chunk_text"] for r in retrieval.chunk_paragraphs(df, "i", "t", separator).collect()}
        assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(packed(t, separator))} and len(got) > 8


def test_item_chunks(spark):
    a, b = long_text(6), long_text(8)
    df = spark.createDataFrame([(1, f"[ITEM 2.02]{a}[ITEM 9.01]{b}"), (2, a), (3, "")], "i int, t string")
    got = {(r["i"], r["item"], r["chunk_position"]): r["chunk_text"] for r in retrieval.chunk_by_item(df, "i", "t").collect()}
    want = {(i, item, k): c for i, item, t in ((1, "2.02", a), (1, "9.01", b), (2, "FULL", a)) for k, c in enumerate(packed(t, "\n\n"))}
    assert got == want and len(want) > 6


# models


@pytest.fixture(scope="module")
def linear_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(0, 1, (400, 3))
    y = 3 * x[:, 0] + 0.5 * x[:, 1] + draw.normal(0, 0.1, 400) + 5
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(*map(float, r), float(v), float(v > 5)) for r, v in zip(x, y)], "a double, b double, c double, y double, up double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache(), x, y


def test_importances_find_the_cause(spark, linear_rows):
    df, *_ = linear_rows
    for regression, label in ((True, "y"), (False, "up")):
        fitted = models.forest("light", regression, labelCol=label, numTrees=15).fit(df)
        rows = models.feature_importance(fitted, ["a", "b", "c"], spark, 2).collect()
        assert [r["feature"] for r in rows] == ["a", "b"] and rows[0]["importance"] > 0.6
        assert rows[0]["importance"] == pytest.approx(fitted.featureImportances[0])


def test_penalties_equal_closed_forms(linear_rows):
    df, x, y = linear_rows
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    coefficients = lambda kind, alpha: np.array(models.linear(kind, alpha, n, y.std(), labelCol="y", tol=1e-12, maxIter=500).fit(df).coefficients)
    assert coefficients("ridge", 40.0) == pytest.approx(np.linalg.solve(xc.T @ xc + 40 * np.eye(3), xc.T @ yc), rel=2e-3)
    for kind, absolute, squared in (("lasso", 0.2, 0.0), ("elastic", 0.3, 0.3)):
        w = coefficients(kind, absolute + squared)
        slope = xc.T @ (yc - xc @ w) / n - squared * w
        held = np.abs(w) > 1e-6
        assert slope[held] == pytest.approx(absolute * np.sign(w[held]), abs=5e-3) and (np.abs(slope[~held]) < absolute).all()
        assert 0 < held.sum() < 3


def test_boosting_and_networks_learn(linear_rows):
    df, _, y = linear_rows
    out = models.boosted(labelCol="y", maxIter=10).fit(df).transform(df)
    assert out.stat.corr("prediction", "y") > 0.95
    net = models.mlp(3, 2, (8,), labelCol="up").fit(df).transform(df)
    assert net.filter("prediction = up").count() > 0.9 * len(y)
    assert models.embed_features(df.select(F.array("a", "b").alias("e"), "c", "y"), "e", ["c"]).first()["features"].size == 3


def test_groups_have_models_of_their_own(spark, linear_rows):
    df, *_ = linear_rows
    flipped = df.withColumn("g", F.lit("same")).unionByName(df.withColumn("up", 1 - F.col("up")).withColumn("g", F.lit("flipped"))).unionByName(df.limit(20).withColumn("g", F.lit("few")))
    found = models.fit_per_group(flipped, flipped, "g", ["same", "flipped", "few", "absent"], lambda n: models.logreg(n, 10.0, labelCol="up"), label="up")
    assert set(found) == {"same", "flipped"}
    for out in found.values():
        assert out.filter("prediction = up").count() > 0.9 * out.count()


@pytest.mark.parametrize(("name", "columns"), [("group_models", {"part", "n", "accuracy"}), ("group_text_models", {"lang", "n", "accuracy"})])
def test_group_queries_score_every_test_row(spark, name, columns):
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(out.columns) == columns
    rows = out.collect()
    assert all(r["n"] > 0 and 0 <= r["accuracy"] <= 1 for r in rows)
    if name == "group_models":
        vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
        assert sum(r["n"] for r in rows) == vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0).count()
