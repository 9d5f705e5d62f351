"""Vocabularies, term vectors and models of all groups at once against single fits and plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from eventloom.operators import features, models


def texts(n=300, seed=4):
    draw = np.random.default_rng(seed)
    rows = [(i, " ".join(f"word{min(int(z), 400)}" for z in draw.zipf(1.4, int(draw.integers(0, 60))))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "The of and")]


def counted(rows, most=2):
    """Document frequency and total of each n-gram, by plain loops."""
    held, total = Counter(), Counter()
    for _, t in rows:
        w = [x for x in re.findall(r"\w\w+", (t or "").lower()) if x not in features.STOP_WORDS]
        grams = [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
        total.update(grams)
        held.update(set(grams))
    return held, total


@pytest.mark.parametrize(("most_terms", "tracked", "full"), [(20, 1 << 14, False), (50, 256, True), (5000, 1 << 17, False), (5000, 64, True)])
def test_vocabulary(spark, monkeypatch, most_terms, tracked, full):
    rows, seen = texts(), []
    monkeypatch.setattr(features, "candidates", lambda t, m, f=features.candidates: seen.append(f(t, m)) or seen[-1])
    monkeypatch.setattr(features, "_terms", lambda *a, f=features._terms, **kw: seen.append("scan") or f(*a, **kw))
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    got = [(r["term"], r["df"], r["total"]) for r in features.vocabulary(df, "i", "t", most_terms, 2, 0.6, tracked=tracked).collect()]
    held, total = counted(rows)
    fit = sorted((-n, t) for t, n in total.items() if 2 <= held[t] <= 0.6 * len(rows))[:most_terms]
    assert got == [(t, held[t], -n) for n, t in fit]
    shown, unseen = seen[1]
    have = {r["term"] for r in shown.collect()}
    assert all(n <= unseen for t, n in total.items() if t not in have)
    assert full == (unseen >= 2 and (len(fit) < most_terms or -fit[-1][0] <= unseen))


def test_only_candidates_are_shuffled(spark):
    df = spark.createDataFrame(texts(), "i long, t string")
    known = features.vocabulary(df, "i", "t", 10)
    plan = features.term_weights(df, "i", "t", known)._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip() for x in plan.split("\n")]
    first = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert any("BroadcastHashJoin" in x for x in lines[first:])  # the join that keeps the vocabulary's terms is below the exchange


def test_terms_are_counted_before_they_leave_a_task(spark):
    rows = texts(80)
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    held, total = counted(rows)
    told = {r["term"]: (r["tf"], r["df"]) for r in features._terms(df, "t", 2, features.STOP_WORDS).collect()}
    assert told == {t: (n, held[t]) for t, n in total.items()}
    cut = {r["term"]: r["tf"] for r in features._terms(df, "t", 2, features.STOP_WORDS, 40).collect()}
    assert cut.pop(None) == sum(total.values()) and len(cut) <= 40
    assert all(0 <= n - cut.get(t, 0) <= sum(total.values()) / 41 for t, n in total.items())


def test_weights_of_longer_runs(spark):
    rows = [(1, "aa bb cc aa bb cc dd"), (2, "bb cc dd"), (3, "zz"), (4, None)]
    known = spark.createDataFrame([(t, 2.0) for t in ["aa bb cc", "bb cc dd", "cc", "bb cc", "qq rr"]], "term string, idf double")
    found = features.term_weights(spark.createDataFrame(rows, "i long, t string"), "i", "t", known, 3, sublinear=False, stop=[])
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each occurrence
    tf = {1: {"aa bb cc": 2, "bb cc dd": 1, "cc": 2, "bb cc": 2}, 2: {"bb cc dd": 1, "cc": 1, "bb cc": 1}}
    got = {(r["i"], r["term"]): r["weight"] for r in found.collect()}
    assert got == pytest.approx({(i, t): n / math.sqrt(sum(x * x for x in own.values())) for i, own in tf.items() for t, n in own.items()})


def test_term_vectors(spark):
    rows = texts(60)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "i long, t string, _i string")
    known = features.vocabulary(df, "i", "t", 30, 2)
    weights = {(r["i"], r["term"]): r["weight"] for r in features.term_weights(df, "i", "t", known).collect()}
    terms = sorted(r["term"] for r in known.collect())
    got = {r["i"]: r["text_vector"] for r in models.with_text_vector(df, "i", "t", known).collect()}
    assert set(got) == {i for i, _ in rows} and {v.size for v in got.values()} == {len(terms)}
    assert {(i, terms[k]): v for i, x in got.items() for k, v in zip(x.indices, x.values)} == weights
    assert not len(got[60].indices) and all(math.isclose(np.linalg.norm(x.values), 1) for x in got.values() if len(x.indices))


def grouped(spark, n=900, seed=7):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, 3)) * [1, 3, 0.2]
    g = draw.integers(0, 5, n)
    logit = x @ [1.0, -0.5, 2.0] * (g - 1) + 0.3 * g
    up = (draw.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    up[g == 4] = 1.0  # one class
    y = x @ [2.0, 1.0, -1.0] + g + draw.normal(0, 0.5, n)
    rows = [(f"g{k}", *map(float, v), float(a), float(b)) for k, v, a, b in zip(g, x, up, y)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0, 1.0), ("g1", None, 1.0, 1.0, 1.0, 1.0), ("g1", 1.0, 1.0, 1.0, None, None)], "g string, a double, b double, c double, up double, y double")


COLUMNS = ["a", "b", "c"]


@pytest.mark.parametrize("c", [0.1, 10.0])
def test_logistic_groups_equal_single_fits(spark, c):
    df = grouped(spark).cache()
    got = {r["g"]: r for r in models.logistic_groups(df.repartition(4), "g", COLUMNS, "up", c).collect()}
    assert set(got) == {f"g{i}" for i in range(4)}  # not the group of one class
    ready = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df.dropna())
    for g, r in got.items():
        own = ready.filter(F.col("g") == g)
        one = models.logreg(own.count(), c, labelCol="up", tol=1e-14).setMaxIter(500).fit(own)
        assert [r[x] for x in COLUMNS] == pytest.approx(list(one.coefficients), abs=1e-6) and r["intercept"] == pytest.approx(one.intercept, abs=1e-6)
        assert r["n"] == own.count()


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_linear_groups_equal_single_fits(spark, alpha):
    df = grouped(spark).cache()
    got = {r["g"]: r for r in models.linear_groups(df.repartition(4), "g", COLUMNS, "y", alpha).collect()}
    assert set(got) == {f"g{i}" for i in range(5)}
    for g, r in got.items():
        own = df.dropna().filter(F.col("g") == g).toPandas()
        x, y = own[COLUMNS].to_numpy(), own["y"].to_numpy()
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
        assert [r[k] for k in COLUMNS] == pytest.approx(list(w), abs=1e-8) and r["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-8)


def test_scans_do_not_grow_with_groups(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(models, "_summed", lambda *a, f=models._summed: scans.append(1) or f(*a))
    df = grouped(spark)
    models.linear_groups(df, "g", COLUMNS, "y")
    assert len(scans) == 1
    models.logistic_groups(df, "g", COLUMNS, "up")
    many = len(scans) - 1
    scans.clear()
    models.logistic_groups(df.filter("g = 'g2'"), "g", COLUMNS, "up")
    assert many <= len(scans) + 6
