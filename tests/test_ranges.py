"""Orders cut into ranges: one date, one key, and ties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import ranking

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def eight(spark):
    """Eight ranges."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_date_uses_all_ranges(eight):
    rows = [(DAY, i) for i in range(4000)] + [(None, i) for i in range(100)] + [(DAY + dt.timedelta(days=1), 7)]
    random.Random(1).shuffle(rows)
    df = eight.createDataFrame(rows, "d date, id long")
    sizes = {r["_part"]: r["count"] for r in ranking.ordered_parts(df, ["d", "id"]).groupBy("_part").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * len(rows) / 8
    placed = {(r["d"], r["id"]): r["position"] for r in ranking.global_position(df, ["d", "id"]).collect()}
    assert [placed[x] for x in sorted(rows, key=lambda r: (r[0] or dt.date.min, r[1]))] == list(range(len(rows)))


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "int"])
def test_orders_of_any_type(eight, kind):
    df = eight.range(1000).select(F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(300)).cast("int").cast("timestamp" if kind == "timestamp" else kind)).alias("v"), "id")
    got = [r["id"] for r in ranking.global_position(df, ["v", "id"]).orderBy("position").collect()]
    assert got == [r["id"] for r in df.orderBy("v", "id").collect()]
    assert ranking.ordered_parts(df, ["v", "id"]).select("_part").distinct().count() == 8


def test_equal_rows_share_a_range(eight):
    df = eight.createDataFrame([(1, 1)] * 500 + [(2, i) for i in range(50)], "a int, b int")
    assert sorted(r["position"] for r in ranking.global_position(df, ["a", "b"]).collect()) == list(range(550))


def test_no_rows(eight):
    empty = eight.createDataFrame([], "a int, x double, y double")
    assert ranking.global_position(empty, ["a"]).count() == 0 and ranking.rolling_corr(empty, [], ["a"], "x", "y", 5).count() == 0


@pytest.mark.parametrize("keys", [1, 3])
def test_rolling_over_carried_rows(eight, monkeypatch, keys):
    draw, n = np.random.default_rng(3), 7
    rows = [(int(k), DAY + dt.timedelta(days=int(i) // 40), int(i), float(x), float(y)) for i, (k, x, y) in enumerate(zip(draw.integers(0, keys, 900), draw.normal(0, 1, 900), draw.normal(0, 1, 900)))]
    df = eight.createDataFrame(rows, "k int, d date, id long, x double, y double").repartition(5)
    out = ranking.rolling_corr(df, ["k"], ["d", "id"], "x", "y", n)
    got = {r["id"]: r["rolling_corr"] for r in out.collect()}
    assert len(got) == 900 == out.count()
    for k in range(keys):
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            want = None if i < n - 1 else np.corrcoef([q[3] for q in own[i - n + 1 : i + 1]], [q[4] for q in own[i - n + 1 : i + 1]])[0, 1]
            assert got[r[2]] == (want if want is None else pytest.approx(want))
    held = []
    monkeypatch.setattr(ranking, "global_position", lambda *a, f=ranking.global_position: held.append(f(*a)) or held[-1])
    ranking.rolling_corr(df, ["k"], ["d", "id"], "x", "y", n)
    sizes = held[0].withColumn("b", F.floor(F.col("_at") / F.greatest(F.lit(10 * n), F.ceil(F.col("_n") / 8)))).groupBy("k", "b").count()
    assert sizes.count() >= 8 and sizes.agg(F.max("count")).first()[0] <= 900 / 8 + 1  # no task holds a key


def test_pairs_are_drawn_from_their_group(eight):
    from eventloom.operators.joins import contrastive_pairs

    rows = [(i, "big" if i % 10 else "small", (i % 9) - 4.0) for i in range(2000)] + [(9000, "one-sided", 3.0)]
    df = eight.createDataFrame(rows, "id long, g string, ret double")
    held = {i: (g, r) for i, g, r in rows}
    got = contrastive_pairs(df, "g", "id", "ret", 1.0, 30).collect()
    assert sorted((r["g"], r["k"]) for r in got) == [(g, k) for g in ("big", "small") for k in range(30)]
    assert all(held[r["high_id"]] == (r["g"], r["high_return"]) and r["high_return"] > 1 and held[r["low_id"]] == (r["g"], r["low_return"]) and r["low_return"] < -1 for r in got)
    assert len({r["high_id"] for r in got if r["g"] == "big"}) > 20
