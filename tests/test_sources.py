"""Sources and sinks against plain readers."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.plans import market
from eventloom.plans.fixtures import Inputs
from eventloom.sources import json_splits, tables
from eventloom.sources.resume import ResultStore

TRICKY = ["", "}", "{", '"', '\\', '\\"', "a}b{c", '"}', '{"x": "}"}', "[{}]", "\n", "é}€", 'end\\\\', ",", "],[", "tab\t}", " }"]


def records(n, seed=1):
    draw = random.Random(seed)
    return [{"id": i, "text": draw.choice(TRICKY) + draw.choice(TRICKY), "inner": {"a": draw.choice(TRICKY), "list": [{"b": draw.choice(TRICKY)}] * draw.randint(0, 2)}} for i in range(n)]


SCHEMA = "id BIGINT, text STRING, inner STRUCT<a: STRING, list: ARRAY<STRUCT<b: STRING>>>"


@pytest.fixture
def splits(spark):
    """Splits of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}

    def use(size):
        keys["spark.sql.files.maxPartitionBytes"] = str(size)
        for k, v in keys.items():
            spark.conf.set(k, v)

    yield use
    for k in keys:
        spark.conf.unset(k)


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
@pytest.mark.parametrize("form", [{"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_arrays_in_splits(spark, splits, tmp_path, size, form):
    for i, n in enumerate((12, 1, 0)):
        (tmp_path / f"f{i}.json").write_text(" " * i + json.dumps(records(n, i), **form) + "\n" * i, encoding="utf-8")
    want = rows(spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True))
    assert len(want) == 13
    splits(size)
    assert rows(tables.read_json_records(spark, str(tmp_path), SCHEMA)) == want


@pytest.mark.parametrize("size", [7, 150, 1 << 20])
def test_objects_in_splits(spark, splits, tmp_path, size):
    held = {f"k}}{i}\"{t}": {"id": i, "text": t} for i, t in enumerate(TRICKY)}
    (tmp_path / "a.json").write_text(json.dumps(held))
    (tmp_path / "b.json").write_text(json.dumps({"only": {"id": 99, "text": "x"}}, indent=2) + "\n ")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("")
    splits(size)
    got = rows(tables.read_keyed_json(spark, str(tmp_path), "struct<id:bigint,text:string>", "key"))
    assert got == sorted(json.dumps({"key": k} | v, sort_keys=True) for k, v in [*held.items(), ("only", {"id": 99, "text": "x"})])


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_entries_that_are_no_objects(spark, splits, tmp_path, size):
    (tmp_path / "a.json").write_text('{"a": null, "b": {"id": 1}, "c": null, "d": {"id": 2}, "e": null}')
    splits(size)
    got = {r["key"]: r["id"] for r in tables.read_keyed_json(spark, str(tmp_path), "struct<id:bigint>", "key").collect()}
    assert got == {"a": None, "b": 1, "c": None, "d": 2, "e": None}


def test_a_file_is_many_tasks(spark, splits, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(200)))
    splits(2000)
    entries = json_splits.json_entries(spark, str(tmp_path / "a.json"))
    assert entries.rdd.getNumPartitions() > 8 and entries.count() == 200
    parts = json_splits._walked(spark, str(tmp_path / "a.json"))
    assert parts.filter("part <> 1").count() <= 2 * parts.select("split").distinct().count()  # what is complete stays where it was read
    assert parts.filter("part = 1").count() > 150


def test_splits_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", ["train", "val", "test"][i % 3]) for i in range(30)], "id long, text string, split string")
    tables.write_splits(df, str(tmp_path))
    for fmt in ("csv", "json"):
        back = spark.read.schema("id long, text string").option("header", True).format(fmt).load(f"{tmp_path}/{fmt}").select("id", "text", F.col("split"))
        assert rows(back) == rows(df)


# resumable results


def test_results_resume_after_a_broken_run(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"), "k", bits=1 << 14)
    df = spark.createDataFrame([(f"key {i}", i) for i in range(1000)] + [(None, -1)], "k string, v int")
    assert store.remaining(df).count() == 1001 and store.finished() is None
    store.commit(df.filter("v % 10 = 0 AND v >= 0"), "first")
    store.commit(df.filter("v % 10 = 1"), "second")
    df.filter("v % 10 = 2").write.parquet(str(tmp_path / "results/rows/batch=broken"))  # rows, but no filter
    again = ResultStore(spark, str(tmp_path / "results"), "k", bits=1 << 14)
    assert again.committed() == ["first", "second"] and again.finished().count() == 200
    want = sorted(r["v"] for r in tables.remaining(df, again.finished(), "k").collect())
    assert sorted(r["v"] for r in again.remaining(df).collect()) == want and len(want) == 801
    may = again.possible(df).filter("_may")
    assert {r["v"] for r in may.collect()} >= {i for i in range(1000) if i % 10 < 2} and may.count() < 260  # the others need no look
    again.commit(df.filter("v % 10 = 2"), "broken")  # the run that broke off is done again
    assert again.remaining(df).count() == 701
    with pytest.raises(ValueError, match="committed"):
        again.commit(df, "first")


def test_a_full_filter_only_costs_time(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"), "k", bits=64)
    df = spark.range(500).withColumnRenamed("id", "k")
    store.commit(df.filter("k < 300"), "a")
    assert sorted(r["k"] for r in store.remaining(df).collect()) == list(range(300, 500))


# bars


def test_stored_bars_need_no_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Inputs(spark, "/root/testdata/sf0.001")
        bars = market.bucketed_bars(t.bars, "bars_in_buckets", str(tmp_path / "bars"))
        days = {r["day"] for r in bars.select("day").distinct().collect()}
        assert bars.count() == t.bars.count() and len(days) > 10
        for made in (market.forward_return(t.filings, bars, t.benchmark_days), market.immediate_reaction(t.filings, bars, t.benchmark_days)):
            made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
            depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
            scans = [i for i, x in enumerate(plan) if "Scan parquet" in x and "bars_in_buckets" in x]
            assert len(scans) >= 2
            for i in scans:  # up to the join that a scan feeds
                above = depth(plan[i])
                for x in reversed(plan[:i]):
                    if depth(x) < above:
                        above = depth(x)
                        assert "Exchange" not in x
                        if "Join" in x:
                            break
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bars_in_buckets")


@pytest.mark.parametrize("seed", [1, 2])
def test_momentum_by_lookups(spark, seed):
    draw = random.Random(seed)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    bars = [(k, day(n), draw.uniform(1, 9)) for k in "ab" for n in draw.sample(range(700), 90 if k == "a" else 5)]
    bench = [(day(n), draw.uniform(1, 9)) for n in range(0, 700, 3)]
    events = [(i, k, day(n)) for i, (k, n) in enumerate([(draw.choice("abc"), draw.randrange(-50, 800)) for _ in range(60)])] + [(99, "a", None), (98, None, day(400))]
    out = market.momentum(spark.createDataFrame(events, "i int, ticker string, filing_date date"), spark.createDataFrame(bars, "ticker string, day date, close double"), spark.createDataFrame(bench, "day date, close double"), [7, 90])

    def change(rows, at, d):
        held = sorted(x for x in rows if at - dt.timedelta(days=d + 10) <= x[0] < at)
        return (held[-1][1] - held[0][1]) / held[0][1] * 100 if len(held) >= 2 else None

    for r in out.collect():
        for d in (7, 90):
            at = r["filing_date"]
            own, market_ = (None, None) if at is None else (change([b[1:] for b in bars if b[0] == r["ticker"]], at, d), change(bench, at, d))
            assert r[f"momentum_{d}d"] == (None if own is None or market_ is None else pytest.approx(own - market_, abs=0.006))


def test_momentum_meets_no_bar_by_bar(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    plan = market.momentum(t.filings, t.bars, t.benchmark_days, [7, 365])._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan.lower()  # no row for each month or bar of a window
