import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions import responses, text
from eventloom.operators import features, metrics, models, ranking, retrieval
from eventloom.plans import market, registry, study_queries  # noqa: F401
from eventloom.sources import tables
from eventloom.streaming.labels import labelled, session_counts


def one(df):
    return [tuple(r) for r in df.collect()]


def test_session_boundaries(spark):
    day = "2024-01-03 "
    times = {"03:59:59": "overnight", "04:00:00": "pre_market", "09:29:59": "pre_market", "09:30:00": "market_hours", "15:59:59": "market_hours", "16:00:00": "after_hours", "19:59:59": "after_hours", "20:00:00": "overnight"}
    rows = [(day + t, want) for t, want in times.items()] + [("2024-01-06 12:00:00", "overnight"), (None, "after_hours")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", market.session_class(F.col("t").cast("timestamp_ntz")))
    assert df.filter("got <> want").count() == 0


def test_targets_at_the_thresholds(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (-1.0001,), (0.0,), (1.0,), (1.0001,)], "r double")
    labels = market.classification_targets(F.col("r"))
    assert one(df.select(labels["binary_label"], labels["three_label"], market.signal(F.col("r")))) == [(0, 1, None), (0, 1, "STAY"), (0, 0, "DOWN"), (0, 1, "STAY"), (1, 1, "STAY"), (1, 2, "UP")]


def test_item_numbers(spark):
    df = spark.createDataFrame([("2",), ("2.2",), ("2.02",), ("2.025",), ("2.",), ("123.4",)], "n string")
    assert [r[0] for r in df.select(text.normalize_item(F.col("n"))).collect()] == ["2.01", "2.02", "2.02", "2.02", None, None]


def test_sections(spark):
    body = "Item 2.02 Results on the header line\n" + "good words " * 30 + "\nItem 9.1\nlast\nSIGNATURES\nnobody"
    df = spark.createDataFrame([(1, body), (2, "nothing here")], "id long, text string")
    got = one(text.split_sections(df, "id", "text"))
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 1, "2.02"), (1, 2, "9.1")]
    assert "header line" not in got[0][3] and got[1][3].strip() == "last"


def test_chunk_lengths(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 99, 100, 600, 699, 700, 701, 1300)], "id long, text string")
    got = {}
    for i, p, t in one(retrieval.chunk_fixed(df, "id", "text")):
        got.setdefault(i, []).append(len(t))
    assert got == {100: [100], 600: [600], 699: [699], 700: [700, 100], 701: [700, 101], 1300: [700, 700, 100]}


def test_answer_parsers(spark):
    said = ["Filing B outperformed", "Answer: A", "only filing a here", "", "confidence: 0.8", "80% confident", "maybe"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = one(df.select(responses.parse_pair(F.col("s")), responses.parse_confidence(F.col("s"))))
    assert [g[0] for g in got] == ["B", "A", "A", "UNCLEAR", "UNCLEAR", "UNCLEAR", "UNCLEAR"]
    assert [g[1] for g in got] == [0.6, 0.6, 0.6, 0.6, 0.8, 0.8, 0.45]


@pytest.mark.parametrize("n", [10, 11, 19, 20])
def test_bins(spark, n):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(n)], "id long, v double")
    first = [r["bin"] for r in ranking.qcut_rank(df, "v", "id").orderBy("id").collect()]
    assert first == [max(1, -(-i * 10 // (n - 1))) for i in range(n)]
    equal = [r["bin"] for r in ranking.equal_deciles(df, "v", "id").orderBy("id").collect()]
    assert equal == [min(10, i // (n // 10) + 1) for i in range(n)]


def test_split_keeps_time_order(spark):
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3)) for i in range(100)], "id long, d date")
    out = ranking.temporal_split(df, ["d", "id"])
    sizes = dict(one(out.groupBy("split").count()))
    assert sizes == {"train": 70, "val": 15, "test": 15}
    spans = {r["split"]: r for r in ranking.split_summary(out, "d").collect()}
    assert spans["train"]["to_date"] <= spans["val"]["from_date"] and spans["val"]["to_date"] <= spans["test"]["from_date"]


def test_returns_reject_bad_prices(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    bench = spark.createDataFrame([(d, 10.0, 10.0) for d in days], "day date, open double, close double")
    prices = {"ok": (10.0, 11.0), "zero": (0.0, 11.0), "null": (None, 11.0)}
    bars = spark.createDataFrame([(k, d, *p) for k, p in prices.items() for d in days], "ticker string, day date, open double, close double")
    events = spark.createDataFrame([(i, k, days[j], "market_hours") for i, (k, j) in enumerate([("ok", 0), ("zero", 0), ("null", 0), ("ok", 3), ("none", 0)])], "accession long, ticker string, filing_date date, session string")
    out = market.forward_return(events, bars, bench)
    assert one(out.select("accession", "adjusted_return_pct")) == [(0, 10.0)]


def test_unseen_codes_are_zero(spark):
    train, test = (spark.createDataFrame([(x,) for x in v], "c string") for v in (["b", "a", None], ["a", "b", "z", None]))
    assert [r["c_code"] for r in features.label_encode(test, ["c"], train).collect()] == [0, 1, 0, 2]


def test_reports_without_hits(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "a int, p int")
    assert {r["class"]: (r["precision"], r["f1"]) for r in metrics.class_report(df, "a", "p", [0, 1]).collect()} == {0: (0.0, 0.0), 1: (0.0, 0.0)}


def test_unknown_preset_is_rejected():
    with pytest.raises(ValueError):
        models.forest("very_strong")


def test_files(spark, tmp_path):
    (tmp_path / "2019.csv").write_text("item,ret\n2.02,1.5\n")
    (tmp_path / "2021.csv").write_text("item,ret\n9.01,\n")
    got = tables.read_years(spark, str(tmp_path) + "/{year}.csv", [2019, 2020, 2021], "item string, ret double")
    assert sorted(one(got)) == [("2.02", 1.5), ("9.01", None)]
    (tmp_path / "keyed.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}')
    assert sorted(one(tables.read_keyed_json(spark, str(tmp_path / "keyed.json"), "struct<x:int>"))) == [("a", 1), ("b", 2)]
    (tmp_path / "records.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert sorted(one(tables.read_json_records(spark, str(tmp_path / "records.json"), "x int"))) == [(1,), (2,)]
    df = spark.createDataFrame([(1, "long text", 2020)], "id long, text string, year int")
    tables.write_with_metadata(df, str(tmp_path / "out"), "text", "year")
    assert spark.read.parquet(str(tmp_path / "out/metadata")).columns == ["id", "year"]
    tables.write_splits(df.withColumnRenamed("year", "split"), str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits/json")).count() == 1


def test_yearly_files_hold_every_order(spark, tmp_path):
    days = [None, "1988-05-01", "1995-01-01", "1996-01-01", "2000-12-31", "2001-08-01", "2004-02-29"]
    rows = [(i, i % 3, d and dt.date.fromisoformat(d), "1-URGENT") for i, d in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        whole = spark.read.parquet(folder + "/orders.parquet").selectExpr("o_orderkey", "CAST(o_custkey AS STRING)", "o_orderpriority")
        assert sorted(one(registry.QUERIES["yearly_files"](spark, folder))) == sorted(one(whole))


def test_source_queries_use_their_operators(spark, monkeypatch):
    docs, used = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name in ("read_json_records", "read_keyed_json", "write_with_metadata"):
        monkeypatch.setattr(tables, name, lambda *a, f=getattr(tables, name), **kw: used.append(f.__name__) or f(*a, **kw))
    monkeypatch.setattr(study_queries, "FILE_ROWS", 30)
    run = lambda q: sorted(one(registry.QUERIES[q](spark, "/root/testdata/sf0.001")), key=repr)
    assert run("json_records") == sorted(one(docs.select("doc_id", "lang")), key=repr)
    assert run("keyed_json") == sorted(one(docs.selectExpr("CAST(doc_id AS STRING)", "lang", "source")), key=repr)
    run("yearly_files")
    assert used == ["read_json_records", "read_keyed_json", "write_with_metadata"]


def test_grid_saves_its_best_model(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(models.TextModel, "save", lambda self, path, f=models.TextModel.save: saved.append(path) or f(self, path))
    first, *runs = one(registry.QUERIES["text_model_grid"](spark, "/root/testdata/sf0.001"))
    assert len(runs) == 9 and all(r[3] >= 0.15 or r[2] <= first[2] for r in runs)
    assert first in runs and first[3] < 0.15 and spark.read.text(saved[0] + "/stages/metadata").count() == 1 and 0 < spark.read.parquet(saved[0] + "/vocabulary").count() <= 2000


def test_scores_are_clipped(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(float(i), float(i)) for i in range(-5, 5)], "x double, y double"))
    seen = []
    models.run_experiments(df, df, {"m": models.linear("ridge", 0.0, 10, labelCol="y")}, lambda d: seen.append(d.agg(F.min("predicted")).first()[0]) or 0.0, models.score)
    assert seen == [0.1, 0.1]


def test_labels_on_a_stream(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-03 10:00:00' AS ts").write.parquet(str(tmp_path / "in"))
    stream = labelled(spark.readStream.schema("ts timestamp_ntz").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("labelled_events").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert one(spark.sql("SELECT session FROM labelled_events")) == [("market_hours",)]


def dates(spark, days, name="filing_date"):
    return spark.createDataFrame([(None if d is None else dt.date(2024, 1, 1) + dt.timedelta(days=d),) for d in days], f"{name} date")


def test_lookups_outside_the_calendar(spark):
    cal = market.calendar(dates(spark, [10, 12, 20], "day"))
    day = lambda d: (d - dt.date(2024, 1, 1)).days if d else None
    near = market.asof_nearest(dates(spark, [0, 9, 10, 11, 15, 16, 17, 20, 40, None]), cal, "filing_date").collect()
    assert {(day(r["filing_date"]), day(r["nearest_day"])) for r in near} == {(0, 10), (9, 10), (10, 10), (11, 12), (15, 12), (16, 20), (17, 20), (20, 20), (40, 20), (None, None)}
    bench = dates(spark, [10, 12, 20], "day").withColumn("close", F.dayofmonth("day").cast("double"))
    levels = market.level_asof(dates(spark, [9, 10, 15, 16, 17, 20, 24, 25, None]), bench, cal, lookback=4).collect()
    assert {(day(r["filing_date"]), r["level"]) for r in levels} == {(9, None), (10, 11.0), (15, 13.0), (16, 13.0), (17, None), (20, 21.0), (24, 21.0), (25, None), (None, None)}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof_over_months(spark, by):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    series = [("a", d(0), 1.0), ("a", d(40), 2.0), ("a", d(41), None), ("a", d(200), 3.0)] + ([("b", d(5), 9.0)] if by else [])
    events = [("a", d(n)) for n in (-1, 0, 39, 40, 70, 199, 200, 300)] + ([("b", d(0)), ("b", d(90)), ("c", d(90))] if by else [])
    s, e = spark.createDataFrame(series, "k string, day date, v double"), spark.createDataFrame(events, "k string, day date")
    for tolerance in (None, 35):
        got = {(r["k"], r["day"], r["asof_value"]) for r in market.asof_backward(e, s, "day", "v", by, tolerance).collect()}
        want = set()
        for k, at in events:
            seen = [x for x in series if (not by or x[0] == k) and x[1] <= at and x[2] is not None]
            want.add((k, at, seen[-1][2] if seen and (tolerance is None or (at - seen[-1][1]).days <= tolerance) else None))
        assert got == want


def test_next_bar_is_later_and_near(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    bars = [("a", at(1, 9), 1.0), ("a", at(1, 12), 2.0), ("a", at(1, 12), 1.5), ("a", at(3, 1), 3.0), ("b", at(1, 10), 4.0)]
    events = [("a", at(1, 8)), ("a", at(1, 9)), ("a", at(1, 12)), ("a", at(2, 0)), ("a", at(3, 1)), ("b", at(1, 9)), ("c", at(1, 9))]
    df = market.next_intraday_bar(spark.createDataFrame(events, "k string, ts timestamp_ntz"), spark.createDataFrame(bars, "k string, ts timestamp_ntz, value double"), "k")
    got = {(r["k"], r["ts"]): (r["bar_ts"], r["bar_value"]) for r in df.collect()}
    none = (None, None)
    assert got == {("a", at(1, 8)): (at(1, 9), 1.0), ("a", at(1, 9)): (at(1, 12), 1.5), ("a", at(1, 12)): none, ("a", at(2, 0)): (at(3, 1), 3.0), ("a", at(3, 1)): none, ("b", at(1, 9)): (at(1, 10), 4.0), ("c", at(1, 9)): none}


def test_quantiles_of_groups(spark):
    rows = [("a", float(x % 7)) for x in range(50)] + [("b", 3.0), ("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r["key"]["g"]: r["e"] for r in ranking.quantiles(df, "v", points, ["g"]).collect()}
    want = {r["g"]: r["e"] for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", points).alias("e")).collect()}
    assert set(got) == {"a", "b", None} and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ranking.quantiles(df, "v", [0.5]).first()["e"] == [pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])]
    stats = {r["g"]: r["median"] for r in metrics.return_stats(df, "v", ["g"]).collect()}
    assert stats == {"a": pytest.approx(want["a"][3]), "b": 3.0, "c": None, None: 1.5}


def test_answers_of_all_tasks(spark):
    rows = [(1, t, "success", "{}") for t in responses.TASKS] + [(2, t, "error", None) for t in responses.TASKS] + [(3, "salience", "success", '{"salience_score": 0.9, "uncertainty_level": "low"}')]
    got = {r["id"]: r.asDict() for r in responses.assemble_features(spark.createDataFrame(rows, "id long, task string, status string, response string"), "id", list(responses.TASKS)).collect()}
    assert len(got[1]) == 25 and got[1]["business_impact"] == "unclear" and got[1]["event_type"] == "continuous"
    assert got[2]["uncertainty_level"] == "high" and got[2]["event_type"] == "error" and got[2]["salience_score"] == 0.5
    assert (got[3]["salience_score"], got[3]["uncertainty_level"], got[3]["time_horizon"], got[3]["tone_score"]) == (0.9, "low", "short_term", None)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 3, h),) for h in (5, 10, 11, 17)] + [(dt.datetime(2024, 1, 4, 10),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    stream = session_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted_events").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["window"]["start"])[:10], r["session"], r["count"]) for r in spark.table("counted_events").collect()}
    assert got == {("2024-01-03", "pre_market", 1), ("2024-01-03", "market_hours", 2), ("2024-01-03", "after_hours", 1), ("2024-01-04", "market_hours", 1)}
