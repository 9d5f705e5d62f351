"""Queries on events, bars, labels, joins and aggregate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import joins, metrics, ranking
from eventloom.sources import tables
from eventloom.sources.resume import ResultStore

from . import market
from .fixtures import Inputs
from .registry import query, rounded


def adjusted(t: Inputs) -> DataFrame:
    return market.forward_return(t.filings, t.bars, t.benchmark_days)


@query(
    "SELECT coalesce(sector, 'OVERALL') AS sector, count(*) AS n, count(*) FILTER (r > 0) AS ups, count(*) FILTER (NOT r > 0) AS downs, round(greatest(count(*) FILTER (r > 0), count(*) FILTER (NOT r > 0)) / count(*) * 100, 6) AS baseline FROM (SELECT c.c_mktsegment AS sector, round(stock - market, 4) AS r FROM returns JOIN customer c ON c.c_custkey = user_id WHERE c.c_mktsegment IS NOT NULL) GROUP BY ROLLUP (sector)",
    "returns",
)
def sector_baselines(t: Inputs) -> DataFrame:
    """Flagship: how often events of each sector beat the market over five trading days."""
    sectors = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("position"))
    labelled = joins.add_lookup(adjusted(t), sectors, "user_id", ["sector"], "position").withColumn("label", market.classification_targets(F.col("adjusted_return_pct"))["binary_label"])
    return rounded(metrics.group_baselines(labelled, "sector", "label"))


@query("SELECT session, count(*) AS n FROM filings GROUP BY 1", "filings")
def session_counts(t: Inputs) -> DataFrame:
    """D1, E30."""
    return metrics.session_counts(t.filings, "session")


@query("SELECT accession, strptime(stamp, '%Y%m%d%H%M%S') AS accepted FROM (SELECT event_id AS accession, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events)")
def accept_times(t: Inputs) -> DataFrame:
    """D2 on headers made of the events' own times."""
    header = F.concat(F.lit("HEADER\n<ACCEPTANCE-DATETIME>"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("\nBODY"))
    return t.events.select(F.col("event_id").alias("accession"), market.accept_ts(header).cast("timestamp_ntz").alias("accepted"))


@query("SELECT e.accession, e.session, d.day AS entry_date FROM entries e LEFT JOIN cal d ON d.idx = e.entry_idx", "entries")
def entry_days(t: Inputs) -> DataFrame:
    """C7, D3."""
    return market.entry_day(t.filings, market.calendar(t.benchmark_days)).select("accession", "session", "entry_date")


@query("SELECT e.accession, d.day AS exit_date FROM entries e JOIN cal d ON d.idx = e.entry_idx + 4", "entries")
def exit_days(t: Inputs) -> DataFrame:
    """C9."""
    cal = market.calendar(t.benchmark_days)
    return market.plus_trading_days(market.entry_day(t.filings, cal), cal, 4, "entry_idx", "exit_date").select("accession", "exit_date")


@query("SELECT f.accession, p.day AS prev_day FROM filings f LEFT JOIN cal c ON c.day = f.filing_date LEFT JOIN cal p ON p.idx = c.idx - 1", "filings", "cal")
def previous_days(t: Inputs) -> DataFrame:
    """C10."""
    return market.prev_trading_day(t.filings, market.calendar(t.benchmark_days), "filing_date").select("accession", "prev_day")


_WEEKLY = "(SELECT day FROM cal WHERE isodow(day) = 1)"


def _weekly(t: Inputs) -> DataFrame:
    """A sparse calendar: the first days of weeks."""
    return market.calendar(market.calendar(t.benchmark_days).filter(F.weekday("day") == 0))


@query(f"SELECT f.accession, CASE WHEN f.filing_date - s.day <= 4 THEN s.close END AS asof_value FROM filings f ASOF LEFT JOIN (SELECT b.ticker, b.day, b.close FROM bars b JOIN {_WEEKLY} c ON c.day = b.day) s ON f.ticker = s.ticker AND f.filing_date >= s.day", "filings", "bars", "cal")
def asof_backward(t: Inputs) -> DataFrame:
    """C6 on weekly closes that hold for four days."""
    series = t.bars.join(_weekly(t).select("day"), "day").withColumnRenamed("day", "filing_date")
    return market.asof_backward(t.filings.select("accession", "ticker", "filing_date"), series, "filing_date", "close", ["ticker"], 4).select("accession", "asof_value")


@query(f"SELECT f.accession, CASE WHEN f.filing_date - s.day <= 4 THEN s.close END AS level FROM filings f ASOF LEFT JOIN (SELECT b.day, b.close FROM bench b JOIN {_WEEKLY} c ON c.day = b.day) s ON f.filing_date >= s.day", "filings", "bench", "cal")
def benchmark_levels(t: Inputs) -> DataFrame:
    """D6 on weekly closes that hold for four days, also past the last of them."""
    return market.level_asof(t.filings, t.benchmark_days, _weekly(t), lookback=4).select("accession", "level")


@query(f"SELECT accession, nearest_day FROM (SELECT f.accession, c.day AS nearest_day, row_number() OVER (PARTITION BY f.accession ORDER BY abs(c.day - f.filing_date), c.day DESC) AS k FROM filings f CROSS JOIN {_WEEKLY} c) WHERE k = 1", "filings", "cal")
def nearest_days(t: Inputs) -> DataFrame:
    """C8 on a weekly calendar, also before its first and after its last day."""
    return market.asof_nearest(t.filings, _weekly(t), "filing_date").select("accession", "nearest_day")


@query("SELECT f.accession, CASE WHEN s.ts < CAST(f.ts AS DATE) + 2 THEN s.ts END AS bar_ts, CASE WHEN s.ts < CAST(f.ts AS DATE) + 2 THEN s.value END AS bar_value FROM filings f ASOF LEFT JOIN (SELECT event_type AS ticker, ts, min(value) AS value FROM events GROUP BY ALL) s ON f.ticker = s.ticker AND f.ts < s.ts", "filings")
def intraday_bars(t: Inputs) -> DataFrame:
    """C11: all events as filings and as bars."""
    bars = t.events.select(F.col("event_type").alias("ticker"), "ts", "value")
    return market.next_intraday_bar(t.filings.select("accession", "ticker", "ts"), bars, "ticker").select("accession", "bar_ts", "bar_value")


@query("SELECT accession, entry_date, exit_date, round(stock, 4) AS stock_return_pct, round(market, 4) AS market_return_pct, round(stock - market, 4) AS adjusted_return_pct FROM returns", "returns")
def forward_returns(t: Inputs) -> DataFrame:
    """C13, D4."""
    return adjusted(t).select("accession", "entry_date", "exit_date", "stock_return_pct", "market_return_pct", "adjusted_return_pct")


_CLOSE = "SELECT accession, round(s, 3) AS stock_return_pct, round(m, 3) AS market_return_pct, round(s - m, 3) AS adjusted_return_pct, CAST(s > m AS INT) AS outperformed_market FROM (SELECT f.accession, (b5.close - b0.close) / b0.close * 100 AS s, (m5.close - m0.close) / m0.close * 100 AS m FROM filings f JOIN cal c0 ON c0.idx = (SELECT min(idx) FROM cal WHERE day {op} f.filing_date) JOIN cal c5 ON c5.idx = c0.idx + 4 JOIN bars b0 ON b0.ticker = f.ticker AND b0.day = c0.day JOIN bars b5 ON b5.ticker = f.ticker AND b5.day = c5.day JOIN bench m0 ON m0.day = c0.day JOIN bench m5 ON m5.day = c5.day)"
_CLOSE_COLUMNS = ("accession", "stock_return_pct", "market_return_pct", "adjusted_return_pct", "outperformed_market")


@query(_CLOSE.format(op=">="), "filings", "bars", "bench", "cal")
def close_returns(t: Inputs) -> DataFrame:
    """D8, from the filing day on."""
    return market.close_return(t.filings, t.bars, t.benchmark_days).select(*_CLOSE_COLUMNS)


@query(_CLOSE.format(op=">"), "filings", "bars", "bench", "cal")
def close_returns_strict(t: Inputs) -> DataFrame:
    """D8, after the filing day."""
    return market.close_return(t.filings, t.bars, t.benchmark_days, strict=True).select(*_CLOSE_COLUMNS)


def _momentum_sql(days: list[int]) -> str:
    one = lambda d, table, on: f"(SELECT CASE WHEN count(*) >= 2 THEN (arg_max(close, day) - arg_min(close, day)) / arg_min(close, day) * 100 END FROM {table} WHERE {on} day < f.filing_date AND day >= f.filing_date - {d + 10})"
    return "SELECT f.accession, " + ", ".join(f"round({one(d, 'bars', 'bars.ticker = f.ticker AND')} - {one(d, 'bench', '')}, 2) AS momentum_{d}d" for d in days) + " FROM filings f"


@query(_momentum_sql([7, 30, 90, 365]), "filings", "bars", "bench")
def momentum(t: Inputs) -> DataFrame:
    """C12, D5."""
    out = market.momentum(t.filings, t.bars, t.benchmark_days, [7, 30, 90, 365])
    return out.select("accession", *[f"momentum_{d}d" for d in (7, 30, 90, 365)])


@query(
    "SELECT accession, CASE WHEN s IS NOT NULL AND m IS NOT NULL THEN kind END AS reaction_type, round(s - m, 4) AS immediate_reaction_pct, CASE WHEN m IS NOT NULL THEN round(s, 4) END AS stock_reaction_pct, CASE WHEN s IS NOT NULL THEN round(m, 4) END AS market_reaction_pct FROM (SELECT e.accession, CASE WHEN session IN ('after_hours', 'overnight') THEN 'overnight_gap' WHEN session = 'market_hours' THEN 'intraday_move' ELSE 'open_gap' END AS kind, CASE WHEN session IN ('after_hours', 'overnight') THEN (be.open - bl.close) / bl.close * 100 WHEN session = 'market_hours' THEN (bl.close - bl.open) / bl.open * 100 ELSE (bl.open - bp.close) / bp.close * 100 END AS s, CASE WHEN session IN ('after_hours', 'overnight') THEN (me.open - ml.close) / ml.close * 100 WHEN session = 'market_hours' THEN (ml.close - ml.open) / ml.open * 100 ELSE (ml.open - mp.close) / mp.close * 100 END AS m FROM entries e LEFT JOIN cal ce ON ce.idx = e.entry_idx LEFT JOIN cal cl ON cl.day = e.filing_date LEFT JOIN cal cp ON cp.idx = cl.idx - 1 LEFT JOIN bars be ON be.ticker = e.ticker AND be.day = ce.day LEFT JOIN bars bl ON bl.ticker = e.ticker AND bl.day = cl.day LEFT JOIN bars bp ON bp.ticker = e.ticker AND bp.day = cp.day LEFT JOIN bench me ON me.day = ce.day LEFT JOIN bench ml ON ml.day = cl.day LEFT JOIN bench mp ON mp.day = cp.day)",
    "entries", "bars",
)
def immediate_reactions(t: Inputs) -> DataFrame:
    """D7."""
    return market.immediate_reaction(t.filings, t.bars, t.benchmark_days).select("accession", "reaction_type", "immediate_reaction_pct", "stock_reaction_pct", "market_reaction_pct")


@query("SELECT count(*) AS n, count(r.accession) AS with_outcome FROM filings f LEFT JOIN returns r ON r.accession = f.accession", "filings", "returns")
def attached_outcomes(t: Inputs) -> DataFrame:
    """D9."""
    outcomes = adjusted(t).select("accession", "adjusted_return_pct")
    return market.attach_outcomes(t.filings, outcomes, "accession").agg(F.count("*").alias("n"), F.count("adjusted_return_pct").alias("with_outcome"))


_R = "(SELECT f.accession, round(stock - market, 4) AS r FROM filings f LEFT JOIN returns USING (accession))"


@query(f"SELECT accession, CAST(coalesce(r > 0, false) AS INT) AS binary_label, CASE WHEN r < -1 THEN 0 WHEN r > 1 THEN 2 ELSE 1 END AS three_label, CASE WHEN coalesce(r > 0, false) THEN 'UP' ELSE 'DOWN' END AS binary_text, CASE WHEN r < -1 THEN 'DOWN' WHEN r > 1 THEN 'UP' ELSE 'STAY' END AS three_text, CASE WHEN r IS NULL THEN NULL WHEN r > 1 THEN 'UP' WHEN r < -1 THEN 'DOWN' ELSE 'STAY' END AS signal FROM {_R}", "filings", "returns")
def event_labels(t: Inputs) -> DataFrame:
    """D10, D11 (N1, N2, N3)."""
    r = F.col("adjusted_return_pct")
    rows = market.attach_outcomes(t.filings.select("accession"), adjusted(t).select("accession", "adjusted_return_pct"), "accession")
    return rows.withColumns(market.classification_targets(r) | {"signal": market.signal(r)}).drop("adjusted_return_pct")


@query("SELECT id, CASE WHEN ret > 4 THEN 'STRONG_POSITIVE' WHEN ret > 2 THEN 'POSITIVE' WHEN ret < -4 THEN 'STRONG_NEGATIVE' ELSE 'NEGATIVE' END AS impact, CASE WHEN abs(ret) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS impact_confidence, round(abs(ret), 6) AS abs_return, round(ln(1 + abs(ret)), 6) AS log_abs_return, round(ret * ret, 6) AS squared_return FROM preds WHERE abs(ret) > 2", "preds")
def impact_levels(t: Inputs) -> DataFrame:
    """D12, D13."""
    r = F.col("ret")
    rows = t.predictions.filter(F.abs("ret") > 2)
    return rounded(rows.select("id", *[c.alias(n) for n, c in (market.impact_level(r, 2.0) | market.volatility_targets(r)).items()]))


@query("SELECT id, CAST(abs(ret) > (SELECT quantile_cont(abs(ret), 0.75) FROM preds WHERE date < DATE '1999-01-01') AS INT) AS high, CAST(v >= p[1] AS INT) + CAST(v >= p[2] AS INT) AS tertile FROM (SELECT *, abs(ret) AS v, (SELECT quantile_cont(abs(ret), [0.33, 0.67]) FROM preds) AS p FROM preds)", "preds")
def volatility_flags(t: Inputs) -> DataFrame:
    """D14 with the training threshold, D15."""
    rows = t.predictions.withColumn("v", F.abs("ret"))
    flagged = ranking.above_quantile(rows, "v", 0.75, rows.filter("date < DATE '1999-01-01'"))
    return ranking.vol_tertiles(flagged, "v").select("id", "high", "tertile")


# joins and set operations


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def merged_summaries(t: Inputs) -> DataFrame:
    """C1."""
    return joins.merge_on(t.documents, t.labels, "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT o.o_orderkey, c.c_mktsegment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def with_sector(t: Inputs) -> DataFrame:
    """C2, N10."""
    dimension = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.add_lookup(t.orders, dimension, "o_custkey", ["c_mktsegment"], "c_nationkey").select("o_orderkey", "c_mktsegment")


@query("SELECT d.doc_id, x.text FROM documents d JOIN (SELECT conv_id AS doc_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) x USING (doc_id)")
def first_labels(t: Inputs) -> DataFrame:
    """C3, N11."""
    first = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return joins.attach_labels(t.documents.select("doc_id"), first, "doc_id", "turn").select("doc_id", "text")


@query("SELECT i.filing, i.pos, substr(coalesce(x.text, ''), 1, 8) AS text FROM items i LEFT JOIN (SELECT filing, pos, text FROM items WHERE pos <= 2) x ON x.filing = i.filing AND x.pos = i.pos", "items")
def items_with_text(t: Inputs) -> DataFrame:
    """C4."""
    return joins.items_with_text(t.items.drop("text"), t.items.filter("pos <= 2"), ["filing", "pos"], "text", 8).select("filing", "pos", "text")


@query("SELECT count(*) AS n, count(*) FILTER (o_custkey % 2 = 0) AS matched, count(*) FILTER (o_custkey % 2 = 1) AS unmatched FROM orders")
def lineage(t: Inputs) -> DataFrame:
    """C5."""
    return joins.verify_lineage(t.orders, t.orders.filter("o_custkey % 2 = 0"), ["o_custkey", "o_orderdate"])


@query("SELECT a.k AS position, a.id, b.filing FROM (SELECT id, row_number() OVER (ORDER BY date, id) - 1 AS k FROM preds) a JOIN (SELECT filing, pos, row_number() OVER (ORDER BY filing, pos) - 1 AS k FROM items) b USING (k)", "preds", "items")
def zipped(t: Inputs) -> DataFrame:
    """C14: the n-th prediction in time beside the n-th item."""
    return joins.zip_by_position(t.predictions.select("id", "date"), t.items.select("filing", "pos"), ["date", "id"], ["filing", "pos"]).select("position", "id", "filing")


@query("SELECT a.g AS grp, round(a.m, 6) AS a, round(b.m, 6) AS b, round(b.m - a.m, 6) AS difference, CASE WHEN a.m > b.m THEN 'first' WHEN b.m > a.m THEN 'second' ELSE 'tie' END AS winner FROM (SELECT grp AS g, avg(CAST(up = said AS INT)) AS m FROM preds WHERE id % 2 = 0 GROUP BY 1) a JOIN (SELECT grp AS g, avg(CAST(up = said AS INT)) AS m FROM preds WHERE id % 2 = 1 GROUP BY 1) b ON a.g = b.g", "preds")
def model_comparison(t: Inputs) -> DataFrame:
    """C16."""
    side = lambda k: t.predictions.filter(f"id % 2 = {k}").groupBy("grp").agg(F.avg((F.col("up") == F.col("said")).cast("int")).alias("m"))
    return rounded(joins.compare_models(side(0), side(1), "grp", "m"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_restricted(t: Inputs) -> DataFrame:
    """C17."""
    return joins.restricted(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id")


@query("SELECT doc_id, lang, NULL::BIGINT AS item_id FROM documents UNION ALL SELECT NULL, NULL, item_id FROM benchmark")
def stacked_tables(t: Inputs) -> DataFrame:
    """G1."""
    return joins.stacked(t.documents.select("doc_id", "lang"), t.benchmark.select("item_id"))


@query("SELECT cls, w AS \"where\" FROM (SELECT cls, CASE WHEN bool_or(a) AND bool_or(NOT a) THEN 'both' WHEN bool_or(a) THEN 'first' ELSE 'second' END AS w FROM (SELECT DISTINCT cust % 10 AS cls, true AS a FROM preds WHERE cust % 10 < 7 UNION ALL SELECT DISTINCT cust % 10, false FROM preds WHERE cust % 10 > 3) GROUP BY cls)", "preds")
def label_sets(t: Inputs) -> DataFrame:
    """G2, G3."""
    rows = t.predictions.select((F.col("cust") % 10).alias("cls"))
    return joins.label_sets(rows.filter("cls < 7"), rows.filter("cls > 3"), "cls")


@query("SELECT id, coalesce(a.x, 0.0) AS x, coalesce(b.y, 0.0) AS y FROM (SELECT id, score AS x FROM preds WHERE id % 3 < 2) a FULL JOIN (SELECT id, prob AS y FROM preds WHERE id % 3 > 0) b USING (id)", "preds")
def candidate_union(t: Inputs) -> DataFrame:
    """G4."""
    p = t.predictions
    return joins.candidate_union(p.filter("id % 3 < 2").select("id", F.col("score").alias("x")), p.filter("id % 3 > 0").select("id", F.col("prob").alias("y")), ["id"], "x", "y")


@query("SELECT filing, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM items GROUP BY 1", "items")
def distinct_codes(t: Inputs) -> DataFrame:
    """G5."""
    return joins.distinct_codes(t.items, "filing", "code").withColumn("codes", F.array_join("codes", ","))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def remaining_rows(t: Inputs) -> DataFrame:
    """A10."""
    return tables.remaining(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def resumed_rows(t: Inputs) -> DataFrame:
    """A10 with committed batches (of two states) and their filters; a batch of the third broke off before its filter and counts for nothing."""
    store = ResultStore(t.spark, tables.scratch(t.spark) + "-results", "o_orderkey")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    for state in ("F", "O"):
        store.commit(orders.filter(F.col("o_orderstatus") == state), state)
    orders.filter("o_orderstatus = 'P'").write.parquet(store.path + "/rows/batch=P")
    return store.remaining(orders).select("o_orderkey")


@query("SELECT accession, entry_date, exit_date, round(stock, 4) AS stock_return_pct, round(market, 4) AS market_return_pct, round(stock - market, 4) AS adjusted_return_pct FROM returns", "returns")
def bucketed_returns(t: Inputs) -> DataFrame:
    """C13, D4 over bars that are stored in buckets: no exchange of bars."""
    path = tables.scratch(t.spark) + "-bars"
    bars = market.bucketed_bars(t.bars, path.rpartition("/")[2].replace("-", "_"), path)
    out = market.forward_return(t.filings, bars, t.benchmark_days)
    return out.select("accession", "entry_date", "exit_date", "stock_return_pct", "market_return_pct", "adjusted_return_pct")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def successful_rows(t: Inputs) -> DataFrame:
    """A11."""
    return tables.successful(t.orders, ["o_orderkey", "o_totalprice"], "o_orderstatus", "F")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def complete_rows(t: Inputs) -> DataFrame:
    """A9."""
    return tables.complete_rows(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality").select("doc_id")


@query("SELECT c_mktsegment, lpad(CAST(arg_max(c_custkey, c_custkey) AS VARCHAR), 10, '0') AS padded_id FROM customer GROUP BY 1")
def padded_ids(t: Inputs) -> DataFrame:
    """A6."""
    return tables.id_map(t.customer, "c_mktsegment", "c_custkey", "c_custkey")


@query("SELECT l_orderkey AS cik, l_returnflag AS form, strftime(l_shipdate, '%Y-%m-%d') AS filing_date, CAST(l_partkey AS VARCHAR) AS accession FROM lineitem WHERE l_returnflag = 'A' AND year(l_shipdate) = 1998")
def submissions(t: Inputs) -> DataFrame:
    """A5 on arrays collected from line items."""
    row = F.struct(F.col("l_returnflag").alias("form"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("filingDate"), F.col("l_partkey").cast("string").alias("accessionNumber"))
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("cik")).agg(F.collect_list(row).alias("x"))
    packed = docs.select("cik", F.struct(*[F.col(f"x.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber")]).alias("recent"))
    return tables.explode_submissions(packed, "A", 1998)


# aggregates


@query("SELECT filing, array_to_string(list_sort(list(DISTINCT code) FILTER (code <> 'MIXED')), ',') AS items_present, CAST(greatest(count(DISTINCT code) FILTER (code <> 'MIXED'), 1) AS INT) AS item_count, string_agg('[ITEM ' || code || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS text, arg_min(part, pos) AS part FROM items GROUP BY 1", "items")
def merged_items(t: Inputs) -> DataFrame:
    """E1."""
    out = metrics.merge_items(t.items, "filing", "pos", "code", "text", ["part"]).drop("items")
    return out.withColumn("items_present", F.nullif("items_present", F.lit("")))


@query("SELECT grp, cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM preds WHERE cls IS NOT NULL GROUP BY 1, 2", "preds")
def class_counts(t: Inputs) -> DataFrame:
    """E2, N5."""
    return rounded(metrics.value_counts(t.predictions, "cls", ["grp"]))


@query("SELECT grp, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(min(ret), 6) AS min, round(max(ret), 6) AS max, round(quantile_cont(ret, 0.5), 6) AS median FROM preds GROUP BY 1", "preds")
def return_stats(t: Inputs) -> DataFrame:
    """E3, N6, N7."""
    return rounded(metrics.return_stats(t.predictions, "ret", ["grp"]))


@query("SELECT count(*) AS n, count(DISTINCT filing) AS filings, round(count(*) / count(DISTINCT filing), 6) AS per_filing FROM items", "items")
def item_stats(t: Inputs) -> DataFrame:
    """E4."""
    return rounded(metrics.item_stats(t.items, "filing"))


@query("SELECT code, count(*) AS n, round(count(*) / (SELECT count(*) FROM items), 6) AS share FROM items GROUP BY 1 ORDER BY n DESC, code LIMIT 10", "items")
def code_shares(t: Inputs) -> DataFrame:
    """E4, the most frequent codes."""
    return rounded(metrics.code_shares(t.items, "code"))


@query("SELECT round(count(quality) / count(*), 6) AS quality, round(count(lang) / count(*), 6) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def label_coverage(t: Inputs) -> DataFrame:
    """E5."""
    return rounded(metrics.coverage(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang"]))


@query("SELECT * FROM (SELECT 'overall' AS section, name, round(value, 6) AS value FROM (SELECT count(*)::DOUBLE AS rows, avg(ret) AS mean, min(ret) AS min, max(ret) AS max, count(DISTINCT date)::DOUBLE AS days FROM preds) UNPIVOT (value FOR name IN (rows, mean, min, max, days))) UNION ALL (SELECT 'top', grp, count(*)::DOUBLE FROM preds GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 10)", "preds")
def dataset_summary(t: Inputs) -> DataFrame:
    """E6."""
    return rounded(metrics.dataset_summary(t.predictions, "ret", "date", "grp"))


@query("SELECT grp, CASE WHEN sum(up) >= count(*) - sum(up) THEN 'UP' ELSE 'DOWN' END AS binary_class, round(greatest(sum(up), count(*) - sum(up)) / count(*), 6) AS binary_accuracy, CASE WHEN u = greatest(u, d, s) THEN 'UP' WHEN d = greatest(u, d, s) THEN 'DOWN' ELSE 'STAY' END AS three_class, round(greatest(u, d, s) / count(*), 6) AS three_accuracy FROM (SELECT *, count(*) FILTER (three = 2) OVER (PARTITION BY grp) AS u, count(*) FILTER (three = 0) OVER (PARTITION BY grp) AS d, count(*) FILTER (three = 1) OVER (PARTITION BY grp) AS s FROM preds) GROUP BY grp, u, d, s", "preds")
def majority_baselines(t: Inputs) -> DataFrame:
    """E7."""
    return rounded(metrics.majority_baseline(t.predictions, "up", "three", "grp"))


@query("SELECT round(avg(CAST(ret > 0 AS INT)), 6) AS positive, round(avg(CAST(ret < 0 AS INT)), 6) AS negative, round(avg(CAST(abs(ret) <= 1 AS INT)), 6) AS within_one, round(quantile_cont(ret, 0.1), 6) AS p10, round(quantile_cont(ret, 0.25), 6) AS p25, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.75), 6) AS p75, round(quantile_cont(ret, 0.9), 6) AS p90 FROM preds", "preds")
def return_distribution(t: Inputs) -> DataFrame:
    """E8."""
    return rounded(metrics.return_distribution(t.predictions, "ret"))


@query("SELECT grp, n, round(100 * hit, 6) AS accuracy, round(100 * greatest(o, 1 - o), 6) AS baseline, round(100 * hit - 100 * greatest(o, 1 - o), 6) AS over_own, round(100 * hit - 52, 6) AS over_fixed FROM (SELECT grp, count(*) AS n, avg(CAST(up = said AS INT)) AS hit, avg(up) AS o FROM preds GROUP BY 1) WHERE n >= 10", "preds")
def group_accuracy(t: Inputs) -> DataFrame:
    """E10, E19."""
    return rounded(metrics.accuracy_by(t.predictions, "grp", "up", "said", 10))


@query("SELECT cls, count(*) AS n, count(*) FILTER (up = said) AS correct, round(count(*) FILTER (up = said) / count(*), 6) AS accuracy, count(*) FILTER (said = 0) AS said_0, count(*) FILTER (said = 1) AS said_1 FROM preds GROUP BY 1", "preds")
def event_accuracy(t: Inputs) -> DataFrame:
    """E11."""
    return rounded(metrics.event_accuracy(t.predictions, "cls", "up", "said", [0, 1]))


_BY_CUSTOMER = "(SELECT cust, count(*) AS n, count(*) FILTER (up = said) AS correct, count(*) FILTER (up = said) / count(*) AS accuracy, count(*) FILTER (said = 0) AS said_0, count(*) FILTER (said = 1) AS said_1 FROM preds GROUP BY 1)"


@query(f"SELECT cust, n, correct, round(accuracy, 6) AS accuracy, said_0, said_1, side FROM (SELECT *, 'best' AS side, row_number() OVER (ORDER BY accuracy DESC, cust) AS k FROM {_BY_CUSTOMER} UNION ALL SELECT *, 'worst', row_number() OVER (ORDER BY accuracy, cust) FROM {_BY_CUSTOMER}) WHERE k <= 5", "preds")
def extreme_groups(t: Inputs) -> DataFrame:
    """E11, the five groups with the best and the worst accuracy."""
    return rounded(metrics.best_and_worst(metrics.event_accuracy(t.predictions, "cust", "up", "said", [0, 1]), "accuracy", "cust"))


@query("SELECT four, count(*) FILTER (said_four = 0) AS \"0\", count(*) FILTER (said_four = 1) AS \"1\", count(*) FILTER (said_four = 2) AS \"2\", count(*) FILTER (said_four = 3) AS \"3\" FROM preds GROUP BY 1", "preds")
def confusion_matrix(t: Inputs) -> DataFrame:
    """E12."""
    return metrics.confusion(t.predictions, "four", "said_four", [0, 1, 2, 3])


_REPORT = "SELECT class, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, tp + fn AS support FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (SELECT class, count(*) FILTER (three = class AND said2 = class) AS tp, count(*) FILTER (three <> class AND said2 = class) AS fp, count(*) FILTER (three = class AND said2 <> class) AS fn, count(*) FILTER (three <> class AND said2 <> class) AS tn FROM (SELECT three, said * 2 AS said2 FROM preds) CROSS JOIN (VALUES (0), (1), (2)) v(class) GROUP BY 1))"


@query(_REPORT, "preds")
def class_report(t: Inputs) -> DataFrame:
    """E13."""
    return rounded(metrics.class_report(t.predictions.withColumn("s", F.col("said") * 2), "three", "s", [0, 1, 2]))


@query(f"SELECT round(sum(precision * support) / sum(support), 5) AS precision, round(sum(recall * support) / sum(support), 5) AS recall, round(sum(f1 * support) / sum(support), 5) AS f1 FROM ({_REPORT})", "preds")
def weighted_report(t: Inputs) -> DataFrame:
    """E13, averages weighted by support."""
    return rounded(metrics.weighted_report(metrics.class_report(t.predictions.withColumn("s", F.col("said") * 2), "three", "s", [0, 1, 2])), 5)


@query("SELECT round((sum(r) FILTER (up = 1) - count(*) FILTER (up = 1) * (count(*) FILTER (up = 1) + 1) / 2) / (count(*) FILTER (up = 1) * count(*) FILTER (up = 0)), 6) AS auc FROM (SELECT up, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS r FROM preds)", "preds")
def roc_auc(t: Inputs) -> DataFrame:
    """E14."""
    return rounded(metrics.roc_auc(t.predictions, "up", "prob"))


_RANKS = "(SELECT *, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2 AS ra, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rp FROM preds)"


@query(f"SELECT count(*) AS n, round(corr(ret, score), 6) AS pearson, round(corr(ra, rp), 6) AS spearman, round(avg(abs(ret - score)), 6) AS mae, round(avg((ret - score) ** 2), 6) AS mse, round(1 - avg((ret - score) ** 2) / var_pop(ret), 6) AS r2, round(sqrt(avg((ret - score) ** 2)), 6) AS rmse FROM {_RANKS}", "preds")
def regression_metrics(t: Inputs) -> DataFrame:
    """E15, F9."""
    return rounded(metrics.regression_metrics(t.predictions, "ret", "score"))


_SPLITS = "(SELECT CASE WHEN date < DATE '1998-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split, count(*) AS n, corr(ret, score) AS pearson, 1 - avg((ret - score) ** 2) / var_pop(ret) AS r2, avg(abs(ret - score)) AS mae, sqrt(avg((ret - score) ** 2)) AS rmse FROM preds GROUP BY 1)"


@query(f"SELECT s.split, s.n, " + ", ".join(f"round(s.{c}, 6) AS {c}, round(t.{c} - s.{c}, 6) AS {c}_gap" for c in ("pearson", "r2", "mae", "rmse")) + f" FROM {_SPLITS} s, {_SPLITS} t WHERE t.split = 'train'", "preds")
def regression_gaps(t: Inputs) -> DataFrame:
    """E15, the gap between training and later rows."""
    split = F.when(F.col("date") < F.lit("1998-01-01").cast("date"), "train").when(F.col("date") < F.lit("2000-01-01").cast("date"), "val").otherwise("test")
    return rounded(metrics.regression_gaps(t.predictions.withColumn("split", split), "split", "ret", "score"))


@query("SELECT bucket, count(*) AS n, round(avg(abs(ret - score)), 6) AS mae, round(coalesce(corr(ret, score), 0), 6) AS corr FROM (SELECT *, CASE WHEN abs(ret) < 1 THEN '<1' WHEN abs(ret) < 3 THEN '1-3' WHEN abs(ret) < 5 THEN '3-5' ELSE '>=5' END AS bucket FROM preds) GROUP BY 1", "preds")
def magnitude_metrics(t: Inputs) -> DataFrame:
    """E16."""
    return rounded(metrics.metrics_by_magnitude(t.predictions, "ret", "score"))


@query("SELECT count(*) AS n, round(corr(ret, score), 6) AS corr, round(avg(abs(ret - score)), 6) AS mae, round(avg(CAST(sign(ret) = sign(score) AS INT)), 6) AS sign_agreement FROM (SELECT *, row_number() OVER (ORDER BY abs(score) DESC, id) AS k FROM preds) WHERE k <= (SELECT greatest(10, count(*) // 10) FROM preds)", "preds")
def extreme_metrics(t: Inputs) -> DataFrame:
    """E17."""
    return rounded(metrics.extreme_metrics(t.predictions, "ret", "score", "id"))


@query("SELECT t AS threshold, count(*) FILTER (i) AS n, round(avg(CAST(i AS INT)), 6) AS coverage, round(coalesce(count(*) FILTER (i AND said = up) / nullif(count(*) FILTER (i), 0), 0), 6) AS accuracy, round(coalesce(count(*) FILTER (i AND said = up AND said = 1) / nullif(count(*) FILTER (i AND said = 1), 0), 0), 6) AS up_precision, round(coalesce(count(*) FILTER (i AND said = up AND said = 0) / nullif(count(*) FILTER (i AND said = 0), 0), 0), 6) AS down_precision FROM (SELECT t, up, CAST(prob >= 0.5 AS INT) AS said, greatest(prob, 1 - prob) >= t AS i FROM preds CROSS JOIN (VALUES (0.6::DOUBLE), (0.65::DOUBLE), (0.7::DOUBLE)) v(t)) GROUP BY 1", "preds")
def confidence_curve(t: Inputs) -> DataFrame:
    """E18."""
    return rounded(metrics.confidence_curve(t.predictions, "up", "prob", [0.6, 0.65, 0.7]))


@query("SELECT count(*) AS n, round(count(*) FILTER (answer = truth) / count(*), 6) AS accuracy_all, round(count(*) FILTER (answer = truth) / count(*) FILTER (answer <> 'UNCLEAR'), 6) AS accuracy_clear, round(avg(CAST(answer = 'UNCLEAR' AS INT)), 6) AS unclear_rate, round(count(*) FILTER (answer = 'POSITIVE') / count(*) FILTER (answer <> 'UNCLEAR'), 6) AS positive_share FROM preds", "preds")
def unclear_report(t: Inputs) -> DataFrame:
    """E20."""
    return rounded(metrics.unclear_report(t.predictions, "truth", "answer"))


@query("SELECT count(*) AS n, round(avg(CAST((four >= 2) = (said_four >= 2) AS INT)), 6) AS direction_accuracy FROM preds", "preds")
def direction_accuracy(t: Inputs) -> DataFrame:
    """E21."""
    return rounded(metrics.directional_accuracy(t.predictions, "four", "said_four"))


@query("SELECT CAST(year(date) AS INT) AS year, count(*) AS total, count(*) FILTER (cls = 'F') AS success, count(*) FILTER (cls <> 'F') AS failed, count(*) FILTER (cls = 'F' AND three = 2) AS up, count(*) FILTER (cls = 'F' AND three = 0) AS down, count(*) FILTER (cls = 'F' AND three = 1) AS stay, round(avg(ret) FILTER (cls = 'F'), 6) AS avg_value, CAST(floor(avg(cust) FILTER (cls = 'F')) AS BIGINT) AS avg_tokens, round(sum(vol) FILTER (cls = 'F'), 6) AS cost FROM preds GROUP BY ROLLUP (year(date))", "preds")
def processing_stats(t: Inputs) -> DataFrame:
    """E22."""
    label = F.when(F.col("three") == 2, "UP").when(F.col("three") == 0, "DOWN").otherwise("STAY")
    rows = t.predictions.select(F.year("date").alias("year"), F.when(F.col("cls") == "F", "success").otherwise("error").alias("status"), "ret", "vol", label.alias("label"), "cust")
    return rounded(metrics.processing_stats(rows, "year", "status", "ret", "vol", "label", "cust"))


@query("SELECT round(min(ret), 6) AS min, round(max(ret), 6) AS max, round(avg(ret), 6) AS avg, round(stddev_pop(ret), 6) AS std FROM preds WHERE cls = 'F'", "preds")
def success_stats(t: Inputs) -> DataFrame:
    """E23, N6."""
    return rounded(metrics.success_stats(t.predictions.withColumn("status", F.when(F.col("cls") == "F", "success")), "status", "ret"))


@query("SELECT grp, max(c) AS largest, min(c) AS smallest, round(max(c) / min(c), 6) AS ratio FROM (SELECT grp, three, count(*) AS c FROM preds GROUP BY GROUPING SETS ((grp, three), (three))) GROUP BY 1", "preds")
def class_imbalance(t: Inputs) -> DataFrame:
    """E24."""
    return rounded(metrics.imbalance(t.predictions, "grp", "three"))


_BOARD = "(SELECT cls, grp, avg(abs(ret)) AS m FROM preds GROUP BY 1, 2)"


def _board(t: Inputs) -> DataFrame:
    return t.predictions.groupBy("cls", "grp").agg(F.avg(F.abs("ret")).alias("m"))


@query(f"SELECT cls, arg_max(grp, m) AS best, round(max(m), 6) AS best_metric, round(avg(m), 6) AS mean_metric, round((max(m) - avg(m)) / avg(m) * 100, 4) AS improvement_pct FROM {_BOARD} GROUP BY 1", "preds")
def leaderboard(t: Inputs) -> DataFrame:
    """E25."""
    return rounded(metrics.leaderboard(_board(t), "cls", "grp", "m").withColumn("improvement_pct", F.round("improvement_pct", 4)))


@query(f"SELECT cls, grp, round(m, 6) AS m, round(CASE WHEN cls = 'F' THEN (m - b) / b * 100 END, 4) AS lift_pct FROM {_BOARD}, (SELECT max(m) AS b FROM {_BOARD} WHERE grp = '1-URGENT')", "preds")
def lift(t: Inputs) -> DataFrame:
    """E26."""
    return rounded(metrics.lift_vs_baseline(_board(t), "grp", "m", "1-URGENT", "cls", "F").withColumn("lift_pct", F.round("lift_pct", 4)))


@query("SELECT grp, id, round(score, 6) AS score, CAST(k AS INT) AS rank, round(a, 6) AS mean_abs FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(score) DESC, id) AS k, avg(abs(score)) OVER (PARTITION BY grp) AS a FROM preds) WHERE k <= 10", "preds")
def top_importance(t: Inputs) -> DataFrame:
    """E27."""
    return rounded(metrics.importance_by_group(t.predictions.select("grp", "id", "score"), "grp", "id", "score", 10))


@query("SELECT grp, round(best, 6) AS best, round(base, 6) AS baseline, round(best - base, 6) AS edge, CAST(row_number() OVER (ORDER BY best - base DESC, grp) AS INT) AS rank, best - base > 2 AS predictable FROM (SELECT grp, greatest(avg(CAST(up = said AS INT)), avg(CAST(four = said_four AS INT))) * 100 AS best, greatest(avg(up), 1 - avg(up)) * 100 AS base FROM preds GROUP BY 1)", "preds")
def predictability(t: Inputs) -> DataFrame:
    """E29."""
    p = t.predictions
    accuracy = lambda a, b: p.groupBy("grp").agg((F.avg((F.col(a) == F.col(b)).cast("int")) * 100).alias("accuracy"))
    base = p.groupBy("grp").agg((F.greatest(F.avg("up"), 1 - F.avg("up")) * 100).alias("baseline"))
    return rounded(metrics.predictability(accuracy("up", "said"), accuracy("four", "said_four"), base, "grp"))


@query("SELECT round(skewness(ret), 5) AS skew FROM preds", "preds")
def return_skew(t: Inputs) -> DataFrame:
    """E31."""
    return rounded(metrics.skew_unbiased(t.predictions, "ret"), 5)
