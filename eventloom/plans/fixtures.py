"""Views of the driver's tables as the study's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .market import session_class


class Inputs:
    """The study's tables over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def filings(self) -> DataFrame:
        rows = self.events.select(F.col("event_id").alias("accession"), F.col("event_type").alias("ticker"), "ts", F.to_date("ts").alias("filing_date"), "user_id", "value", "props")
        return rows.withColumn("session", session_class(F.col("ts")))

    def _bars(self, *by: str) -> DataFrame:
        day = self.events.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day"), "event_id", "value")
        return day.groupBy(*by, "day").agg(F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"))

    @property
    def bars(self) -> DataFrame:
        return self._bars("ticker")

    @property
    def benchmark_days(self) -> DataFrame:
        return self._bars()

    @property
    def predictions(self) -> DataFrame:
        k = F.col("o_orderkey")
        ret = (F.col("o_totalprice") % 1000) / 100 - 5
        return self.orders.select(
            k.alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("cls"), F.col("o_custkey").alias("cust"),
            ret.alias("ret"), ((k * 7919) % 10007 / F.lit(1000.0) - 5).alias("score"), ((k * 104729) % 9973 / F.lit(1000.0) + 0.5).alias("vol"), ((k * 7919) % 10007 / F.lit(10007.0)).alias("prob"),
            (ret > 0).cast("int").alias("up"), ((k * 7919) % 10007 >= 5004).cast("int").alias("said"),
            F.when(ret < -1, 0).when(ret > 1, 2).otherwise(1).alias("three"), (k % 4).cast("int").alias("four"), (k * 31 % 4).cast("int").alias("said_four"),
            F.when(k % 7 == 0, "UNCLEAR").when(k % 2 == 0, "POSITIVE").otherwise("NEGATIVE").alias("answer"), F.when(ret > 0, "POSITIVE").otherwise("NEGATIVE").alias("truth"),
        )

    @property
    def items(self) -> DataFrame:
        code = F.concat("l_returnflag", F.lit("."), "l_linestatus")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.lineitem.select(F.col("l_orderkey").alias("filing"), F.row_number().over(order).alias("pos"), F.when(F.col("l_linenumber") == 7, "MIXED").otherwise(code).alias("code"), F.col("l_partkey").alias("part"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))


#: The same views as common table expressions; bench is all events a day.
SQL_VIEWS = {
    "filings": "SELECT *, CASE WHEN ts IS NULL THEN 'after_hours' WHEN isodow(ts) >= 6 THEN 'overnight' WHEN sod >= 14400 AND sod < 34200 THEN 'pre_market' WHEN sod >= 34200 AND sod < 57600 THEN 'market_hours' WHEN sod >= 57600 AND sod < 72000 THEN 'after_hours' ELSE 'overnight' END AS session FROM (SELECT event_id AS accession, event_type AS ticker, ts, CAST(ts AS DATE) AS filing_date, user_id, value, props, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT) AS sod FROM events)",
    "bars": "SELECT event_type AS ticker, CAST(ts AS DATE) AS day, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM events GROUP BY ALL",
    "bench": "SELECT CAST(ts AS DATE) AS day, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM events GROUP BY ALL",
    "cal": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS idx FROM bench",
    "entries": "SELECT f.*, (SELECT min(idx) FROM cal WHERE CASE WHEN f.session = 'pre_market' THEN day >= f.filing_date ELSE day > f.filing_date END) AS entry_idx FROM filings f",
    "returns": "SELECT e.accession, e.ticker, e.session, e.user_id, d0.day AS entry_date, d4.day AS exit_date, (b4.close - b0.open) / b0.open * 100 AS stock, (m4.close - m0.open) / m0.open * 100 AS market FROM entries e JOIN cal d0 ON d0.idx = e.entry_idx JOIN cal d4 ON d4.idx = e.entry_idx + 4 JOIN bars b0 ON b0.ticker = e.ticker AND b0.day = d0.day JOIN bars b4 ON b4.ticker = e.ticker AND b4.day = d4.day JOIN bench m0 ON m0.day = d0.day JOIN bench m4 ON m4.day = d4.day WHERE b0.open > 0 AND b4.close > 0 AND m0.open > 0 AND m4.close > 0",
    "preds": "SELECT k AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS grp, o_orderstatus AS cls, o_custkey AS cust, ret, ((k * 7919) % 10007) / 1000.0::DOUBLE - 5 AS score, ((k * 104729) % 9973) / 1000.0::DOUBLE + 0.5 AS vol, ((k * 7919) % 10007) / 10007.0::DOUBLE AS prob, CAST(ret > 0 AS INT) AS up, CAST((k * 7919) % 10007 >= 5004 AS INT) AS said, CASE WHEN ret < -1 THEN 0 WHEN ret > 1 THEN 2 ELSE 1 END AS three, CAST(k % 4 AS INT) AS four, CAST(k * 31 % 4 AS INT) AS said_four, CASE WHEN k % 7 = 0 THEN 'UNCLEAR' WHEN k % 2 = 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS answer, CASE WHEN ret > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS truth FROM (SELECT *, o_orderkey AS k, (o_totalprice % 1000) / 100 - 5 AS ret FROM orders)",
    "items": "SELECT l_orderkey AS filing, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos, CASE WHEN l_linenumber = 7 THEN 'MIXED' ELSE l_returnflag || '.' || l_linestatus END AS code, l_partkey AS part, 'part ' || l_partkey AS text FROM lineitem",
}
_NEEDS = {"cal": ["bench"], "entries": ["filings", "bench", "cal"], "returns": ["filings", "bars", "bench", "cal", "entries"]}


def with_views(sql: str, *views: str) -> str:
    """A query behind the views that it names."""
    names = list(dict.fromkeys(x for v in views for x in [*_NEEDS.get(v, []), v]))
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + " " + sql
