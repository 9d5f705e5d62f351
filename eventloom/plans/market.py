"""Events aligned with daily and intraday bars: trading calendars, as-of and interval joins, returns and labels.

The benchmark's daily table and the calendar have a row per trading day, and
are the only sides that are broadcast: a century of days is 25 thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_class(ts: Column) -> Column:
    """Time-of-day class of a wall-clock time; unknown times count as after hours."""
    at = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (
        F.when(ts.isNull(), "after_hours")
        .when(F.weekday(ts) >= 5, "overnight")
        .when((at >= 4 * 3600) & (at < 34_200), "pre_market")
        .when((at >= 34_200) & (at < 57_600), "market_hours")
        .when((at >= 57_600) & (at < 72_000), "after_hours")
        .otherwise("overnight")
    )


def accept_ts(header: Column, tag: str = "ACCEPTANCE-DATETIME", lines: int = 50) -> Column:
    """The time YYYYMMDDHHMMSS behind a tag in a text's first lines."""
    top = F.array_join(F.slice(F.split(header, "\n"), 1, lines), "\n")
    return F.try_to_timestamp(F.regexp_extract(top, rf"<{tag}>\s*(\d{{14}})", 1), F.lit("yyyyMMddHHmmss"))


def calendar(benchmark: DataFrame, day: str = "day") -> DataFrame:
    """(day, idx): the benchmark's trading days, numbered from 0."""
    return benchmark.select(day).distinct().withColumn("idx", F.row_number().over(Window.orderBy(day)) - 1)


def trading_day_map(cal: DataFrame, beyond: int = 0) -> DataFrame:
    """For every date of the calendar's span and ``beyond`` days: the next and previous trading days, so that lookups are equi-joins."""
    span = cal.agg(F.min("day").alias("a"), F.date_add(F.max("day"), beyond).alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    days = span.join(cal, span["date"] == cal["day"], "left").select("date", "day", "idx")
    back, ahead = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    later = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    return days.select("date", F.last("idx", True).over(back).alias("idx_on_or_before"), F.first("idx", True).over(ahead).alias("idx_on_or_after"), F.first("idx", True).over(later).alias("idx_after"))


def entry_day(events: DataFrame, cal: DataFrame, date_col: str = "filing_date", class_col: str = "session") -> DataFrame:
    """Add entry_idx and entry_date: the first trading day from the date on before the market opens, else after it."""
    at = trading_day_map(cal)
    joined = events.join(F.broadcast(at), events[date_col] == at["date"], "left")
    idx = F.when(F.col(class_col) == "pre_market", F.col("idx_on_or_after")).otherwise(F.col("idx_after"))
    named = joined.withColumn("entry_idx", idx).drop("date", "idx_on_or_before", "idx_on_or_after", "idx_after")
    return named.join(F.broadcast(cal.select(F.col("idx").alias("entry_idx"), F.col("day").alias("entry_date"))), "entry_idx", "left")


def plus_trading_days(df: DataFrame, cal: DataFrame, n: int, idx_col: str, name: str) -> DataFrame:
    """Add the day ``n`` trading days on; rows past the calendar's end go."""
    ahead = cal.select((F.col("idx") - n).alias(idx_col), F.col("day").alias(name))
    return df.join(F.broadcast(ahead), idx_col)


def prev_trading_day(df: DataFrame, cal: DataFrame, date_col: str) -> DataFrame:
    """Add prev_day, the trading day before a date that is one itself; else null."""
    pairs = cal.select(F.col("day").alias(date_col), F.lag("day").over(Window.orderBy("idx")).alias("prev_day"))
    return df.join(F.broadcast(pairs), date_col, "left")


def asof_backward(events: DataFrame, series: DataFrame, on: str, value: str, by: list[str], tolerance_days: int | None = None, name: str = "asof_value") -> DataFrame:
    """Add the last value of ``series`` at or before each event's date: one shuffle by key and month, no inequality join.

    What a month begins with comes from a table of a row per key and month.
    """
    month = (F.year(on) * 12 + F.month(on)).alias("_m")
    left = events.select(F.struct(*events.columns).alias("_e"), *by, month, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("struct<_day:date,_v:double>").alias("_s"))
    known = F.struct(F.col(on).cast("date").alias("_day"), F.col(value).cast("double").alias("_v"))
    right = series.filter(F.col(value).isNotNull()).select(F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), *by, month, F.col(on).alias("_at"), F.lit(0).alias("_side"), known.alias("_s"))
    both = left.unionByName(right)
    months = both.groupBy(*by, "_m").agg(F.max("_s").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(*by, "_m", F.last("_last", True).over(before).alias("_carried"))
    seen = Window.partitionBy(*by, "_m").orderBy("_at", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_s", F.last("_s", True).over(seen)).filter("_side = 1").join(carried, [*by, "_m"], "left").withColumn("_s", F.coalesce("_s", "_carried"))
    last = F.when(F.datediff("_at", "_s._day") <= tolerance_days, F.col("_s._v")) if tolerance_days is not None else F.col("_s._v")
    return found.select("_e.*", last.alias(name))


def level_asof(events: DataFrame, benchmark: DataFrame, cal: DataFrame, date_col: str = "filing_date", lookback: int = 10) -> DataFrame:
    """Add the benchmark's close as of each date, if at most ``lookback`` days old."""
    at = trading_day_map(cal, lookback).select(F.col("date").alias(date_col), F.col("idx_on_or_before").alias("idx"))
    levels = cal.join(benchmark, "day").select("idx", "day", F.col("close").alias("level"))
    joined = events.join(F.broadcast(at.join(levels, "idx")), date_col, "left")
    return joined.withColumn("level", F.when(F.datediff(F.col(date_col), F.col("day")) <= lookback, F.col("level"))).drop("idx", "day")


def asof_nearest(events: DataFrame, cal: DataFrame, date_col: str) -> DataFrame:
    """Add nearest_day; of two equally near days the later, outside the calendar its first or last day."""
    at = trading_day_map(cal)
    days = lambda name: F.broadcast(cal.select(F.col("idx").alias(name), F.col("day").alias(name.replace("idx", "day"))))
    near = at.join(days("idx_on_or_before"), "idx_on_or_before", "left").join(days("idx_on_or_after"), "idx_on_or_after", "left")
    gap_back, gap_on = F.datediff("date", "day_on_or_before"), F.datediff("day_on_or_after", "date")
    day = F.when(F.col("day_on_or_after").isNull() | (gap_back < gap_on), F.col("day_on_or_before")).otherwise(F.col("day_on_or_after"))
    joined = events.join(F.broadcast(near.select(F.col("date").alias(date_col), day.alias("nearest_day"))), date_col, "left")
    first, last = (cal.agg(f("day")).scalar() for f in (F.min, F.max))
    return joined.withColumn("nearest_day", F.coalesce("nearest_day", F.when(F.col(date_col) < first, first).when(F.col(date_col) > last, last)))


def next_intraday_bar(events: DataFrame, bars: DataFrame, by: str, ts: str = "ts", value: str = "value", days: int = 2) -> DataFrame:
    """Add the first bar strictly after an event's time and before the end of the following day.

    One shuffle by key and day: a bar goes to its own day and to the days before from which it is in reach.
    """
    left = events.select(F.struct(*events.columns).alias("_e"), by, F.to_date(ts).alias("_d"), F.col(ts).alias("_at"), F.lit(1).alias("_side"))
    reached = F.explode(F.sequence(F.date_sub(F.to_date(ts), days - 1), F.to_date(ts))).alias("_d")
    right = bars.select(F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), by, reached, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(ts).alias("at"), F.col(value).alias("v")).alias("_bar"))
    # backwards in time an event comes before the bars of its own time, so that it has seen only later ones
    later = Window.partitionBy(by, "_d").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    found = both.withColumn("_bar", F.last("_bar", True).over(later)).filter("_side = 1")
    return found.select("_e.*", F.col("_bar.at").alias("bar_ts"), F.col("_bar.v").alias("bar_value"))


def with_bars(df: DataFrame, bars: DataFrame, benchmark: DataFrame, date_col: str, prefix: str, by: str = "ticker", how: str = "inner") -> DataFrame:
    """Add the stock's and the benchmark's open and close of one day."""
    own = bars.select(by, F.col("day").alias(date_col), F.col("open").alias(f"{prefix}_open"), F.col("close").alias(f"{prefix}_close"))
    market = benchmark.select(F.col("day").alias(date_col), F.col("open").alias(f"{prefix}_market_open"), F.col("close").alias(f"{prefix}_market_close"))
    return df.join(own, [by, date_col], how).join(F.broadcast(market), date_col, how)


def percent_change(a: Column, b: Column) -> Column:
    return (b - a) / a * 100


def forward_return(events: DataFrame, bars: DataFrame, benchmark: DataFrame, n: int = 4, by: str = "ticker") -> DataFrame:
    """Entry at the open of the entry day, exit at the close ``n`` trading days on, less the benchmark's return."""
    cal = calendar(benchmark)
    days = plus_trading_days(entry_day(events, cal), cal, n, "entry_idx", "exit_date")
    full = with_bars(with_bars(days, bars, benchmark, "entry_date", "entry", by), bars, benchmark, "exit_date", "exit", by)
    prices = [F.col(c) for c in ("entry_open", "exit_close", "entry_market_open", "exit_market_close")]
    good = full.filter(F.least(*prices) > 0).filter(prices[0].isNotNull() & prices[1].isNotNull() & prices[2].isNotNull() & prices[3].isNotNull())
    stock, market = percent_change(prices[0], prices[1]), percent_change(prices[2], prices[3])
    return good.withColumns({"stock_return_pct": F.round(stock, 4), "market_return_pct": F.round(market, 4), "adjusted_return_pct": F.round(stock - market, 4)})


def close_return(events: DataFrame, bars: DataFrame, benchmark: DataFrame, n: int = 4, strict: bool = False, by: str = "ticker") -> DataFrame:
    """Close to close from the first trading day on (``strict``: after) the date to ``n`` days on, and whether it beat the benchmark."""
    cal = calendar(benchmark)
    at = trading_day_map(cal).select(F.col("date").alias("filing_date"), F.col("idx_after" if strict else "idx_on_or_after").alias("idx"))
    t0 = events.join(F.broadcast(at), "filing_date").join(F.broadcast(cal.withColumnRenamed("day", "t0_date")), "idx")
    full = with_bars(with_bars(plus_trading_days(t0, cal, n, "idx", "t5_date"), bars, benchmark, "t0_date", "t0", by), bars, benchmark, "t5_date", "t5", by)
    stock, market = percent_change(F.col("t0_close"), F.col("t5_close")), percent_change(F.col("t0_market_close"), F.col("t5_market_close"))
    return full.withColumns({"stock_return_pct": F.round(stock, 3), "market_return_pct": F.round(market, 3), "adjusted_return_pct": F.round(stock - market, 3), "outperformed_market": (stock > market).cast("int")})


def nearest_bars(spots: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``before``, the last bar (day, close) at or before each spot's date ``at``, and ``after``, the first at or after it.

    One shuffle by key and month, in which a bar is one row; what lies in other months comes from a row per key and month.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    left = spots.select(F.struct(*spots.columns).alias("_e"), *keys, F.col("at").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("struct<day:date,close:double>").alias("_bar"))
    right = bars.filter(F.col("close").isNotNull()).select(F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), *keys, F.col("day").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("day").cast("date").alias("day"), F.col("close").cast("double").alias("close")).alias("_bar"))
    both = left.unionByName(right).withColumn("_m", month("_at"))
    months = both.groupBy(*keys, "_m").agg(F.min("_bar").alias("_first"), F.max("_bar").alias("_last"))
    earlier, later = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_m"), F.desc("_m")))
    around = months.select(*keys, "_m", F.last("_last", True).over(earlier).alias("_earlier"), F.last("_first", True).over(later).alias("_later"))
    back, ahead = (Window.partitionBy(*keys, "_m").orderBy(o, "_side").rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_at"), F.desc("_at")))
    seen = both.withColumn("_b", F.last("_bar", True).over(back)).withColumn("_a", F.last("_bar", True).over(ahead)).filter("_side = 1")
    return seen.join(around, [*keys, "_m"]).select("_e.*", F.coalesce("_b", "_earlier").alias("before"), F.coalesce("_a", "_later").alias("after"))


def bucketed_bars(bars: DataFrame, name: str, path: str, by: str = "ticker", buckets: int | None = None) -> DataFrame:
    """Bars stored as a table in buckets of key and day, sorted, so that joins by these need no exchange of bars."""
    n = buckets or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bars.repartition(n, by, "day").write.bucketBy(n, by, "day").sortBy(by, "day").option("path", path).mode("overwrite").saveAsTable(name)
    return bars.sparkSession.table(name)


def momentum(events: DataFrame, bars: DataFrame, benchmark: DataFrame, days: list[int], slack: int = 10, by: str = "ticker") -> DataFrame:
    """First to last close of the ``day + slack`` days before each event, less the benchmark's; null with fewer than two bars.

    Each (key, date) that events ask for looks up the last bar before it and, for each window, the first bar in it.
    """

    def changes(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        asked = events.select(*keys, "filing_date").distinct().filter(F.col("filing_date").isNotNull())
        spots = [F.struct(F.lit(d).alias("kind"), F.date_sub("filing_date", d + slack if d else 1).alias("at")) for d in (0, *days)]
        found = nearest_bars(asked.withColumn("_p", F.explode(F.array(*spots))).select(*keys, "filing_date", "_p.kind", "_p.at"), table, keys)
        bar = F.when(F.col("kind") == 0, F.col("before")).otherwise(F.col("after"))
        wide = found.groupBy(*keys, "filing_date").agg(*[F.max(F.when(F.col("kind") == d, bar)).alias(f"_{d}") for d in (0, *days)])
        # with a bar a day there are two or more in a window if its first is before the last
        return wide.select(*keys, "filing_date", *[F.when(F.col(f"_{d}.day") < F.col("_0.day"), percent_change(F.col(f"_{d}.close"), F.col("_0.close"))).alias(f"{prefix}_{d}") for d in days])

    own, market = changes(bars, [by], "own"), changes(benchmark, [], "market")
    joined = events.join(own, [by, "filing_date"], "left").join(market, "filing_date", "left")
    return joined.select(*events.columns, *[F.round(F.col(f"own_{d}") - F.col(f"market_{d}"), 2).alias(f"momentum_{d}d") for d in days])


def immediate_reaction(events: DataFrame, bars: DataFrame, benchmark: DataFrame, by: str = "ticker") -> DataFrame:
    """The first market reaction by session class: overnight gap, intraday move or open gap, less the benchmark's."""
    cal = calendar(benchmark)
    at = trading_day_map(cal).select(F.col("date").alias("filing_date"), F.col("idx_on_or_before").alias("idx"))
    day = entry_day(events, cal).join(F.broadcast(at), "filing_date", "left").join(F.broadcast(cal.withColumnRenamed("day", "last_day")), "idx", "left").drop("idx")
    late, own = F.col("session").isin("after_hours", "overnight"), F.col("last_day") == F.col("filing_date")
    full = with_bars(prev_trading_day(day, cal, "filing_date"), bars, benchmark, "last_day", "last", by, "left")
    full = with_bars(with_bars(full, bars, benchmark, "entry_date", "entry", by, "left"), bars, benchmark, "prev_day", "prev", by, "left")

    def moved(market: str) -> Column:
        change = lambda a, b: percent_change(F.col(a.replace("*", market)), F.col(b.replace("*", market)))
        return (
            F.when(late, change("last_*close", "entry_*open"))
            .when(own & (F.col("session") == "market_hours"), change("last_*open", "last_*close"))
            .when(own & (F.col("session") == "pre_market"), change("prev_*close", "last_*open"))
        )

    kind = F.when(late, "overnight_gap").when(F.col("session") == "market_hours", "intraday_move").otherwise("open_gap")
    stock, market = moved(""), moved("market_")
    whole = stock.isNotNull() & market.isNotNull()
    return full.select(
        *events.columns,
        F.when(whole, kind).alias("reaction_type"),
        F.when(whole, F.round(stock - market, 4)).alias("immediate_reaction_pct"),
        F.when(whole, F.round(stock, 4)).alias("stock_reaction_pct"),
        F.when(whole, F.round(market, 4)).alias("market_reaction_pct"),
    )


def attach_outcomes(events: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """All events, with null outcomes where they failed."""
    return events.join(outcomes, key, "left")


def classification_targets(ret: Column, threshold: float = 1.0) -> dict[str, Column]:
    """Binary and three-class targets; a missing return is 0, and STAY."""
    three = F.when(ret < -threshold, 0).when(ret > threshold, 2).otherwise(1)
    return {
        "binary_label": F.coalesce(ret > 0, F.lit(False)).cast("int"),
        "three_label": three,
        "binary_text": F.when(F.coalesce(ret > 0, F.lit(False)), "UP").otherwise("DOWN"),
        "three_text": F.when(three == 0, "DOWN").when(three == 2, "UP").otherwise("STAY"),
    }


def signal(ret: Column, threshold: float = 1.0) -> Column:
    """UP, DOWN or STAY; a missing return has none."""
    return F.when(ret.isNull(), None).when(ret > threshold, "UP").when(ret < -threshold, "DOWN").otherwise("STAY")


def impact_level(ret: Column, threshold: float) -> dict[str, Column]:
    """Four levels, bounded by the threshold and its double, and how sure they are."""
    level = F.when(ret > 2 * threshold, "STRONG_POSITIVE").when(ret > threshold, "POSITIVE").when(ret < -2 * threshold, "STRONG_NEGATIVE").otherwise("NEGATIVE")
    return {"impact": level, "impact_confidence": F.when(F.abs(ret) > 1.5 * threshold, "HIGH").otherwise("MEDIUM")}


def volatility_targets(ret: Column) -> dict[str, Column]:
    return {"abs_return": F.abs(ret), "log_abs_return": F.log1p(F.abs(ret)), "squared_return": ret * ret}
