"""Position sizes, strategy returns, portfolio metrics, calibration and payoff tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ordered_parts, qcut_rank, qcut_value, quantiles


def position_size(df: DataFrame, predicted: str, base: float = 0.01, name: str = "position_size") -> DataFrame:
    """Inverse to predicted volatility around its mean, clipped to a fifth and twice the base."""
    mean = df.agg(F.avg(predicted)).scalar()
    return df.withColumn(name, F.greatest(F.lit(base * 0.2), F.least(F.lit(base * 2.0), F.lit(base) * (mean / F.col(predicted)))))


def strategy_returns(direction: Column, ret: Column, size: Column, cost: float = 0.001, cost_unit: float = 1.0) -> Column:
    """Directional return of a position less its cost; ``cost_unit`` 100 states the cost in the returns' per cent."""
    return direction * ret * size - size * cost * cost_unit


def max_drawdown(df: DataFrame, order: list[str], columns: list[str], legacy: bool = True) -> DataFrame:
    """The deepest fall of each column's running sum below its running maximum: relative to it (plus 0.01) in per cent, or absolute."""
    cut = ordered_parts(df.select(*order, *columns), order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # sums and maxima start anew in each range; a row per range tells what comes before it
    local = cut.withColumns({f"_c_{c}": F.sum(c).over(upto) for c in columns})
    local = local.select("_part", *[f"_c_{c}" for c in columns], *[F.max(f"_c_{c}").over(upto).alias(f"_m_{c}") for c in columns])
    facts = local.groupBy("_part").agg(*[F.max(f"_m_{c}").alias(f"_m_{c}") for c in columns]).join(cut.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns]), "_part")
    starts = facts.select("_part", *[f"_m_{c}" for c in columns], *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_o_{c}") for c in columns])
    offsets = starts.select("_part", *[f"_o_{c}" for c in columns], *[F.max(F.col(f"_o_{c}") + F.col(f"_m_{c}")).over(before).alias(f"_t_{c}") for c in columns])
    total = {c: F.col(f"_o_{c}") + F.col(f"_c_{c}") for c in columns}
    top = {c: F.greatest(F.col(f"_o_{c}") + F.col(f"_m_{c}"), F.col(f"_t_{c}")) for c in columns}
    fall = lambda c: (total[c] - top[c]) / (top[c] + 0.01) * 100 if legacy else total[c] - top[c]
    return local.join(F.broadcast(offsets), "_part").agg(*[F.min(fall(c)).alias(c) for c in columns])


def portfolio_metrics(df: DataFrame, order: list[str], strategies: list[str], size: str) -> DataFrame:
    """A row per strategy: total, annual Sharpe ratio, drawdown, win rate, average size."""
    drawdowns = max_drawdown(df, order, strategies).unpivot([], strategies, "strategy", "max_drawdown")
    long = df.unpivot([size], strategies, "strategy", "r")
    std = F.stddev_samp("r")
    out = long.groupBy("strategy").agg(F.sum("r").alias("total"), F.when(std > 0, F.avg("r") / std * math.sqrt(252)).otherwise(0.0).alias("sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(size).alias("avg_size"))
    return out.join(F.broadcast(drawdowns), "strategy")  # a row per strategy


def compare_strategies(metrics: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """Absolute and relative differences of two strategies' metrics."""
    pick = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    one = metrics.agg(*[pick(s, c).alias(f"{c}_{n}") for c in columns for s, n in ((a, "a"), (b, "b"))])
    return one.select(*[x for c in columns for x in ((F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_diff"), F.try_divide(F.col(f"{c}_b") - F.col(f"{c}_a"), F.abs(f"{c}_a")).alias(f"{c}_rel"))])


def calibration(df: DataFrame, predicted: str, actual: str, tie: str, q: int = 10) -> DataFrame:
    """Mean and spread of what came true in each bin of predictions."""
    return qcut_rank(df, predicted, tie, q).groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.stddev_samp(actual).alias("std_actual"))


def fitted_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _trades(df: DataFrame, pnl: Column, yearly: float = 252 / 5) -> DataFrame:
    std = F.stddev_samp("pnl")
    return df.withColumn("pnl", pnl).agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg("pnl").alias("avg"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.when(std > 0, F.avg("pnl") * math.sqrt(yearly) / std).otherwise(0.0).alias("sharpe"))


def pair_pnl(predicted: Column, a: Column, b: Column) -> Column:
    return F.when(predicted == "A", a - b).otherwise(b - a)


def pair_trades(df: DataFrame, predicted: str, confidence: str, a: str, b: str, least: float = 0.5) -> DataFrame:
    """Long the predicted winner, short the loser, for clear and sure predictions."""
    return _trades(df.filter((F.col(confidence) >= least) & (F.col(predicted) != "UNCLEAR")), pair_pnl(F.col(predicted), F.col(a), F.col(b)))


def long_short(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    trades = df.filter(F.col(predicted).isin("POSITIVE", "NEGATIVE"))
    return _trades(trades, F.when(F.col(predicted) == "POSITIVE", F.col(actual)).otherwise(-F.col(actual)))


def win_rate_curve(df: DataFrame, confidence: str, pnl: str, levels: list[float], more_than: int = 5) -> DataFrame:
    """Win rate above each confidence, where there are enough trades."""
    each = df.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).filter(F.col(confidence) >= F.col("level"))
    return each.groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate")).filter(F.col("n") > more_than)


def straddle_payoff(df: DataFrame, predicted: str, actual: str, name: str = "payoff") -> DataFrame:
    """Rows whose prediction is in the top quarter earn what came true less the mean prediction; others nothing."""
    edge, mean = quantiles(df, predicted, [0.75]).scalar()[0], df.agg(F.avg(predicted)).scalar()
    return df.withColumn(name, F.when(F.col(predicted) > edge, F.col(actual) - mean).otherwise(0.0))


def payoff_by_quartile(df: DataFrame, predicted: str, payoff: str) -> DataFrame:
    p = F.col(payoff)
    return qcut_value(df, predicted, 4).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_payoff"), F.avg((p > 0).cast("double")).alias("win_rate"), F.stddev_samp(p).alias("risk"))
