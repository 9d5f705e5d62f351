"""Lookups, first-match and positional joins, sampled pairs, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import draw, global_position


def merge_on(a: DataFrame, b: DataFrame, key: str, suffix: str = "_right") -> DataFrame:
    """Inner join; clashing columns of the second side get a suffix."""
    clash = {c: c + suffix for c in b.columns if c in a.columns and c != key}
    return a.join(b.withColumnsRenamed(clash), key)


def last_of(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the last by position."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(key, "_r.*")


def first_of(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the first by position."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(key, "_r.*")


def add_lookup(df: DataFrame, dimension: DataFrame, key: str, columns: list[str], position: str) -> DataFrame:
    """Left lookup in a dimension whose last duplicate holds; absent keys give null. Spark broadcasts what is small."""
    return df.join(last_of(dimension, key, position).select(key, *columns), key, "left")


def attach_labels(texts: DataFrame, labels: DataFrame, key: str, position: str) -> DataFrame:
    """Each text with its first label; texts without one go."""
    return texts.join(first_of(labels, key, position), key)


def items_with_text(items: DataFrame, texts: DataFrame, keys: list[str], text_col: str, limit: int = 3000) -> DataFrame:
    """Items with their text, '' where there is none, capped."""
    joined = items.join(texts.select(*keys, text_col), keys, "left")
    return joined.withColumn(text_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, limit))


def verify_lineage(sample: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """How many sampled rows the source has."""
    found = sample.join(source.select(*keys).distinct().withColumn("_found", F.lit(True)), keys, "left")
    return found.agg(F.count("*").alias("n"), F.count_if("_found").alias("matched"), F.count_if(F.col("_found").isNull()).alias("unmatched"))


def zip_by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of equal position in their own orders; the longer table's rest goes."""
    left = global_position(a, order_a, "position").drop("_n")
    return left.join(global_position(b, order_b, "position").drop("_n"), "position")


def contrastive_pairs(df: DataFrame, group: str, id_col: str, ret: str, threshold: float, n: int, seed: int = 42) -> DataFrame:
    """For each group ``n`` pairs of a high and a low performer, each side drawn with replacement."""

    def side(rows: DataFrame, name: str, salt: int) -> tuple[DataFrame, DataFrame]:
        """Rows numbered within their group by ranges over all groups, so that a large group is many tasks."""
        placed = global_position(rows.select(group, id_col, ret, draw(seed + salt, id_col).alias("_h")), [group, "_h", id_col], "_at")
        facts = placed.groupBy(group).agg(F.count("*").alias(f"{name}_n"), F.min("_at").alias("_first"))
        numbered = placed.join(facts, group).select(group, F.col(id_col).alias(f"{name}_id"), F.col(ret).alias(f"{name}_return"), (F.col("_at") - F.col("_first")).alias(f"{name}_at"))
        return numbered, facts.drop("_first")

    high, highs = side(df.filter(F.col(ret) > threshold), "high", 1)
    low, lows = side(df.filter(F.col(ret) < -threshold), "low", 2)
    draws = highs.join(lows, group).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = lambda name, salt: F.pmod(draw(seed + salt, group, "k"), F.col(f"{name}_n")).alias(f"{name}_at")
    drawn = draws.select(group, "k", pick("high", 3), pick("low", 4))
    return drawn.join(high, [group, "high_at"]).join(low, [group, "low_at"]).select(group, "k", "high_id", "low_id", "high_return", "low_return")


def compare_models(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Groups in both result tables, the difference of a metric, and which is better."""
    joined = a.select(key, F.col(metric).alias("a")).join(b.select(key, F.col(metric).alias("b")), key)
    winner = F.when(F.col("a") > F.col("b"), "first").when(F.col("b") > F.col("a"), "second").otherwise("tie")
    return joined.withColumn("difference", F.col("b") - F.col("a")).withColumn("winner", winner)


def restricted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name, absent columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values only in the first, only in the second, or in both."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.subtract(y).withColumn("where", F.lit("first")).union(y.subtract(x).withColumn("where", F.lit("second"))).union(x.intersect(y).withColumn("where", F.lit("both")))


def candidate_union(a: DataFrame, b: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Candidates of two scorers, an absent score is 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return a.join(b, keys, "full_outer").select(*keys, zero(first), zero(second))


def distinct_codes(items: DataFrame, key: str, code: Column | str) -> DataFrame:
    return items.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("codes"))
