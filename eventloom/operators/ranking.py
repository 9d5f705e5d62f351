"""Global order at scale, quantile bins, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Rows sampled for each range that an order is cut into.
SAMPLED = 100


def splitters(df: DataFrame, order: list[str], parts: int, seed: int = 42) -> list[tuple]:
    """Keys, of all ordering columns, that cut the rows into about equal ranges; from a sample of SAMPLED rows a range, about."""
    keys = df.select(*order)
    n = keys.count() if parts > 1 else 0
    if not n:
        return []
    share = parts * SAMPLED / n
    found = (keys if share >= 1 else keys.sample(share, seed)).orderBy(*order).collect()
    cuts = [tuple(found[len(found) * i // parts]) for i in range(1, parts)] if found else []
    return list(dict.fromkeys(cuts))


def ordered_parts(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``_part``, a range of the order: ranges are cut at keys of all ordering columns, nulls first.

    Rows that tie in the first columns are divided by the later ones; only rows
    equal in all of them share a range for that.
    """
    cuts = splitters(df, order, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not cuts:
        return df.withColumn("_part", F.lit(0))
    bounds = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cut)]) for cut in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # a binary search; past the last cut there is null, which takes no step
    found = lambda key: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))
    # as the variable of a one-element transform, the key is made once for a row, whatever its columns are computed from
    return df.withColumn("_part", F.transform(F.array(F.struct(*order)), found)[0])


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add each row's position from 0 and ``_n``, the number of rows, without gathering the rows in one task.

    Rows are numbered in their ranges; the ranges' counts (a row each) make the offsets.
    """
    cut = ordered_parts(df, order)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"), F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def cumulative(df: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add running sums in the given order: sums in ranges plus the sums of the ranges before."""
    cut = ordered_parts(df, order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in columns.items()])
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0.0)).alias(f"_o_{name}") for name in columns])
    out = cut.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.sum(c).over(upto) + F.col(f"_o_{name}")).alias(name) for name, c in columns.items()])


def running_max(df: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add running maxima in the given order, by ranges like ``cumulative``."""
    cut = ordered_parts(df, order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy("_part").agg(*[F.max(c).alias(f"_m_{name}") for name, c in columns.items()])
    earlier = tops.select("_part", *[F.max(f"_m_{name}").over(before).alias(f"_o_{name}") for name in columns])
    out = cut.join(F.broadcast(earlier), "_part")
    return out.select(*df.columns, *[F.greatest(F.max(c).over(upto), F.col(f"_o_{name}")).alias(name) for name, c in columns.items()])


def avg_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add average ranks, from 1, of a column's values, by the counts of its distinct values."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    spread = ordered_parts(counts, [column])
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_part").agg(F.sum("_c").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    ranks = spread.withColumn("_upto", F.sum("_c").over(inside)).join(F.broadcast(offsets), "_part").select(column, (F.col("_o") + F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, column)


def quantiles(df: DataFrame, column: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """A row (e, an array) of linear quantiles of a column's values; with ``by``, a row (key struct, e) for each group.

    Made from counts of distinct values: sums in ranges plus the sums of the group's ranges before.
    """
    group = F.struct(*by) if by else F.lit(0)
    counts = df.filter(F.col(column).isNotNull()).groupBy(group.alias("key"), F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cut = ordered_parts(counts, ["_v"])
    inside = Window.partitionBy("key", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("key", "_part").agg(F.sum("_c").alias("_s"))
    offsets = sums.select("key", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy("key")).alias("_n"))
    placed = cut.withColumn("_end", F.sum("_c").over(inside)).join(offsets, ["key", "_part"]).withColumn("_end", F.col("_o") + F.col("_end"))

    def value(p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(p)
        one = lambda k: F.max(F.when((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")), F.col("_v")))
        low, high = one(F.floor(at)), one(F.ceil(at))
        return low + (high - low) * ((F.max("_n") - 1) * F.lit(p) - F.floor((F.max("_n") - 1) * F.lit(p)))

    out = placed.groupBy("key").agg(F.array(*[value(p) for p in points]).alias("e"))
    return out if by else out.select("e")


def qcut_rank(df: DataFrame, column: str, tie: str, q: int = 10, name: str = "bin") -> DataFrame:
    """Bins of first-come ranks, from 1; not ntile where q does not divide the rows."""
    ranked = global_position(df, [column, tie], "_r")
    return ranked.withColumn(name, F.greatest(F.lit(1), F.ceil(F.col("_r") * q / (F.col("_n") - 1))).cast("int")).drop("_r", "_n")


def equal_deciles(df: DataFrame, column: str, tie: str, q: int = 10, name: str = "bin") -> DataFrame:
    """Bins of n div q rows, from 1; the last takes the rest."""
    ranked = global_position(df, [column, tie], "_r")
    return ranked.withColumn(name, F.least(F.lit(q), F.floor(F.col("_r") / F.greatest(F.floor(F.col("_n") / q), F.lit(1))) + 1).cast("int")).drop("_r", "_n")


def decile_spread(df: DataFrame, bin_col: str, value: str) -> DataFrame:
    """The mean of the top bin, of the bottom bin, their difference and ratio."""
    means = df.groupBy(bin_col).agg(F.avg(value).alias("m"))
    out = means.agg(F.max_by("m", bin_col).alias("top"), F.min_by("m", bin_col).alias("bottom"))
    return out.withColumn("spread", F.col("top") - F.col("bottom")).withColumn("ratio", F.try_divide("top", "bottom"))


def qcut_value(df: DataFrame, column: str, q: int = 5, name: str = "bin") -> DataFrame:
    """Right-closed bins, from 1, between linear quantiles of the values."""
    edges = quantiles(df, column, [i / q for i in range(1, q)]).scalar()
    held = df.withColumn("_e", edges)
    return held.withColumn(name, sum(((F.col("_e")[i] < F.col(column)).cast("int") for i in range(q - 1)), F.lit(1))).drop("_e")


def above_quantile(df: DataFrame, column: str, p: float, train: DataFrame | None = None, name: str = "high") -> DataFrame:
    """Add a flag for values over a quantile of the table itself or of a training table."""
    edge = quantiles(df if train is None else train, column, [p]).scalar()[0]
    return df.withColumn(name, (F.col(column) > edge).cast("int"))


def vol_tertiles(df: DataFrame, column: str, name: str = "tertile") -> DataFrame:
    """How many of the 33rd and 67th percentiles a value reaches."""
    edges = quantiles(df, column, [0.33, 0.67]).scalar()
    held = df.withColumn("_e", edges)
    return held.withColumn(name, (F.col("_e")[0] <= F.col(column)).cast("int") + (F.col("_e")[1] <= F.col(column)).cast("int")).drop("_e")


def temporal_split(df: DataFrame, order: list[str], val: float = 0.15, test: float = 0.15) -> DataFrame:
    """train, val and test by position in time."""
    ranked = global_position(df, order, "_r")
    train_end, val_end = F.floor(F.col("_n") * F.lit(1 - val - test)), F.floor(F.col("_n") * F.lit(1 - test))
    return ranked.withColumn("split", F.when(F.col("_r") < train_end, "train").when(F.col("_r") < val_end, "val").otherwise("test")).drop("_r", "_n")


def split_summary(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(date).alias("from_date"), F.max(date).alias("to_date"), F.count("*").alias("n"))


def top_n(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def sorted_items(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def top_terms(df: DataFrame, term: str, coefficient: str, k: int) -> DataFrame:
    """The k terms with the largest coefficients and the k with the least."""
    side = lambda c, name: df.orderBy(c, term).limit(k).select(term, coefficient, F.lit(name).alias("side"))
    return side(F.desc(coefficient), "positive").union(side(F.asc(coefficient), "negative"))


#: Digits of an md5 that make a number, and how many such numbers there are.
DIGITS, NUMBERS = 15, 16**15


def draw(seed: int, *columns: Column | str) -> Column:
    """A number from 0 to 16 ** 15 - 1, the same for the same seed and values in any engine that has md5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, DIGITS), 16, 10).cast("long")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for a seed."""
    return df.orderBy(draw(seed, id_col), id_col).limit(n)


def sample_with_replacement(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n draws, each of any row: positions by the draw's number."""
    placed = global_position(df.withColumn("_h", draw(seed, id_col)), ["_h", id_col], "_at").drop("_h")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    size = df.agg(F.count("*")).scalar()
    return draws.withColumn("_at", F.pmod(draw(seed, "draw"), size)).join(placed, "_at").drop("_at", "_n")


def stratified_split(df: DataFrame, id_col: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The same share of each class to the test side; classes are cut at quantiles of the drawn numbers, not sorted whole."""
    hashed = df.withColumn("_u", draw(seed, id_col) / NUMBERS)
    edges = quantiles(hashed, "_u", [1 - test], [label]).select(F.col(f"key.{label}").alias(label), F.col("e")[0].alias("_edge"))
    return hashed.join(edges, label).withColumn("split", F.when(F.col("_u") > F.col("_edge"), "test").otherwise("train")).drop("_u", "_edge")


def balanced_examples(df: DataFrame, id_col: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each class, all where there are fewer; Spark cuts each partition to n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, id_col), id_col))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def shuffled_split(df: DataFrame, id_col: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """train, val and test by position in the order of drawn numbers."""
    return temporal_split(df.withColumn("_h", draw(seed, id_col)), ["_h", id_col], val, test).drop("_h")


def eligible_events(df: DataFrame, group: str, ret: str, threshold: float, least: int = 10, side: int = 5) -> DataFrame:
    """Rows of groups with enough rows, and enough high and low performers."""
    good = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(ret) > threshold).alias("h"), F.count_if(F.col(ret) < -threshold).alias("l")).filter((F.col("n") >= least) & (F.col("h") >= side) & (F.col("l") >= side))
    return df.join(good, group, "left_semi")


def top_groups(train: DataFrame, group: str, least: int = 100, k: int = 15) -> DataFrame:
    return train.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), group).limit(k)


def every_nth_above(df: DataFrame, column: str, order: list[str], p: float = 0.9, n: int = 30) -> DataFrame:
    """Of the rows over a quantile, every nth in order."""
    edge = quantiles(df, column, [p]).scalar()[0]
    return global_position(df.filter(F.col(column) > edge), order, "_r").filter(F.col("_r") % n == 0).drop("_r", "_n")


def _pearson(a: str, b: str, w: WindowSpec) -> Column:
    """Correlation over a window; not a number where a column doesn't vary (there Spark's corr divides by zero), null without rows that have both."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    facts = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return F.when(F.count(x).over(w) > 0, F.coalesce(facts, F.lit(float("nan"))))


def rolling_corr(df: DataFrame, by: list[str], order: list[str], a: str, b: str, n: int = 100, name: str = "rolling_corr") -> DataFrame:
    """Correlation over the last n rows of each key, null until there are so many.

    Rows are numbered over all keys and cut into blocks of ten windows or more;
    the last n - 1 rows of a block also go to the next one, so that a key with
    most rows is many tasks.
    """
    ranked = global_position(df, [*by, *order], "_at")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(10 * n), F.ceil(F.col("_n") / parts))
    block = F.floor(F.col("_at") / size)
    home, on = F.struct(block.alias("b"), F.lit(False).alias("carried")), F.struct((block + 1).alias("b"), F.lit(True).alias("carried"))
    late = F.col("_at") % size > size - n
    sent = ranked.withColumn("_to", F.explode(F.when(late, F.array(home, on)).otherwise(F.array(home)))).withColumn("_b", F.col("_to.b"))
    w = Window.partitionBy(*by, "_b").orderBy("_at").rowsBetween(-(n - 1), 0)
    return sent.withColumn(name, F.when(F.count("*").over(w) == n, _pearson(a, b, w))).filter(~F.col("_to.carried")).select(*df.columns, name)


def monthly_sum(df: DataFrame, date: str, value: str) -> DataFrame:
    """Sums by month; months between that have no row sum to 0."""
    sums = df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.sum(value).alias("total"))
    months = sums.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(sums, "month", "left").select("month", F.coalesce("total", F.lit(0.0)).alias("total"))
