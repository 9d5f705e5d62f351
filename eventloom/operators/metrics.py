"""Aggregate tables: counts, coverage, baselines, classification and regression metrics, group reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import avg_rank, cumulative, global_position, quantiles


def merge_items(items: DataFrame, key: str, position: str, code: str, text: str, first: list[str]) -> DataFrame:
    """One row per filing: first metadata, sorted distinct codes without MIXED, their number (1 at least), headed texts joined."""
    codes = F.array_sort(F.array_remove(F.collect_set(code), "MIXED"))
    headed = F.concat(F.lit("[ITEM "), F.col(code), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), headed.alias("t")))), lambda x: x["t"]), "\n\n")
    out = items.groupBy(key).agg(*[F.min_by(c, position).alias(c) for c in first], codes.alias("items"), texts.alias("text"))
    return out.withColumn("items_present", F.array_join("items", ",")).withColumn("item_count", F.greatest(F.size("items"), F.lit(1)))


def value_counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of non-null values, overall or in each group."""
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g")).agg(F.sum("n").alias("_t"))
    return counts.withColumn("_g", F.struct(*by) if by else F.lit(0)).join(totals, "_g").withColumn("share", F.col("n") / F.col("_t")).drop("_g", "_t")


def return_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    c = F.col(column)
    facts = df.groupBy(F.struct(*by).alias("key")).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return facts.join(quantiles(df, column, [0.5], by), "key", "left").select("key.*", "n", "mean", "std", "min", "max", F.col("e")[0].alias("median"))


def item_stats(items: DataFrame, key: str) -> DataFrame:
    return items.agg(F.count("*").alias("n"), F.countDistinct(key).alias("filings")).withColumn("per_filing", F.col("n") / F.col("filings"))


def code_shares(items: DataFrame, code: str, k: int = 10) -> DataFrame:
    """The k most frequent codes with their counts and shares of all rows."""
    counts = items.groupBy(code).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.orderBy(F.desc("n"), code).limit(k).withColumn("share", F.col("n") / total)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows in which each column is there."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def dataset_summary(df: DataFrame, number: str, date: str, category: str, k: int = 10) -> DataFrame:
    """Averages, extremes and the top values as rows (section, name, value)."""
    one = df.agg(F.count("*").cast("double").alias("rows"), F.avg(number).alias("mean"), F.min(number).alias("min"), F.max(number).alias("max"), F.countDistinct(date).cast("double").alias("days"))
    facts = one.unpivot([], ["rows", "mean", "min", "max", "days"], "name", "value").select(F.lit("overall").alias("section"), "name", "value")
    top = df.groupBy(category).count().orderBy(F.desc("count"), category).limit(k).select(F.lit("top").alias("section"), F.col(category).cast("string").alias("name"), F.col("count").cast("double").alias("value"))
    return facts.union(top)


def majority_baseline(df: DataFrame, binary: str, three: str, by: str) -> DataFrame:
    """The accuracy of always saying the most frequent class; ties go to UP, then DOWN, then STAY."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    up, down = n(binary, 1), n(binary, 0)
    u, d, s = n(three, 2), n(three, 0), n(three, 1)
    most = F.greatest(u, d, s)
    return df.groupBy(by).agg(
        F.when(up >= down, "UP").otherwise("DOWN").alias("binary_class"),
        (F.greatest(up, down) / F.count("*")).alias("binary_accuracy"),
        F.when(u == most, "UP").when(d == most, "DOWN").otherwise("STAY").alias("three_class"),
        (most / F.count("*")).alias("three_accuracy"),
    )


def return_distribution(df: DataFrame, column: str, points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    c = F.col(column)
    share = lambda x: F.avg(x.cast("double"))
    edges = quantiles(df, column, list(points)).scalar()
    return df.agg(share(c > 0).alias("positive"), share(c < 0).alias("negative"), share(F.abs(c) <= 1).alias("within_one")).withColumns({f"p{round(100 * p)}": edges[i] for i, p in enumerate(points)})


def group_baselines(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, ups, downs and the majority share in per cent by group, and an OVERALL row; null groups only count there not."""
    up, down = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    rows = df.filter(F.col(group).isNotNull()).rollup(group).agg(F.count("*").alias("n"), up.alias("ups"), down.alias("downs"), (F.greatest(up, down) / F.count("*") * 100).alias("baseline"))
    return rows.withColumn(group, F.coalesce(F.col(group), F.lit("OVERALL")))


def accuracy_by(df: DataFrame, group: str, actual: str, predicted: str, min_n: int = 1, fixed: float = 52.0) -> DataFrame:
    """Accuracy in per cent by group against the group's majority and a fixed baseline; small groups go."""
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    ones = F.avg(F.col(actual).cast("double"))
    out = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (F.avg(hit) * 100).alias("accuracy"), (F.greatest(ones, 1 - ones) * 100).alias("baseline"))
    return out.filter(F.col("n") >= min_n).withColumn("over_own", F.col("accuracy") - F.col("baseline")).withColumn("over_fixed", F.col("accuracy") - fixed)


def event_accuracy(df: DataFrame, group: str, actual: str, predicted: str, classes: list) -> DataFrame:
    """Accuracy and the number of predictions of each class by group."""
    hit = F.count_if(F.col(actual) == F.col(predicted))
    return df.groupBy(group).agg(F.count("*").alias("n"), hit.alias("correct"), (hit / F.count("*")).alias("accuracy"), *[F.count_if(F.col(predicted) == c).alias(f"said_{c}") for c in classes])


def best_and_worst(report: DataFrame, metric: str, name: str, k: int = 5) -> DataFrame:
    """The k rows with the largest metric and the k with the least."""
    side = lambda order, label: report.orderBy(order, name).limit(k).withColumn("side", F.lit(label))
    return side(F.desc(metric), "best").union(side(F.asc(metric), "worst"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    return df.filter(F.col(actual).isin(labels)).groupBy(actual).pivot(predicted, labels).count().na.fill(0)


def class_report(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Precision, recall, F1 and specificity of each class; a zero division is 0."""
    a, p = F.col(actual), F.col(predicted)
    each = df.withColumn("class", F.explode(F.array(*[F.lit(x) for x in labels])))
    tp, fp, fn, tn = (F.count_if(x) for x in ((a == F.col("class")) & (p == F.col("class")), (a != F.col("class")) & (p == F.col("class")), (a == F.col("class")) & (p != F.col("class")), (a != F.col("class")) & (p != F.col("class"))))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = each.groupBy("class").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("support", F.col("tp") + F.col("fn"))


def weighted_report(report: DataFrame) -> DataFrame:
    """Support-weighted averages of a class report."""
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return report.agg(w("precision"), w("recall"), w("f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve from average ranks (Mann-Whitney), by counts of distinct scores."""
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return cumulative(counts, [score], {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg")).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Pearson and Spearman correlation, R2, MAE, MSE and RMSE."""
    ranked = avg_rank(avg_rank(df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()), actual, "_ra"), predicted, "_rp")
    a, p = F.col(actual), F.col(predicted)
    err = a - p
    out = ranked.agg(F.count("*").alias("n"), pearson(a, p).alias("pearson"), pearson(F.col("_ra"), F.col("_rp")).alias("spearman"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(a).alias("_v"))
    return out.withColumn("r2", 1 - F.try_divide("mse", "_v")).withColumn("rmse", F.sqrt("mse")).drop("_v")


def regression_gaps(df: DataFrame, split: str, actual: str, predicted: str) -> DataFrame:
    """Correlation, R2, MAE and RMSE of each split, and how far each falls behind those of ``train``."""
    a, p = F.col(actual), F.col(predicted)
    err = a - p
    each = df.groupBy(split).agg(F.count("*").alias("n"), pearson(a, p).alias("pearson"), (1 - F.try_divide(F.avg(err * err), F.var_pop(a))).alias("r2"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    train = each.filter(F.col(split) == "train").agg(F.first(F.struct("pearson", "r2", "mae", "rmse"))).scalar()
    return each.withColumn("_t", train).select(*each.columns, *[(F.col(f"_t.{c}") - F.col(c)).alias(f"{c}_gap") for c in ("pearson", "r2", "mae", "rmse")])


def pearson(a: Column, p: Column) -> Column:
    """Correlation of the rows that have both; not a number where one of them doesn't vary, null without rows."""
    both = a.isNotNull() & p.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, p.cast("double"))
    # by covariance and deviations: Spark's corr divides by zero there, which is an error
    return F.when(F.count(x) > 0, F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(float("nan"))))


def magnitude_bucket(c: Column) -> Column:
    m = F.abs(c)
    return F.when(m < 1, "<1").when(m < 3, "1-3").when(m < 5, "3-5").otherwise(">=5")


def metrics_by_magnitude(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(magnitude_bucket(a).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(a - p)).alias("mae"), F.coalesce(pearson(a, p), F.lit(0.0)).alias("corr"))


def extreme_metrics(df: DataFrame, actual: str, predicted: str, id_col: str) -> DataFrame:
    """Metrics of the tenth of rows (ten at least) with the largest predictions by absolute value."""
    placed = global_position(df.withColumn("_size", F.coalesce(-F.abs(predicted), F.lit(float("inf")))), ["_size", id_col], "_r")
    top = placed.filter(F.col("_r") < F.greatest(F.lit(10), F.floor(F.col("_n") / 10)))
    a, p = F.col(actual), F.col(predicted)
    return top.agg(F.count("*").alias("n"), pearson(a, p).alias("corr"), F.avg(F.abs(a - p)).alias("mae"), F.avg((F.signum(a) == F.signum(p)).cast("double")).alias("sign_agreement"))


def confidence_curve(df: DataFrame, actual: str, probability: str, thresholds: list[float]) -> DataFrame:
    """Coverage, accuracy and precision of both classes among rows at least so sure."""
    p, sure = F.col(probability), F.greatest(F.col(probability), 1 - F.col(probability))
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).withColumns({"_in": sure >= F.col("threshold"), "_said": (p >= 0.5).cast("int")})
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(of)), F.lit(0.0))
    inside, right = F.col("_in"), F.col("_said") == F.col(actual)
    return each.groupBy("threshold").agg(
        F.count_if(inside).alias("n"),
        F.avg(inside.cast("double")).alias("coverage"),
        share(inside & right, inside).alias("accuracy"),
        share(inside & right & (F.col("_said") == 1), inside & (F.col("_said") == 1)).alias("up_precision"),
        share(inside & right & (F.col("_said") == 0), inside & (F.col("_said") == 0)).alias("down_precision"),
    )


def unclear_report(df: DataFrame, actual: str, predicted: str, unclear: str = "UNCLEAR", positive: str = "POSITIVE") -> DataFrame:
    """Accuracy with unclear answers as wrong and without them, their share, and the positive share."""
    clear, hit = F.col(predicted) != unclear, F.col(predicted) == F.col(actual)
    return df.agg(
        F.count("*").alias("n"),
        (F.count_if(hit) / F.count("*")).alias("accuracy_all"),
        F.coalesce(F.try_divide(F.count_if(hit & clear), F.count_if(clear)), F.lit(0.0)).alias("accuracy_clear"),
        F.avg((~clear).cast("double")).alias("unclear_rate"),
        F.coalesce(F.try_divide(F.count_if(F.col(predicted) == positive), F.count_if(clear)), F.lit(0.0)).alias("positive_share"),
    )


def directional_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Four classes as two directions: 0 and 1 are down, 2 and 3 are up."""
    return df.agg(F.count("*").alias("n"), F.avg(((F.col(actual) >= 2) == (F.col(predicted) >= 2)).cast("double")).alias("direction_accuracy"))


def processing_stats(df: DataFrame, year: str, status: str, value: str, cost: str, label: str, tokens: str, labels: tuple[str, ...] = ("UP", "DOWN", "STAY")) -> DataFrame:
    """Totals, successes, failures, labels, average value and tokens of what succeeded, and cost by year, and an overall row (year null)."""
    good = F.col(status) == "success"
    counts = [F.count_if(good & (F.col(label) == x)).alias(x.lower()) for x in labels]
    return df.rollup(year).agg(
        F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), *counts, F.avg(F.when(good, F.col(value))).alias("avg_value"), F.floor(F.avg(F.when(good, F.col(tokens)))).alias("avg_tokens"), F.sum(F.when(good, F.col(cost))).alias("cost")
    )


def success_stats(df: DataFrame, status: str, value: str) -> DataFrame:
    v = F.when(F.col(status) == "success", F.col(value))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("std"))


def imbalance(df: DataFrame, split: str, label: str) -> DataFrame:
    """The ratio of the largest to the smallest class, per split and overall (split null)."""
    counts = df.groupBy(split, label).count()
    both = counts.union(counts.groupBy(label).agg(F.sum("count")).select(F.lit(None).cast(counts.schema[split].dataType), label, "sum(count)"))
    return both.groupBy(split).agg(F.max("count").alias("largest"), F.min("count").alias("smallest"), (F.max("count") / F.min("count")).alias("ratio"))


def leaderboard(df: DataFrame, group: str, name: str, metric: str) -> DataFrame:
    """The best row of each group, the group's mean, and how much better the best is in per cent."""
    out = df.groupBy(group).agg(F.max_by(name, F.struct(metric, name)).alias("best"), F.max(metric).alias("best_metric"), F.avg(metric).alias("mean_metric"))
    return out.withColumn("improvement_pct", (F.col("best_metric") - F.col("mean_metric")) / F.col("mean_metric") * 100)


def lift_vs_baseline(df: DataFrame, name: str, metric: str, baseline: str, kind: str, of_kind: str) -> DataFrame:
    """Lift in per cent over one row; null for rows of other kinds."""
    base = df.filter(F.col(name) == baseline).agg(F.max(metric)).scalar()
    return df.withColumn("lift_pct", F.when(F.col(kind) == of_kind, (F.col(metric) - base) / base * 100))


def importance_by_group(df: DataFrame, group: str, name: str, coefficient: str, k: int) -> DataFrame:
    """The k largest coefficients by absolute value in each group, and the group's mean."""
    size = F.abs(coefficient)
    means = df.groupBy(F.struct(group).alias("_g")).agg(F.avg(size).alias("mean_abs"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(size.desc(), name))).filter(F.col("rank") <= k)  # Spark cuts each partition to k first
    return ranked.withColumn("_g", F.struct(group)).join(means, "_g").drop("_g")


def chunk_stats(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(F.length(text)).alias("chars"))


def predictability(a: DataFrame, b: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """The better of two accuracies over the baseline, ranked; a group is predictable over 2 points."""
    joined = a.select(key, F.col("accuracy").alias("_a")).join(b.select(key, F.col("accuracy").alias("_b")), key, "left").join(baselines.select(key, "baseline"), key)
    out = joined.withColumn("best", F.greatest("_a", "_b")).withColumn("edge", F.col("best") - F.col("baseline")).drop("_a", "_b")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edge"), key))).withColumn("predictable", F.col("edge") > 2)


def session_counts(df: DataFrame, session: str) -> DataFrame:
    return df.groupBy(session).agg(F.count("*").alias("n"))


def skew_unbiased(df: DataFrame, column: str) -> DataFrame:
    n = F.count(column)
    return df.agg((F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
