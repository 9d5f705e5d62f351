"""Spark ML models with the penalties, presets and experiment tables of the study."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .features import term_vectors, term_weights

#: Forest presets, from loose to strict.
FOREST_PRESETS = {
    "light": {"maxDepth": 10, "minInstancesPerNode": 5, "numTrees": 100},
    "medium": {"maxDepth": 7, "minInstancesPerNode": 20, "numTrees": 100},
    "strong": {"maxDepth": 4, "minInstancesPerNode": 50, "numTrees": 100},
}


@dataclass(frozen=True)
class TextModel:
    """A fitted vocabulary and the stages behind it, which are saved and loaded together."""

    known: DataFrame
    model: PipelineModel
    id_col: str
    text_col: str

    @classmethod
    def fit(cls, train: DataFrame, id_col: str, text_col: str, stages: list, known: DataFrame) -> TextModel:
        return cls(known, Pipeline(stages=stages).fit(with_text_vector(train, id_col, text_col, known)), id_col, text_col)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(with_text_vector(df, self.id_col, self.text_col, self.known))

    def save(self, path: str) -> None:
        self.known.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.model.write().overwrite().save(f"{path}/stages")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str, text_col: str) -> TextModel:
        return cls(spark.read.parquet(f"{path}/vocabulary"), PipelineModel.load(f"{path}/stages"), id_col, text_col)


def with_text_vector(df: DataFrame, id_col: str, text_col: str, known: DataFrame, keep_text: bool = True) -> DataFrame:
    """``df`` with its texts' TF-IDF over a fitted vocabulary as a sparse vector ``text_vector``; the texts themselves need not be joined with it."""
    return term_vectors(df if keep_text else df.drop(text_col), id_col, term_weights(df, id_col, text_col, known), known)


def feature_sets(numeric: list[str], market: list[str]) -> dict[str, VectorAssembler]:
    """Three ablation sets: text only, text and numeric, text and numeric and market columns."""
    sets = {"text": [], "text_numeric": numeric, "all": [*numeric, *market]}
    return {name: VectorAssembler(inputCols=["text_vector", *columns], outputCol="features", handleInvalid="keep") for name, columns in sets.items()}


def embed_features(df: DataFrame, vector: str, columns: list[str]) -> DataFrame:
    """An embedding with (already scaled) columns behind it as one vector."""
    return VectorAssembler(inputCols=["_e", *columns], outputCol="features").transform(df.withColumn("_e", array_to_vector(F.col(vector).cast("array<double>")))).drop("_e")


def logreg(n: int, c: float = 1.0, weight: str | None = None, **kw) -> LogisticRegression:
    """L2 with inverse strength C over n rows."""
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100, **kw)
    return model.setWeightCol(weight) if weight else model


def forest(preset: str, regression: bool = False, seed: int = 42, **kw) -> Estimator:
    if preset not in FOREST_PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    return (RandomForestRegressor if regression else RandomForestClassifier)(seed=seed, **(FOREST_PRESETS[preset] | kw))


def linear(kind: str, alpha: float, n: int, spread: float = 1.0, **kw) -> LinearRegression:
    """ridge, lasso or elastic net over n rows; a ridge penalty is a sum over rows, so it is divided by them.

    Spark divides a squared penalty by the label's standard deviation, which is given as ``spread``.
    """
    mix = {"ridge": 0.0, "lasso": 1.0, "elastic": 0.5}[kind]
    absolute, squared = alpha * mix, (alpha / n if kind == "ridge" else alpha * (1 - mix)) * spread
    return LinearRegression(regParam=absolute + squared, elasticNetParam=absolute / (absolute + squared or 1.0), standardization=False, **kw)


def boosted(**kw) -> GBTRegressor:
    return GBTRegressor(**({"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 10, "seed": 42} | kw))


def mlp(inputs: int, classes: int = 2, hidden: tuple[int, ...] = (256, 128), **kw) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], seed=42, **kw)


def adaptive_features(n: int) -> dict[str, int]:
    """Vocabulary and least document frequency for a group of n training rows."""
    return {"max_features": max(1, min(2000, n // 2)), "min_df": max(2, min(5, n // 100))}


def fit_per_group(train: DataFrame, test: DataFrame, group: str, values: Iterable | None, make: Callable[[int], Estimator], least_train: int = 50, least_test: int = 10, label: str | None = None, prepare: Callable = lambda train, test, n: (train, test), path: str | None = None) -> dict[str, DataFrame]:
    """Predictions of a model of each group (of each listed one, if ``values`` are given) that has enough rows on both sides and, with ``label``, both classes in the test rows.

    ``prepare`` makes a group's features from its own rows. Any estimator does,
    at a fit for each group, the largest first. Under ``path``, rows are stored
    by group before, so that a fit reads its own only, however many groups there
    are. For linear and logistic models of all groups at once see
    ``linear_groups`` and ``logistic_groups``.
    """
    kinds = F.countDistinct(label) if label else F.lit(2)
    listed = F.col(group).isNotNull() if values is None else F.col(group).isin(list(values))
    sizes = lambda df: df.filter(listed).groupBy(group).agg(F.count("*").alias("n"), kinds.alias("kinds"))
    enough = sizes(train).filter(F.col("n") >= least_train).join(sizes(test).filter((F.col("n") >= least_test) & (F.col("kinds") > 1)).select(group), group)
    ready = {r[group]: r["n"] for r in enough.orderBy(F.desc("n"), group).collect()}  # a row for each model
    sides = [(df, F.col(group)) for df in (train, test)]
    keys = {v: v for v in ready}
    if path and ready:
        keys = {v: i for i, v in enumerate(ready)}
        numbered = train.sparkSession.createDataFrame(list(keys.items()), StructType([train.schema[group], StructField("_at", IntegerType())]))
        for name, df in (("train", train), ("test", test)):
            df.join(F.broadcast(numbered), group).select(*df.columns, "_at").write.partitionBy("_at").parquet(f"{path}/{name}")
        sides = [(train.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_at", IntegerType())])).parquet(f"{path}/{name}"), F.col("_at")) for name, df in (("train", train), ("test", test))]
    out = {}
    for v, n in ready.items():
        own, other = prepare(*[df.filter(of == keys[v]).drop("_at") for df, of in sides], n)
        out[v] = make(n).fit(own).transform(other)
    return out


#: Numbers of all groups' statistics that come to the driver in one step.
MOST_STATISTICS = 20_000_000


def _summed(rows: DataFrame, made: Callable[[np.ndarray, np.ndarray, tuple], np.ndarray], held: dict) -> dict[tuple, np.ndarray]:
    """The sums, by group, of ``made(x, y, group)``, an array of fixed size, over all rows: added up in each task first, then by Spark."""
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for part in parts:
            keys = part.column("g").dictionary_encode()
            names, at = keys.dictionary.to_pylist(), keys.indices.to_numpy()
            x, y = np.stack(part.column("x").to_numpy(zero_copy_only=False)), part.column("y").to_numpy()
            for i, name in enumerate(names):
                own = at == i
                sums[name] = sums.get(name, 0) + made(x[own], y[own], sent.value.get(name))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["g", "s"])

    kind = rows.schema["g"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"g {kind}, s array<double>").select("g", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
    whole = parts.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("s"))
    return {r["g"]: np.array(r["s"]) for r in whole.collect()}


def _group_rows(df: DataFrame, group: str, columns: list[str], label: str) -> tuple[DataFrame, int]:
    """(g, x, y) with a constant behind the columns, and x's length; rows that lack a value go."""
    number = lambda c: F.col(c).cast("double")
    rows = df.select(F.col(group).alias("g"), F.array(*[number(c) for c in columns], F.lit(1.0)).alias("x"), number(label).alias("y"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    d, groups = len(columns) + 1, df.select(F.approx_count_distinct(group)).first()[0]
    if groups * (d * d + d + 2) > MOST_STATISTICS:
        raise ValueError(f"{groups} groups of {d} columns have more than {MOST_STATISTICS} statistics; fit fewer groups at a time")
    return rows, d


def _coefficients(spark: SparkSession, columns: list[str], found: dict, kind: str) -> DataFrame:
    rows = [(g, n, *[float(v) for v in w]) for g, (n, w) in found.items()]
    return spark.createDataFrame(rows, f"g {kind}, n long, " + ", ".join(f"`{c}` double" for c in [*columns, "intercept"]))


def linear_groups(df: DataFrame, group: str, columns: list[str], label: str, alpha: float = 0.0) -> DataFrame:
    """(g, n, coefficients, intercept) of a least-squares fit for every group, ridge with ``alpha`` (the intercept is free), in one scan.

    A task adds up a Gram matrix for each of its groups, and Spark adds these up.
    """
    rows, d = _group_rows(df, group, columns, label)
    sums = _summed(rows, lambda x, y, _: np.r_[len(x), (x.T @ x).reshape(-1), x.T @ y], {})
    free = np.diag([alpha] * (d - 1) + [0.0])
    fitted = {g: (int(s[0]), np.linalg.lstsq(s[1 : 1 + d * d].reshape(d, d) + free, s[1 + d * d :], rcond=None)[0]) for g, s in sums.items()}
    return _coefficients(df.sparkSession, columns, fitted, rows.schema["g"].dataType.simpleString())


def logistic_groups(df: DataFrame, group: str, columns: list[str], label: str, c: float = 1.0, steps: int = 30, close: float = 1e-10) -> DataFrame:
    """(g, n, coefficients, intercept) of a logistic regression (L2 with inverse strength C, a free intercept) for every group at once.

    Newton's steps: a scan gives every group's gradient and Hessian, so that the
    scans are as many as the slowest group's steps, however many groups there
    are. A group with one class only has no finite fit and is left out.
    """
    rows, d = _group_rows(df, group, columns, label)
    free = np.array([1.0 / c] * (d - 1) + [0.0])

    def step(x: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        if w is None:
            return np.zeros(2 + d + d * d)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        loss = np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum()
        return np.r_[len(x), loss, x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)]

    counts = {r["g"]: (r["n"], r["up"]) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("up")).collect()}
    fitted = {g: (n, np.zeros(d)) for g, (n, up) in counts.items() if 0 < up < n}
    open_, best = dict.fromkeys(fitted, 1.0), {g: (np.inf, w, w) for g, (_, w) in fitted.items()}
    for _ in range(steps):
        if not open_:
            break
        sums = _summed(rows, step, {g: fitted[g][1] for g in open_})
        for g in list(open_):
            n, w = fitted[g]
            loss = sums[g][1] + (free * w * w).sum() / 2
            if loss > best[g][0] + 1e-9 * abs(best[g][0]):  # too far: half the way
                _, at, move = best[g]
                best[g] = (best[g][0], at, move / 2)
                fitted[g] = (n, at - move / 2)
                continue
            slope, bend = sums[g][2 : 2 + d] + free * w, sums[g][2 + d :].reshape(d, d) + np.diag(free)
            move = np.linalg.lstsq(bend, slope, rcond=None)[0]
            best[g] = (loss, w, move)
            fitted[g] = (n, w - move)
            if np.abs(move).max() < close:
                del open_[g]
    return _coefficients(df.sparkSession, columns, fitted, rows.schema["g"].dataType.simpleString())


def run_experiments(train: DataFrame, test: DataFrame, models: dict[str, Estimator], score: Callable[[DataFrame], float], predict: Callable = lambda model, df: model.transform(df)) -> DataFrame:
    """Fit each model; rows (model, train_score, test_score, gap). Scores are of ``predict``'s rows."""
    rows = []
    for name, estimator in models.items():
        fitted = estimator.fit(train)
        a, b = (float(score(predict(fitted, x))) for x in (train, test))
        rows.append((name, a, b, a - b))
    return train.sparkSession.createDataFrame(rows, "model string, train_score double, test_score double, gap double")


def grid_search(results: DataFrame, most_gap: float) -> DataFrame:
    """The best validation score among runs that overfit less than a limit."""
    return results.filter(F.col("gap") < most_gap).orderBy(F.desc("test_score"), "model").limit(1)


def score(model: PipelineModel, df: DataFrame, floor: float = 0.1, name: str = "predicted") -> DataFrame:
    return model.transform(df).withColumn(name, F.greatest(F.col("prediction"), F.lit(floor)))


def feature_importance(model, names: list[str], spark, k: int = 20) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)
