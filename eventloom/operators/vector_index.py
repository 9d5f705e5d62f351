"""Nearest neighbours by an inverted file: vectors in lists around coarse centres, of which a query reads a few.

Centres are fitted on a bounded sample; every vector is put into the list of
its nearest centre and stored there, so that a query's lists are folders that
the scan prunes by. What is read is compared exactly. An exact search reads on
where the triangle inequality leaves room: a list is passed over only if its
centre is farther from the query than its radius and the k-th distance found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .retrieval import unit

#: Vectors that centres are fitted on, about; the lists depend on the sample, what an exact search finds doesn't.
SAMPLE = 100_000
#: Vectors of a list that one task compares at a time; a larger list is dealt into parts.
PART_ROWS = 50_000
#: Queries that are held against a part at a time.
QUERY_ROWS = 256
#: Slack of a bound, for rounding: distances of unit vectors are at most 2.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    """Stored lists: ``path``/vectors by list, ``path``/centres with a row for each list (its centre, radius and size)."""

    spark: SparkSession
    path: str
    schema: StructType | None = None  # needed for an index without rows

    def vectors(self) -> DataFrame:
        """(id, unit, list, and what was kept beside); vectors without a direction are in list -1."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.path}/vectors")

    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centres")


def _sampled(rows: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    share = min(1.0, most / max(rows.count(), 1))
    return rows if share == 1 else rows.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def build_index(df: DataFrame, id_col: str, vector: str, path: str, lists: int, keep: list[str] = [], sample: int = SAMPLE, rounds: int = 10, seed: int = 42) -> VectorIndex:  # noqa: B006
    """Store all rows in ``lists`` lists (fewer, if the sample has fewer places) under ``path``.

    A null vector, or one of length zero, has no direction: it is kept in list
    -1, which no search reads. The centres, at most ``lists`` of them, are the
    only thing that each task holds. Rows of a list are dealt into files of
    PART_ROWS, so that a list with most rows is many tasks.
    """
    rows = df.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("unit"), *keep)
    usable = rows.filter(F.col("unit").isNotNull()).withColumn("features", array_to_vector("unit"))
    picked = _sampled(usable, "id", sample, seed).select("features")
    root = f"{path}/vectors"
    if usable.limit(1).count():
        model = KMeans(k=max(2, lists), seed=seed, maxIter=rounds).fit(picked)
        near = model.transform(usable).withColumnRenamed("prediction", "list")
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
    else:
        near, centres = usable.withColumn("list", F.lit(-1)), []
    apart = rows.filter(F.col("unit").isNull()).withColumn("list", F.lit(-1))
    columns = ["id", "unit", *keep, "list"]
    salt = F.pmod(F.xxhash64("id"), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    whole = near.select(columns).unionByName(apart.select(columns))
    whole.repartition("list", salt).write.option("maxRecordsPerFile", PART_ROWS).partitionBy("list").parquet(root)
    index = VectorIndex(df.sparkSession, path, whole.schema)
    known = df.sparkSession.createDataFrame(list(enumerate(centres)), "list int, centre array<double>")
    apart_by = F.sqrt(F.aggregate(F.zip_with("unit", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    sizes = index.vectors().filter("list >= 0").join(F.broadcast(known), "list").groupBy("list").agg(F.count("*").alias("size"), F.max(apart_by).alias("radius"))
    known.join(sizes, "list", "left").select("list", "centre", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("radius", F.lit(0.0)).alias("radius")).coalesce(1).write.parquet(f"{path}/centres")
    return index


def _probes(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(q, v, list, size, parts, least): each query with every list that has rows, and the least distance that the list's rows can have."""
    held = index.centres().filter("size > 0").collect()  # as many rows as there are lists
    at = np.array([r["centre"] for r in held]).reshape(len(held), -1)
    numbers, radius = np.array([r["list"] for r in held], np.int32), np.array([r["radius"] for r in held])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, QUERY_ROWS):
                piece = part.slice(start, QUERY_ROWS)
                v = np.array(piece.column("v").to_pylist(), float)
                far = np.sqrt(np.maximum(0, ((v[:, None] - at[None]) ** 2).sum(axis=2)))
                place = far.argsort(axis=1, kind="stable").argsort(axis=1)
                own = pa.array(np.repeat(np.arange(piece.num_rows), len(numbers)))
                yield pa.RecordBatch.from_arrays([piece.column("q").take(own), piece.column("v").take(own), pa.array(np.tile(numbers, piece.num_rows)), pa.array(np.maximum(0, far - radius).reshape(-1)), pa.array(place.reshape(-1))], ["q", "v", "list", "least", "place"])

    kind = queries.schema["q"].dataType.simpleString()
    return queries.mapInArrow(run, f"q {kind}, v array<double>, list int, least double, place long")


def _found(index: VectorIndex, probes: DataFrame, k: int, where: str | None) -> DataFrame:
    """(q, id, score): the k best of each query among the lists that it probes, best first in each part before they meet.

    A list's parts and its queries meet by list and part; queries are sent to
    every part of their lists, vectors once.
    """
    parts = index.centres().filter("size > 0").select("list", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts"))
    read = [r["list"] for r in probes.select("list").distinct().collect()]  # as many as there are lists at most; the scan prunes by them
    rows = index.vectors().filter(F.col("list").isin(read) if read else F.lit(False))
    rows = (rows if where is None else rows.filter(where)).join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "unit")
    asked = probes.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q", "v")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = left.column("id").combine_chunks(), []
        if left.num_rows and right.num_rows:
            at = np.stack(left.column("unit").to_numpy())
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # ties go to the smaller id
            ids, at = ids.take(pa.array(order)), at[order]
            for start in range(0, right.num_rows, QUERY_ROWS):
                piece = right.slice(start, QUERY_ROWS)
                score = np.round(np.stack(piece.column("v").to_numpy()) @ at.T, 9)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                own = np.repeat(np.arange(piece.num_rows), best.shape[1])
                out.append(pa.table([piece.column("q").combine_chunks().take(pa.array(own)), ids.take(pa.array(best.reshape(-1))), pa.array(np.take_along_axis(score, best, 1).reshape(-1))], ["q", "id", "score"]))
        return pa.concat_tables(out) if out else pa.table([right.column("q").slice(0, 0), left.column("id").slice(0, 0), pa.array([], pa.float64())], ["q", "id", "score"])

    kinds = f"q {asked.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return rows.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(compare, kinds)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int = 10, probes: int = 8, exact: bool = False, where: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of largest cosine to each query (scores to nine places, ties by id) in the ``probes`` lists nearest to it.

    ``exact`` reads a second time those lists that may hold a row nearer than
    the k-th of the first. ``where`` keeps rows by columns that the index holds
    beside. A query without a direction finds nothing, nor does one of another
    length than the vectors'; query ids are distinct.
    """
    asked = queries.select(F.col(query_id).alias("q"), unit(F.col(query_vector)).alias("v")).filter(F.col("v").isNotNull())
    width = index.centres().select(F.size("centre").alias("n")).first()
    if width is None:
        return index.vectors().limit(0).select(F.lit(None).cast(asked.schema["q"].dataType).alias(query_id), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked = asked.filter(F.size("v") == width["n"])
    every = _probes(index, asked)
    first = _found(index, every.filter(F.col("place") < probes), k, where)
    best = _best(first, k)
    if exact:
        # a cosine's distance on the unit sphere; a query that has not found k rows yet reads on everywhere
        bound = best.groupBy("q").agg(F.count("*").alias("n"), F.sqrt(F.greatest(2 - 2 * (F.min("score") - 1e-9), F.lit(0.0))).alias("far"))
        more = every.filter(F.col("place") >= probes).join(bound, "q", "left").filter(F.col("far").isNull() | (F.col("n") < k) | (F.col("least") <= F.col("far") + SLACK)).select("q", "v", "list")
        best = _best(best.drop("rank").unionByName(_found(index, more, k, where)), k)
    return best.select(F.col("q").alias(query_id), "id", "score", "rank")


def recall(found: DataFrame, truth: DataFrame, query_id: str) -> float:
    """The share of the true neighbours (query, id) that were found."""
    hits = truth.select(query_id, "id").join(found.select(query_id, "id").distinct().withColumn("_hit", F.lit(1.0)), [query_id, "id"], "left")
    return hits.agg(F.avg(F.coalesce("_hit", F.lit(0.0)))).first()[0]
