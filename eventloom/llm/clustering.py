"""Centroid clustering with a progressive search over Walsh-Hadamard coefficients.

Vectors and centroids are integers and are transformed exactly. As the
transform keeps squared distances up to the factor of its length, the sum of
squared differences of some coefficients, the coarse ones first, is a lower
bound of a distance: a centroid goes as soon as its sum is over the whole
distance of a centroid already known. What is left has met all coefficients,
so that ties stay exact. A cluster's sum is the inverse transform of the sum of
its coefficients, so that the rounds read nothing but the transformed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, materialized, slices_of, small_batches, stored

#: Scaled components beyond this have no exact squared distance in 64 bits once transformed.
LARGEST = 1 << 24
#: Coefficients that all centroids meet before any is dropped; each later level has twice as many.
COARSE = 8


def sequency(n: int) -> np.ndarray:
    """The places of Walsh functions in a transform of ``n`` (a power of two), by their number of sign changes."""
    signs = transformed(np.eye(n, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, exact for integers; applied twice it multiplies by the length."""
    n, half = x.shape[1], 1
    while half < n:
        pair = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def coefficients(x: np.ndarray) -> np.ndarray:
    """Transformed rows, coarse coefficients first."""
    return transformed(x)[:, sequency(x.shape[1])]


def components(w: np.ndarray) -> np.ndarray:
    """The inverse of ``coefficients``."""
    n = w.shape[1]
    back = np.empty_like(w)
    back[:, sequency(n)] = w
    return transformed(back) // n


def nearest(w: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (ties: the smaller number) and its squared distance, in coefficients; and how many squares were added."""
    n, k = len(w), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    width, level = w.shape[1], min(COARSE, w.shape[1])
    part = ((w[:, None, :level] - centroids[None, :, :level]) ** 2).sum(axis=2)
    guess = part.argmin(axis=1)
    bound = part[np.arange(n), guess] + ((w[:, level:] - centroids[guess, level:]) ** 2).sum(axis=1)
    row, own = np.nonzero(part <= bound[:, None])
    sums, added = part[row, own], n * (k * level + width - level)
    while level < width:
        upto = min(2 * level, width)
        sums = sums + ((w[row, level:upto] - centroids[own, level:upto]) ** 2).sum(axis=1)
        added += len(row) * (upto - level)
        level = upto
        alive = sums <= bound[row]
        row, own, sums = row[alive], own[alive], sums[alive]
    order = np.lexsort((own, sums, row))
    first = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])]
    return own[first], sums[first], added


def _each(table: DataFrame, centroids: np.ndarray, names: list[str], schema: str | StructType, made: Callable) -> DataFrame:
    """mapInArrow over slices of the transformed table: ``made(part, coefficients, cluster, distance)`` gives the columns."""
    width = centroids.shape[1]
    held = table.sparkSession.sparkContext.broadcast(centroids)  # k times the vectors' length

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            w = part.column("w").flatten().to_numpy().astype(np.int64).reshape(-1, width)
            cluster, distance, _ = nearest(w, held.value)
            yield pa.RecordBatch.from_arrays(made(part, w, cluster, distance // width), names)

    return table.mapInArrow(run, schema)


def _sums(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cluster's size and sum of coefficients: rows per slice and cluster are added up by Spark, k times ``width`` of them come to the driver."""
    k, width = centroids.shape

    def made(part: pa.RecordBatch, w: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> list[pa.Array]:
        total = np.zeros((k, width), np.int64)
        np.add.at(total, cluster, w)
        sizes = np.bincount(cluster, minlength=k)
        got = np.flatnonzero(sizes)
        return [pa.array(got), pa.array(sizes[got]), pa.array(list(total[got]), pa.list_(pa.int64()))]

    parts = _each(table, centroids, ["cluster", "n", "sums"], "cluster long, n long, sums array<bigint>", made)
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    # sums of 64-bit values may pass 64 bits over a whole table
    rows = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sizes, sums = np.zeros(k, object), np.zeros((k, width), object)
    for row in rows:
        sizes[row["cluster"]], sums[row["cluster"], row["i"]] = row["n"], int(row["s"])
    return sizes, sums


def usable(vectors: DataFrame, id_col: str, vector_col: str, length: int, scale: int) -> DataFrame:
    """(id, x): the vectors that have ``length`` components, none null or not finite, scaled and rounded down."""
    at, limit = F.col(f"`{vector_col}`").cast("array<double>"), F.lit(float("inf"))
    fine = (F.size(at) == length) & F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    # whether a vector is usable decides before its components are scaled
    x = F.when(fine, F.transform(at, lambda c: F.floor(c * scale)))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).filter(F.col("x").isNotNull())


def seeds(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<salt>:<id>``, in that order; equal ids by their components."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select("x", mark.alias("mark")).orderBy("mark", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, length: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Lloyd's rounds on integer vectors: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors with another number of components than ``length`` (a power of two),
    or with a null or not finite one, give no row; a component is
    floor(scale * x). The first centroids are the ``k`` vectors whose
    ``<salt>:<id>`` has the least hash (all, if there are fewer). A round puts
    every vector to its nearest centroid, ties to the smaller number, and takes
    each cluster's mean, rounded down; an empty cluster keeps its centroid. Equal
    centroids, repeated rows and null ids (hashed as empty) are like others;
    other columns are not read; an empty table gives no rows. A scaled component
    over 2**24, whose distances would not be exact, raises ValueError.

    The table is transformed and stored once; a round reads it, adds up
    coefficients in each task and brings k times ``length`` sums to the driver. No vector is
    shuffled, so a cluster with most vectors costs no more than another. Rounds
    end early when no centroid moves, as all later ones would be the same.
    """
    kept = usable(vectors, id_col, vector_col, length, scale)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            x = part.column("x").flatten().to_numpy().reshape(-1, length)
            if ((x > LARGEST) | (x < -LARGEST)).any():
                raise ValueError(f"a scaled component is over {LARGEST}")
            w = pa.array(coefficients(x).reshape(-1), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * length, w)], ["id", "w"])

    table = stored(small_batches(kept).mapInArrow(run, f"id {id_type}, w array<bigint>"))
    at = seeds(kept, k, salt)
    if not len(at):
        return table.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        sizes, sums = _sums(table, coefficients(at))
        totals = components(sums)
        new = at.copy()
        for c in range(len(at)):
            if sizes[c]:
                new[c] = [int(v) // int(sizes[c]) for v in totals[c]]
        if (new == at).all():
            break
        at = new

    def made(part: pa.RecordBatch, w: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> list[pa.Array]:
        return [part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]

    done = materialized(_each(table, coefficients(at), ["id", "cluster", "distance"], f"id {id_type}, cluster int, distance long", made))
    discard(table)
    inertia = {r["cluster"]: r["sum"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in at.tolist()]
    facts = [(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)]
    told = done.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
