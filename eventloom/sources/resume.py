"""Resumable results: batches committed once, each with a Bloom filter of its keys.

A batch's rows are written first and its filter last: a batch without a filter
was broken off and counts for nothing. On a new start the filters are merged;
rows whose key none of them may hold are left without a look at the finished
keys, and only the others meet them in an exact anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists


@dataclass(frozen=True)
class ResultStore:
    """Results by ``key`` under ``path``. The merged filter has ``bits`` bits (a multiple of 64) and is broadcast, 2 MB by default; one that is too full only sends more rows to the join."""

    spark: SparkSession
    path: str
    key: str
    bits: int = 1 << 24
    hashes: int = 5

    def _places(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)])

    def commit(self, rows: DataFrame, batch: str) -> None:
        """Store a batch; its filter, a row for each 64 bits that are not empty, is what commits it. A committed batch raises."""
        if exists(self.spark, f"{self.path}/filters/batch={batch}/_SUCCESS"):
            raise ValueError(f"batch {batch} is committed")
        folder = f"{self.path}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        place = self.spark.read.parquet(folder).select(F.explode(self._places()).alias("p"))
        words = place.groupBy(F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("mask"))
        words.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")

    def committed(self) -> list[str]:
        """Names of the committed batches, of which there is a folder each."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters/batch=*/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(str(f.getPath().getParent().getName()).removeprefix("batch=") for f in found or [])

    def _read(self, kind: str, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/batch={b}" for b in batches])

    def finished(self) -> DataFrame | None:
        """All rows of committed batches."""
        batches = self.committed()
        return self._read("rows", batches) if batches else None

    def possible(self, df: DataFrame) -> DataFrame:
        """Add ``_may``: false only where no committed batch has the key."""
        batches = self.committed()
        if not batches:
            return df.withColumn("_may", F.lit(False))
        merged = self._read("filters", batches).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        every = self.spark.range(self.bits // 64).select(F.col("id").cast("int").alias("word")).join(merged, "word", "left")
        words = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))), lambda x: x["mask"]).alias("_words"))
        held = lambda p: F.getbit(F.col("_words")[F.floor(p / 64).cast("int")], (p % 64).cast("int")) == 1
        return df.crossJoin(F.broadcast(words)).withColumn("_may", F.col(self.key).isNotNull() & F.forall(self._places(), held)).drop("_words")

    def remaining(self, df: DataFrame) -> DataFrame:
        """Rows whose key is in no committed batch; rows without a key remain."""
        done = self.finished()
        if done is None:
            return df
        told = self.possible(df)
        unsure = told.filter("_may").drop("_may").join(done.select(self.key), self.key, "left_anti")
        return told.filter("NOT _may").drop("_may").unionByName(unsure)
