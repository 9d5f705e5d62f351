"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space characters that separate words: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Unicode White_Space, spelled out because the engines' own \s differ in U+001C to U+001F.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, in the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eventloom-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide table by Parquet files in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored: it does so when the driver collects their garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table, when all that was made of it is stored itself."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a lookup table that may be broadcast (some dozen bytes each); what has more is shuffled, but for its hot keys.
BROADCAST_ROWS = 500_000
#: A key is hot with over a ten-thousandth of all rows (and so many at least): there are 10,000 of them at most.
HOT_SHARE, HOT_LEAST = 10_000, 1_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table of one row per key, whose column ``n`` counts the key's rows and is dropped.

    A table counted to be small is broadcast. Otherwise its hot keys are, and
    only rows of other keys are shuffled, so that no task gathers a hot key.
    """
    told = facts.drop(n)
    size, total = facts.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(told), key)
    hot = facts.filter(F.col(n) > max(HOT_LEAST, total // HOT_SHARE)).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(told, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch between the JVM and Python; with texts, Spark's 10,000 are tens of megabytes, held four times over.
ARROW_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session sends Python at most ARROW_ROWS rows at a time, or fewer if it is set so."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def pieces_of(part: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about ``limit`` bytes, so that what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy()
    ends = np.searchsorted(np.cumsum(sizes), np.arange(limit, sizes.sum() + limit, limit), "right") if len(sizes) else []
    start = 0
    for end in [*ends, part.num_rows]:
        end = min(max(end, start + 1), part.num_rows)
        if end > start:
            yield part.slice(start, end - start)
        start = end


def slices_of(part: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes, so that the Python objects made of one stay few."""
    step = max(1, part.num_rows * limit // max(part.nbytes, 1))
    for start in range(0, part.num_rows, step):
        yield part.slice(start, step)


def arrow_map(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow with one function from columns to columns.

    ``make`` runs once in each task and returns the function, so that what it
    sets up (vocabularies, caches) is shared by the task's batches.
    """
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices_of(batch):
                out = apply({name: part.column(name).to_pylist() for name in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, kind)

