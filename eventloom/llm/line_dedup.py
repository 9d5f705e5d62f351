"""Line deduplication over levelled sorted runs of line hashes.

A store keeps how many documents hold each line, as runs of (hash, documents)
sorted by hash. A batch of documents is reduced to its own sorted run; lines
that the store has already found in enough documents are sealed and
merge-anti-joined away, the rest is added as a new run. When a level holds
enough runs they are compacted into one run of the next level, and lines that
reach the limit move to the sealed runs. What is sealed after the last
compaction is exactly the set of lines that too many documents share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ASCII_SPACE, BROADCAST_ROWS, materialized, slices_of, small_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("h1", "h2")
#: Two levels of compaction: batches after the third meet sealed lines.
BATCHES, FANOUT = 9, 3


def line_keys(text: F.Column) -> F.Column:
    """The keys of a text's lines: stripped of ASCII white space, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(low, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def hashed(key: F.Column) -> F.Column:
    """128 bits of a key, of two independent hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key, F.length(key)).alias("h2"))


def exploded(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(line_keys(F.col(text_col))).alias("pos", "key")).filter(F.length("key") >= min_chars)
    return lines.select("id", "pos", hashed(F.col("key")).alias("h")).select("id", "pos", "h.h1", "h.h2")


class LineRuns:
    """Levelled sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, fanout: int = FANOUT):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.sealed: list[DataFrame] = []

    def batch_run(self, docs: DataFrame, text_col: str) -> DataFrame:
        """Documents of the batch that hold each line; each document counts once for a line."""
        keys = F.array_distinct(F.transform(F.filter(line_keys(F.col(text_col)), lambda x: F.length(x) >= self.min_chars), hashed))
        return docs.select(F.explode(keys).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("docs"))

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Add a batch: merge-anti-join its sorted run with all sealed runs, store the rest as a run, compact full levels."""
        run = self.batch_run(docs, text_col)
        if self.sealed:
            run = run.join(reduce(DataFrame.unionAll, self.sealed), list(KEY), "left_anti")
        self.levels[0].append(materialized(run.sortWithinPartitions(*KEY)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level; what reached the limit is sealed, the rest is one run of the next level."""
        runs = self.levels[level]
        merged = materialized(reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(F.sum("docs").alias("docs")).sortWithinPartitions(*KEY))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level] = []
        self.levels[level + 1].append(merged.filter(F.col("docs") < self.min_docs))
        self.sealed.append(merged.filter(F.col("docs") >= self.min_docs).select(*KEY))

    def shared_lines(self) -> DataFrame:
        """(h1, h2) of all lines in at least ``min_docs`` documents of all batches."""
        left = [(level, run) for level, runs in enumerate(self.levels) for run in runs]
        found = list(self.sealed)
        if len(left) > 1:
            whole = reduce(DataFrame.unionAll, [run for _, run in left]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))
            found.append(whole.filter(F.col("docs") >= self.min_docs).select(*KEY))
        elif left and left[0][0] == 0:  # a run that a compaction made has no line over the limit
            found.append(left[0][1].filter(F.col("docs") >= self.min_docs).select(*KEY))
        return materialized(reduce(DataFrame.unionAll, found).sortWithinPartitions(*KEY))


def batches(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """Cut the documents into ``n`` batches that together are all rows.

    Integer ids are cut into ranges, which a sorted table's scan prunes by;
    other ids are dealt by their hash, where each batch reads the table.
    """
    if n < 2:
        return [docs]
    at = F.col(id_col)
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        return [docs.filter(F.pmod(F.xxhash64(at), F.lit(n)) == i) for i in range(n)]
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return [docs]
    cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
    spans = [(at < cuts[0]) | at.isNull(), *[(at >= a) & (at < b) for a, b in zip(cuts, cuts[1:])], at >= cuts[-1]]
    return [docs.filter(x) for x in spans]


def shared_lines(batched: Iterable[DataFrame], spark: SparkSession, min_docs: int, min_chars: int = 1, text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    runs = LineRuns(spark, min_docs, min_chars, fanout)
    for batch in batched:
        runs.add(batch, text_col)
    return runs.shared_lines()


def line_dedup(docs: DataFrame, min_docs: int, min_chars: int = 1, n_batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the lines that too many documents share: (row, text, n_lines, n_dropped).

    ``row`` has the document's other columns, ``text`` the lines that stay.
    Lines whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents go from every document; the others stay as
    they are, joined by newlines. A null or empty text is one empty line.
    Repeated rows count as a document each and each keep a row, null ids
    included; an empty table gives no rows; as the other columns travel inside
    ``row``, their names can't clash.

    Counts are pre-aggregated before each shuffle, so a line that most documents
    hold is one row per task. The lines that are shared are broadcast where they
    are counted to be few, so that a line of most documents is no hot key. Only
    hashes travel to the counting, and to the verdicts where the shared lines
    are many; the text moves once, to meet the positions that it loses.
    """
    shared = shared_lines(batches(docs, id_col, n_batches), docs.sparkSession, min_docs, min_chars, text_col)
    few = shared.count() <= BROADCAST_ROWS  # lines that most documents hold then meet it where they are
    mark = F.xxhash64(F.col(text_col))  # what a text loses depends on the text alone, should rows share an id
    lost = exploded(docs.withColumn(id_col, F.struct(F.col(id_col).alias("id"), mark.alias("mark"))), id_col, text_col, min_chars).join(F.broadcast(shared) if few else shared, list(KEY), "left_semi")
    drops = lost.groupBy("id").agg(F.collect_set("pos").alias("drop"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*rest).alias("row"), F.struct(F.col(id_col).alias("id"), mark.alias("mark")).alias("id"), F.col(text_col).alias("text"))
    joined = whole.join(drops, "id", "left").select("row", "text", "drop")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for whole in parts for piece in slices_of(whole)):
            texts, sizes, dropped = [], [], []
            for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
                lines = (text or "").split("\n")
                sizes.append(len(lines))
                dropped.append(len(drop or ()))
                if drop:
                    gone = set(drop)
                    lines = [x for i, x in enumerate(lines) if i not in gone]
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return small_batches(joined).mapInArrow(run, schema)


def without_shared_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, n_batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, its texts without the lines that too many documents share."""
    done = line_dedup(docs, min_docs, min_chars, n_batches, id_col, text_col)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
