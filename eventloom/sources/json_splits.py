"""Large JSON arrays and objects read in splits: one file is as many tasks as its size asks for.

Spark's text reader cuts a file at every closing brace, wherever the splits
are, in any file system that it reads. What a piece means depends on whether it
begins inside a string and how deep. Each split says, for either beginning, how
it ends; put together in the files' order, a row per split, these tell where
every split begins. An entry of the outer array or object ends with the brace
that leads back to depth one: entries within a split are complete where they
are read, and only what a split begins and ends with meets its neighbours'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"(?s)\\.")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece): what stands before each closing brace, and behind the last, in the order of the file within a split."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("piece"))


def _after(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece that begins inside a string, or not, ends inside one; and how much deeper, its brace not counted.

    A brace is no escaped character in JSON, so that no escape reaches over the end of a piece.
    """
    parts = (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    outside = "".join(parts[inside::2])
    return inside ^ (len(parts) % 2 == 0), outside.count("{") + outside.count("[") - outside.count("]")


def split_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, inside, depth): whether each split begins inside a string, and how deep. A row per split leaves the tasks that read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for part in parts:
            for file, split, piece in zip(*(part.column(c).to_pylist() for c in ("file", "split", "piece"))):
                ends = held.setdefault((file, split), [[False, 0], [True, 0]])
                for end in ends:
                    end[0], deeper = _after(piece, end[0])
                    end[1] += deeper - (not end[0])
        rows = [(file, split, ends[0][0], ends[0][1], ends[1][1]) for (file, split), ends in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["file", "split", "odd", "outer", "inner"])

    sums = _pieces(spark, path).mapInArrow(run, "file string, split long, odd boolean, outer long, inner long")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))
    return known.select("file", "split", "inside", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth"))


_FOUND = "file string, split long, part long, ends boolean, opens boolean, deep long, text string"


def _walked(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, part, ends, opens, deep, text): the entries of each split, and what it begins and ends with.

    ``part`` is 0 for what belongs to the entry that the split begins in, 1 for
    complete entries and 2 for what is behind the last; ``ends`` says that the
    text ends an entry, ``opens`` that it begins with the outer bracket;
    ``deep`` is the depth before the last brace.
    """
    starts = split_starts(spark, path)
    placed = _pieces(spark, path).join(F.broadcast(starts), ["file", "split"])  # a row per split, as the scan itself has

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        inside, depth, deep, opens, number, text = False, 0, 0, False, 0, []

        def put(ends: bool) -> None:
            out.append((*at, 1 if ends and number else 2 if number else 0, ends, opens, deep, "".join(text)))
            text.clear()

        for part in parts:
            for file, split, piece, begins, deepness in zip(*(part.column(c).to_pylist() for c in ("file", "split", "piece", "inside", "depth"))):
                if (file, split) != at:
                    if at is not None:
                        put(False)  # empty where the split ends with an entry, so that the next split's belongs to no earlier one
                    at, inside, depth, opens, number = (file, split), begins, deepness, deepness == 0 and not begins, 0
                inside, deeper = _after(piece, inside)
                deep = depth + deeper
                depth = deep - (not inside)
                text += [piece, "}"]
                if depth == 1 and not inside:
                    put(True)
                    number, opens = number + 1, False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [x.split()[0] for x in _FOUND.split(", ")])
                out.clear()
        if at is not None:
            put(False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [x.split()[0] for x in _FOUND.split(", ")])

    return placed.mapInArrow(run, _FOUND)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the text of the entries of each file's outer array or object, without the outer brackets and the commas between.

    Entries that are no objects (null, numbers, lists) stand before the next
    one that is, or behind the last; a list's row then has several entries.
    Blank files give none. An entry's parts are held in one task, and so is a
    row for each split of a file.
    """
    found = _walked(spark, path)
    parts = found.filter("part <> 1")
    order = Window.partitionBy("file").orderBy("split", "part")
    # a split's last part opens what later splits go on with, up to the first that ends it
    marks = parts.select("file", "split", "part", F.coalesce(F.last(F.when(F.col("part") == 2, F.col("split")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("before"))
    named = parts.join(marks, ["file", "split", "part"]).withColumn("entry", F.when(F.col("part") == 2, F.col("split")).otherwise(F.col("before")))
    row = F.struct("split", "ends", "opens", "deep", "text")
    whole = named.groupBy("file", "entry").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = whole.select(F.element_at("rows", -1)["ends"].alias("ends"), F.col("rows")[0]["opens"].alias("opens"), F.element_at("rows", -1)["deep"].alias("deep"), F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))
    each = found.filter("part = 1").select("ends", "opens", "deep", "text").unionByName(joined)
    # the last brace of a file's rest is not its own, unless it closes the outer object
    rest = F.regexp_replace(F.expr("substring(text, 1, length(text) - 1)"), r"\s+$", "")
    rest = F.when(F.col("deep") == 0, rest.substr(F.lit(1), F.length(rest) - 1)).otherwise(rest)
    text = F.regexp_replace(F.when(F.col("ends"), F.col("text")).otherwise(rest), r"^[\s﻿]+", "")
    bare = F.when(F.col("opens") | text.startswith(","), F.substring(text, 2, 1 << 30)).otherwise(text)
    return each.select(F.regexp_replace(bare, r"^\s*,?\s*|\s+$", "").alias("entry")).filter("entry <> ''")
