"""Best-fit decreasing packing of token sequences.

Piece lengths are integers up to the capacity, so the placement of any number
of pieces follows from the counts of their lengths alone. The planner places
lengths from the longest down; a segment tree over remaining capacities finds
the tightest open bin in logarithmic time, and all bins with one fill history
move as one interval, so that the plan is exactly what piece-by-piece
best-fit decreasing would do. Spark ranks the pieces of each length and reads
each piece's bin and offset from the plan.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import _ODD, _UNIT, KEPT_CHARS, halves
from .common import arrow_map, materialized, shuffle_width
from .token_counts import byte_symbols

#: Units that a worker keeps (of KEPT_CHARS at most).
CACHED_UNITS = 150_000


class CapacityTree:
    """Remaining capacities that have open bins; finds the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        while not self.open[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, first bin, pieces a bin, offset in the bin), sorted by size and rank.

    The pieces of a size with ranks from a row's first rank up to the next
    row's go to consecutive bins. A bin is touched by a size at most once, and
    each touch at least halves its remaining capacity, while a size cuts at
    most three intervals anew: the plan has at most
    4 * capacity * log2(capacity) rows, whatever the number of pieces.
    """
    tree, waiting = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    rows, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            waiting[remaining].append((first, n))
            tree.set(remaining, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.tightest(size)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = waiting[remaining].pop()
                if not waiting[remaining]:
                    tree.set(remaining, False)
            each = remaining // size
            whole = min(n, left // each)
            for first_bin, m, a_bin in ((first, whole, each), (first + whole, int(whole < n and left > whole * each), left - whole * each)):
                if m:
                    rows.append((size, rank, first_bin, a_bin, capacity - remaining))
                    rank, left = rank + m * a_bin, left - m * a_bin
                    put(remaining - a_bin * size, first_bin, m)
                    first, n = first_bin + m, n - m
            put(remaining, first, n)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def units_of(text: str) -> list[str]:
    """Runs of white space with the word behind them: the split pattern always starts a match where one begins."""
    if not text or _ODD.search(text):
        return _UNIT.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def byte_ranks(vocabulary: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by bytes, and special tokens, of a tokenizers file whose byte-level ids are in the order of its merges."""
    spec = json.loads(vocabulary)
    vocab = spec["model"]["vocab"]
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in special}, special


class UnitEncoder:
    """Token ids of whole texts; each unit of a text is encoded when it is first met.

    Units are cut where the split pattern always starts a new match (between a
    non-space and a space), so their ids do not depend on their surroundings.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks, special = byte_ranks(vocabulary)
        self.library = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.known: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        if both := halves(text):
            code = self.known.get(both[0]) or self.unit(both[0])
            code += self.known.get(both[1]) or self.unit(both[1])
        else:
            code = array("I", self.library.encode(text, allowed_special="all")).tobytes()
        if len(text) <= KEPT_CHARS:
            if len(self.known) >= CACHED_UNITS:
                self.known.clear()
            self.known[text] = code
        return code

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        get, unit = self.known.get, self.unit
        return b"".join([get(u) or unit(u) for u in units_of(text)])


@lru_cache(maxsize=4)
def shared_encoder(vocabulary: bytes, pattern: str) -> UnitEncoder:
    """One encoder for each Python worker, so that later tasks start with its known units."""
    return UnitEncoder(vocabulary, pattern)


def token_pieces(docs: DataFrame, vocabulary: bytes, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each document's ids (``end_id`` last): doc_id, piece, start, length, ids, ids_crc32.

    Only documents longer than the capacity are cut; of those the first piece
    takes the remainder and the others are full.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = shared_encoder(held.value, pattern)

        def apply(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for key, text in zip(batch["id"], batch["text"]):
                code = encoder.encode(text or "") + end
                n = len(code) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for k, v in zip(out, (key, piece, a, b - a, zlib.crc32(code[4 * a : 4 * b]))):
                        out[k].append(v)
            return out

        return apply

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long", make)


def bucketed(pieces: DataFrame, width: int) -> DataFrame:
    """Add ``bucket``, by a hash of the piece; pieces without an id are told apart by their place."""
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    return pieces.withColumn("_place", place).withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "_place"), F.lit(width)).cast("int")).drop("_place")


def packed(docs: DataFrame, vocabulary: bytes, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: id, piece (from 0), start (its document's ids before
    it), length, ids_crc32, sequence_id (from 0, gapless), offset (its place in
    the sequence, gapless from 0). A null text is empty and still takes the
    one token ``end_id``; repeated rows and null ids are packed like any other
    row; an empty table gives no rows; other columns are not read.

    Only two tables leave the executors' row streams: counts by length (at
    most ``capacity`` rows, to the driver) and the plan, whose bound is in
    ``best_fit_plan``. A length that a third of all pieces share is ranked in
    as many buckets as the shuffle is wide.
    """
    spark, width = docs.sparkSession, shuffle_width(docs)
    pieces = materialized(bucketed(token_pieces(docs, vocabulary, pattern, capacity, end_id, id_col, text_col), width))
    counted = materialized(pieces.groupBy("length", "bucket").count())
    plan = best_fit_plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranked_before"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ranked_before"))
    held = spark.sparkContext.broadcast(plan)

    def make():
        plan = held.value
        keys = plan[:, 0] << 40 | plan[:, 1]

        def apply(batch: dict[str, list]) -> dict[str, list]:
            size, rank = np.array(batch["length"], np.int64), np.array(batch["rank"], np.int64)
            row = plan[np.searchsorted(keys, size << 40 | rank, "right") - 1]
            i = rank - row[:, 1]
            return batch | {"sequence_id": row[:, 2] + i // row[:, 3], "offset": row[:, 4] + i % row[:, 3] * size}

        return apply

    kept = ("id", "piece", "start", "length", "ids_crc32")
    fields = ", ".join(f"{k} {dict(pieces.dtypes)[k]}" for k in kept)
    return arrow_map(ranked.select(*kept, "rank"), f"{fields}, sequence_id long, offset long", make).withColumnRenamed("id", id_col)
