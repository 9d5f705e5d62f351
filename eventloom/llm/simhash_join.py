"""SimHash near-duplicates: fingerprints of word shingles joined over vantage-point trees.

A tree that cuts fingerprints by their Hamming distance from vantage points is
made of a sample. Each fingerprint goes down one side of every cut, and also
down the outer side where it is so close to the cut that the triangle
inequality leaves room for a partner there: two fingerprints within the
distance asked for then meet in at least one leaf, whatever the sample was. A
leaf is a shard, in which a tree of its own prunes the comparisons; what is
compared is compared exactly. A shard answers with a forest of links, not with
all pairs, so that a dense family costs as many rows as it has members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, materialized, pieces_of, small_batches, stored
from .ngram_join import components

_U = np.uint64
SEED = 42
#: Fingerprints of a shard, about; how many of them, about, are in the sample that the tree is fitted on.
LEAF_POINTS, LEAF_SAMPLE = 2_000, 16
#: Fingerprints of the sample at most, about (8 bytes each on the driver). More shards than it can tell apart are not made; they grow instead.
SAMPLE = 1_000_000
#: Fingerprints that one task compares at a time; a larger shard is dealt into blocks, each pair of which is a task.
GROUP_POINTS = 40_000
#: Below so many fingerprints a shard's own tree ends; vantage points tried for a cut; cells compared at a time.
BUCKET, TRIED, CELLS = 128, 8, 1 << 21
#: A cut must leave at most so much of the comparisons.
WORTH = 0.95
_GAP = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 20


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, a list for about every BLOCK_BYTES."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + BLOCK_BYTES)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the hashes of a text's shingles, repeats included."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text.encode().lower() if text else b""):
        held += block
        if len(held) < words:
            continue
        line = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held])
        starts = np.r_[0, ends[: len(held) - words]].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        held = held[len(held) - words + 1 :]
    if not total and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row."""
    own = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces_of(batch, "text")):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in part.column("text")), _U, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fp long")


def cut(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the fewest comparisons, or None if no cut is worth it.

    Inside are the points within the radius, outside the others and those
    inside that are nearer than ``reach`` to one that is not.
    """
    best, n = (WORTH * float(len(points)) ** 2, None), len(points)
    for vantage in points[:: max(1, n // TRIED)]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        inside, outside = within[:64].astype(float), n - np.r_[np.zeros(reach), within[: 64 - reach]]
        left = inside**2 + outside**2
        radius = int(left.argmin())
        if left[radius] < best[0]:
            best = (left[radius], (vantage, radius))
    return best[1]


def sides(distance: np.ndarray, radius: np.ndarray | int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside, and which outside."""
    return distance <= radius, distance > radius - reach


@dataclass
class Tree:
    """Cuts as arrays; a child below zero is the shard -1 - child."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    reach: int

    @classmethod
    def fitted(cls, sample: np.ndarray, reach: int, least: int) -> Tree:
        """Cut the sample until a shard has ``least`` of it or can't be cut; only the shards' sizes depend on the sample."""
        nodes: list[list] = []
        shards, open_ = 0, [(sample, None, 0)]
        while open_:
            points, parent, side = open_.pop()
            found = cut(points, reach) if len(points) > least else None
            if found is None:
                child, shards = -1 - shards, shards + 1
            else:
                child = len(nodes)
                nodes.append([*found, 0, 0])
                parts = sides(np.bitwise_count(points ^ found[0]).astype(np.int64), found[1], reach)
                open_ += [(points[p], child, 2 + i) for i, p in enumerate(parts)]
            if parent is not None:
                nodes[parent][side] = child
        columns = [np.array(c, t) for c, t in zip(zip(*nodes), (_U, np.int64, np.int64, np.int64))] if nodes else [np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64)]
        return cls(*columns, reach)

    def shards_of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a point, shard) for all shards that each point goes to."""
        at, node = np.arange(len(points)), np.full(len(points), 0 if len(self.vantage) else -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            ended = node < 0
            done.append((at[ended], -1 - node[ended]))
            at, node = at[~ended], node[~ended]
            inner, outer = sides(np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int64), self.radius[node], self.reach)
            at, node = np.r_[at[inner], at[outer]], np.r_[self.inside[node[inner]], self.outside[node[outer]]]
        return np.concatenate([d[0] for d in done]) if done else at, np.concatenate([d[1] for d in done]) if done else node


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each the place of the least member) once the members ``a`` and ``b`` are linked."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((up := label[label]) == label).all():
            label = up


def linked_within(points: np.ndarray, bits: int) -> np.ndarray:
    """The label of each of the distinct points: the place of the least one that it reaches by steps of ``bits`` or fewer."""
    label = np.arange(len(points))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, open_ = 0, [label.copy()]
    while open_:
        own = open_.pop()
        best = cut(points[own], bits) if len(own) > BUCKET else None
        if best is not None:
            open_ += [own[p] for p in sides(np.bitwise_count(points[own] ^ best[0]).astype(np.int64), best[1], bits)]
            continue
        rows = max(1, CELLS // max(1, len(own)))
        for start in range(0, len(own), rows):
            i, j = np.nonzero(np.bitwise_count(points[own[start : start + rows], None] ^ points[None, own[start:]]) <= bits)
            later = j > i
            found.append((own[start + i[later]], own[start + j[later]]))
            waiting += int(later.sum())
            if waiting > CELLS:
                label, found, waiting = merged(label, *map(np.concatenate, zip(*found))), [], 0
    return merged(label, *map(np.concatenate, zip(*found))) if found else label


def near_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fp``, whose components are those of all pairs within ``bits``."""
    n = distinct.count()
    rate = min(LEAF_SAMPLE / LEAF_POINTS, SAMPLE / max(n, 1))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30)) < int(rate * (1 << 30))
    sample = distinct.filter(chosen).select("fp").toPandas()["fp"].to_numpy(np.int64).view(_U) if n > LEAF_POINTS else np.zeros(0, _U)
    held = distinct.sparkSession.sparkContext.broadcast(Tree.fitted(np.sort(sample), bits, LEAF_SAMPLE))  # some bytes for each of the sample

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = part.column("fp").to_numpy().view(_U)
            at, shard = held.value.shards_of(points)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points[at].view(np.int64))], ["shard", "fp"])

    routed = stored(distinct.select("fp").mapInArrow(route, "shard long, fp long"))
    blocks = F.ceil(F.col("size") / GROUP_POINTS).cast("int")
    large = materialized(routed.groupBy("shard").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_POINTS).select("shard", blocks.alias("blocks")))  # a row for each of the tree's shards at most
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = routed.join(F.broadcast(large), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("other", others)
    keyed = dealt.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(_U)
        label = linked_within(points, bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": points[label[linked]].view(np.int64), "b": points[linked].view(np.int64)})

    links = stored(keyed.groupBy("shard", "i", "j").applyInArrow(compare, "a long, b long"))
    discard(routed)
    return links


def simhash_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: rows link whose fingerprints differ in ``bits`` bits or fewer.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer words
    than a shingle is one shingle; a null text or one without words has the
    fingerprint zero, which links like any other. ``component_id`` is the least
    id that a row reaches by links, its own included. Rows are nodes: rows that
    share an id are not linked by that; a row with a null id links like others
    but names no component (null, if no row it reaches has an id). An empty
    table gives no rows; other columns are not read; texts are whole.

    Equal fingerprints are one node from the first shuffle on, which counts
    them in each task first. Shards have their size counted, and one that is
    too large is compared by pairs of blocks; rows with a fingerprint of very
    many rows get their component by a broadcast, not by a shuffle.
    """
    own = stored(fingerprinted(docs, words, id_col, text_col))
    distinct = materialized(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    links = near_links(distinct, bits)
    label = components(links).select(F.col("id").alias("fp"), "component")
    least = label.join(distinct, "fp").groupBy("component").agg(F.min("first").alias("least"))
    known = label.join(least, "component").select("fp", "least")
    named = materialized(distinct.join(known, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")))
    both = looked_up(own, named, "fp", "n")
    return both.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
