"""Removal of passages that documents share, by prefix-partitioned suffix trees.

A suffix (the words from some place on) matters if its first ``window`` words
also start elsewhere. Anchors tell which suffixes can: every window has one,
the least k-gram hash in it, so equal windows have equal anchors, and only
windows whose anchor two documents share are followed up.

Suffixes are split by prefixes of variable length, from a suffix's start to the
end of its anchor. Prefixes that end in one anchor go to one group, so that
neighbouring suffixes of a document travel as one slice of its words, and a
group has no more slices than the anchor has places. The suffixes of an anchor
too frequent for one group are dealt over several by document.

A task holds a few groups at a time. It sorts their suffixes by their words, by
prefix doubling, and takes the lengths of common prefixes of neighbours: runs
of suffixes with ``window`` or more words in common are the deep internal nodes
of the subtrees, and their depth is the least of these lengths. A node's words
are a repeat; each of its suffixes but those of its first document gives it up.
Nodes below a deep node repeat nothing that it doesn't. Where an anchor has
several groups, each node's first suffixes meet once more by their window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialized, shuffle_width, slices_of, small_batches
from .words import MULTIPLIER, Runs, mixed, split_words, word_hashes

#: Words of an anchor; documents of an anchor in one group, about; words of the groups that a task holds at a time, about.
ANCHOR_WORDS = 8
GROUP_DOCUMENTS = 5_000
HELD_WORDS = 200_000
SLICE_BYTES = 4_000_000
_PLACE = np.uint64(30)  # bits for a place in a document


def anchors_of(runs: Runs, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the document the place of its anchor; and the hash of the k-gram at each place."""
    grams = mixed(runs.every(ANCHOR_WORDS))
    least = grams >> _PLACE << _PLACE | np.arange(len(grams), dtype=np.uint64)
    span, reach = window - ANCHOR_WORDS + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    return (least & np.uint64((1 << 30) - 1)).astype(np.int64), grams


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, id, mark): the anchors of each document's windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            found, ids, marks = [], [], []
            for key, mark, text in zip(*(part.column(c).to_pylist() for c in ("id", "mark", "text"))):
                words = split_words(text)
                if len(words) >= window:
                    places, grams = anchors_of(Runs(word_hashes(words)), window)
                    anchors = np.unique(grams[places])
                    found.append(anchors)
                    ids.append(np.full(len(anchors), key, np.int64))
                    marks.append(np.full(len(anchors), mark, np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(marks))], ["anchor", "id", "mark"])

    return docs.select("id", "mark", "text").mapInArrow(run, "anchor long, id long, mark int")


def suffix_slices(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, salt, salts, id, mark, pos, words): slices of neighbouring suffixes whose windows have one shared anchor.

    ``docs`` has id, mark, text, anchors (hash, docs) or null, and copy; copies
    of earlier texts are passed over. ``pos`` is the first suffix of a slice;
    the last has ``window`` words. An anchor's documents are dealt over
    ``salts`` groups.
    """

    def written(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["anchor", "salt", "salts", "id", "mark", "pos", "words"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            lists = part.column("anchors")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            made = 0
            hashes, sizes = (flat.field(x).to_numpy() for x in ("anchor", "docs"))
            columns = (part.column(c) for c in ("id", "mark", "text", "copy"))
            for i, (key, mark, text, copy) in enumerate(zip(*columns)):
                if copy.as_py() or bounds[i] == bounds[i + 1]:
                    continue
                own = slice(bounds[i], bounds[i + 1])
                order = np.argsort(hashes[own])
                shared, freq = hashes[own][order], sizes[own][order]
                words = split_words(text.as_py())
                places, grams = anchors_of(Runs(word_hashes(words)), window)
                wanted = grams[places].view(np.int64)
                at = np.minimum(np.searchsorted(shared, wanted), len(shared) - 1)
                pos = np.flatnonzero(shared[at] == wanted)
                opens = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1] + 1) | (wanted[pos[1:]] != wanted[pos[:-1]])])
                key, mark = key.as_py(), mark.as_py()
                for a, b in zip(opens, [*opens[1:], len(pos)]):
                    first, salts = int(pos[a]), int(-(-freq[at[pos[a]]] // GROUP_DOCUMENTS))
                    rows.append((int(wanted[first]), (key * MULTIPLIER >> 20) % salts, salts, key, mark, first, b" ".join(words[first : int(pos[b - 1]) + window])))
                    made += len(rows[-1][-1])
                if made > SLICE_BYTES:
                    yield written(rows)
                    rows, made = [], 0
            if rows:
                yield written(rows)

    return docs.mapInArrow(run, "anchor long, salt int, salts int, id long, mark int, pos int, words binary")


class SuffixTrees:
    """The suffix trees of some groups of word sequences: suffixes in order, and how many words neighbours have in common."""

    def __init__(self, sequences: list[list[bytes]], groups: list[int]):
        lengths = np.array([len(x) for x in sequences], np.int64)
        codes = pd.factorize(np.array([w for x in sequences for w in x], object))[0].astype(np.int64)
        ends = np.cumsum(lengths + 1)
        self.begin = ends - lengths - 1
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        text = np.empty(ends[-1], np.int64)
        text[inside] = np.repeat(np.array(groups, np.int64), lengths) * (codes.max() + 1) + codes
        text[~inside] = -1 - np.arange(len(sequences))  # an end is like no other: common prefixes stop there
        self.ranks = [np.unique(text, return_inverse=True)[1]]
        reach = 1
        while reach < lengths.max():  # ranks by twice as many words
            rank = self.ranks[-1]
            key = rank * (len(rank) + 1)
            key[:-reach] += rank[reach:] + 1
            self.ranks.append(np.unique(key, return_inverse=True)[1])
            reach *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` have in common."""
        n = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            n[rank[np.minimum(a + n, len(rank) - 1)] == rank[np.minimum(b + n, len(rank) - 1)]] += 1 << level
        return n

    def deep_nodes(self, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes in order (as places in ``suffixes``), where each node of ``depth`` words or more begins, and the nodes' depths.

        These are the deep internal nodes next to the root; a suffix in none is a node of its own, of depth 0.
        """
        order = np.argsort(self.ranks[-1][suffixes], kind="stable")
        shared = self.common(suffixes[order[:-1]], suffixes[order[1:]])
        begins = np.flatnonzero(np.r_[True, shared < depth])
        least = np.minimum.reduceat(np.where(np.r_[True, shared < depth], np.iinfo(np.int64).max, np.r_[0, shared]), begins)
        return order, begins, np.where(least == np.iinfo(np.int64).max, 0, least)


_FOUND = "node binary, id long, mark int, froms array<int>, tos array<int>"


def _spans(ids: np.ndarray, marks: np.ndarray, froms: np.ndarray, tos: np.ndarray) -> pa.RecordBatch:
    """A row per document with its spans, overlapping ones merged."""
    order = np.lexsort((froms, marks, ids))
    ids, marks, froms, tos = ids[order], marks[order], froms[order], tos[order]
    owner = np.cumsum(np.r_[0, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    reached = np.maximum.accumulate(tos + (owner << 40)) - (owner << 40)
    opens = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (froms[1:] > reached[:-1])])
    ends = reached[np.r_[opens[1:] - 1, len(ids) - 1]]
    firsts = np.flatnonzero(np.r_[True, owner[opens][1:] != owner[opens][:-1]])
    cuts = pa.array(np.r_[firsts, len(opens)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (froms[opens], ends)]
    heads = opens[firsts]
    return pa.RecordBatch.from_arrays([pa.nulls(len(heads), pa.binary()), pa.array(ids[heads]), pa.array(marks[heads]), *lists], ["node", "id", "mark", "froms", "tos"])


def subtree_repeats(slices: DataFrame, window: int) -> DataFrame:
    """(id, mark, froms, tos): the spans of words that start in a document with a smaller id too."""
    width = shuffle_width(slices)
    ordered = slices.repartition(width, "anchor", "salt").sortWithinPartitions("anchor", "salt")

    def grown(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sequences = [r[6].split(b" ") for r in rows]
        groups = np.cumsum([0, *[a[:2] != b[:2] for a, b in zip(rows, rows[1:])]])
        trees = SuffixTrees(sequences, groups.tolist())
        n = np.array([len(x) - window + 1 for x in sequences])
        owner = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        order, begins, depths = trees.deep_nodes(trees.begin[owner] + inner, window)
        owner, inner = owner[order], inner[order]
        salts, ids, marks, pos = (np.array([r[i] for r in rows], np.int64)[owner] for i in (2, 3, 4, 5))
        sizes = np.diff(np.r_[begins, len(owner)])
        first, depth = np.repeat(np.minimum.reduceat(ids, begins), sizes), np.repeat(depths, sizes)
        later = ids > first
        if later.any():
            at = pos[later] + inner[later]
            yield _spans(ids[later], marks[later].astype(np.int32), at, at + depth[later])
        met = np.flatnonzero(~later & (salts > 1))  # other groups may have the node too
        if len(met):
            keys = [xxhash.xxh3_128_digest(b" ".join(sequences[owner[i]][inner[i] : inner[i] + window])) for i in met]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32)), pa.array((pos[met] + inner[met] + x).astype(np.int32))) for x in (0, window)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids[met]), pa.array(marks[met].astype(np.int32)), *lists], ["node", "id", "mark", "froms", "tos"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("anchor", "salt", "salts", "id", "mark", "pos", "words"))):
                if words >= HELD_WORDS and held[-1][:2] != row[:2]:
                    yield from grown(held)
                    held, words = [], 0
                held.append(row)
                words += row[6].count(b" ") + 1
        if held:
            yield from grown(held)

    found = materialized(ordered.mapInArrow(run, _FOUND))
    open_nodes = found.filter("node IS NOT NULL")
    first = materialized(open_nodes.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"))
    met = open_nodes.join(first, "node").filter("id > first")
    return found.filter("node IS NULL").drop("node").union(met.select("id", "mark", "froms", "tos"))


def repeats(docs: DataFrame, dealt: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """From rows with id, mark, text: (id, mark, froms, tos) of repeated spans, and (id, mark, copy) of copies of earlier texts.

    Equal texts are told first, by 128 bits of hash; only the first of each is
    followed further. ``dealt`` has the same rows, by id and mark, and keeps
    all its columns in the join with the anchors, so that the caller's own join
    with it can use the same exchange.
    """
    known = docs.filter(F.col("id").isNotNull()).select("id", "mark", "text")
    texts = known.select("id", "mark", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("copy"), "text", F.length("text")).alias("b"))
    firsts = texts.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    copies = materialized(texts.join(firsts, ["a", "b"]).filter("id > first").select("id", "mark").distinct().withColumn("copy", F.lit(True)))
    anchors = materialized(anchor_rows(known, window))
    shared = materialized(anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("docs")).filter("low < high").select("anchor", "docs"))
    by_doc = anchors.select("anchor", "id", "mark").join(shared, "anchor").groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "docs")).alias("anchors"))
    marked = dealt.join(by_doc, ["id", "mark"], "left").join(copies, ["id", "mark"], "left")
    found = subtree_repeats(suffix_slices(marked, window), window)
    return found, copies


def removed_words(n: int, froms: list[int], tos: list[int]) -> np.ndarray:
    """A flag for each of ``n`` words: is it in a span?"""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, froms, 1)
    np.add.at(edge, tos, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word in a window of words that also starts in a document with a smaller id.

    Returns (row, text, n_words, n_removed, kept_sha256): ``row`` has the other
    columns, ``text`` the text without the removed words (each with the white
    space behind it; unchanged if nothing is removed), and the digest is of the
    kept words joined by single spaces. Windows are judged on the input.

    A null text has no words; rows with a null id (ids are integers) neither
    lose nor take words; rows that share an id do not repeat each other; an
    empty table gives no rows; the other columns' names can't clash. Between
    executors go anchors (one in about 22 words), slices of words around
    shared anchors, and the text once.
    """
    own = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("mark"), F.col(text_col).alias("text"))
    dealt = own.repartition(shuffle_width(docs), "id", "mark")  # one exchange of the text for both joins
    found, copies = repeats(own, dealt, window)
    spans = found.groupBy("id", "mark").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("froms", "tos")])
    joined = dealt.join(spans, ["id", "mark"], "left").join(copies, ["id", "mark"], "left").select("row", "text", "froms", "tos", "copy")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            out: list[list] = [[] for _ in range(4)]
            for text, froms, tos, copy in zip(*(part.column(c).to_pylist() for c in ("text", "froms", "tos", "copy"))):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                if copy and len(words) >= window:
                    gone[:] = True
                elif froms:
                    gone = removed_words(len(words), froms, tos)
                kept = words
                if gone.any():
                    kept = [w for w, x in zip(words, gone) if not x]
                    pieces = re.split(rb"([^\x20\x09-\x0D]+)", text.encode())
                    text = (pieces[0] + b"".join(pieces[2 * i + 1] + pieces[2 * i + 2] for i in np.flatnonzero(~gone))).decode()
                for column, value in zip(out, (text, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, t) for c, t in zip(out, kinds)]], schema.names)

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, its texts without words of repeated windows."""
    done = substring_dedup(docs, window, id_col, text_col)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
