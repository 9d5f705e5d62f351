"""Near-duplicate components by a Jaccard join of word shingles with PartEnum signatures.

Sets are put into bands by size, so that similar sets lie in one band or in two
neighbouring ones. In a band, sets that are similar enough differ in at most k
shingles. The shingle domain is cut into first-level partitions, of which one
then differs in at most one shingle, and each of these into three parts, of
which two then agree: the sets share the signature of that pair of parts.

Documents that share a signature are compared with the first of them, exactly,
and what is linked becomes a component. A signature whose documents are then
still in several components may hide other links. Its documents are described
by their differences from one pivot, a document of the largest component there:
two of them that are linked, and not both linked with the pivot, must differ
from it in a shingle in common, and how many they need follows from the sizes
alone. Differences are few and mostly a document's own, so that a family of
near copies that are not linked leaves no pairs, however large it is. Documents
that share a signature with a pivot unlike them (few shingles hashed to its
parts) meet on their rarest shingles instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialized, pieces_of, release, shuffle_width, slices_of, small_batches, stored
from .words import MULTIPLIER, Runs, mixed, word_hashes

_U = np.uint64
#: A first-level partition differs in at most K2 shingles and has N2 parts, of which N2 - K2 agree.
K2, N2 = 1, 3
#: A signature of fewer shingles is shared by documents that have little in common; with some more partitions most documents need none.
FEW, MORE_PARTS = 2, 0.15
#: Buckets of signatures for each partition of the shuffle; a task holds one bucket at a time.
BUCKETS = 8
#: Longs of parities that are kept of a document's differences from a pivot.
SKETCH = 8
#: Bytes of pivots' parities that may be broadcast.
BROADCAST_BYTES = 16_000_000
#: Shingles that are told to be frequent (a broadcast of 8 bytes each); this orders work and changes no result.
FREQUENT_SHINGLES = 1_000_000
#: Ids that may be broadcast (16 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Differing shingles are shuffled in rounds of about so many, in a number of rounds at most: a round's files go before the next one's come.
ROUND_ROWS, ROUNDS = 2_000_000, 8
_CODE_BITS = 40


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit values; fewer words than a shingle's are one shingle."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, _U)
    runs = Runs(word_hashes(tokens))
    return np.unique(mixed(runs.every(words) if len(tokens) >= words else runs.at(np.zeros(1, np.int64), len(tokens)) ^ _U(len(tokens))))


class PartEnum:
    """Signatures for the similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.last = [0]  # last size of each band
        while self.last[-1] < 1 << 31:
            low = self.last[-1] + 1
            self.last.append(max(low, low * den // num))

    def differing(self, band: int) -> int:
        """k: shingles in which similar sets that share this band's signatures can differ."""
        return 2 * self.last[band] * (self.den - self.num) // (self.den + self.num)

    def bands(self, size: int) -> list[int]:
        band = int(np.searchsorted(self.last, size))
        return [band, band + 1] if size * self.den // self.num > self.last[band] else [band]

    def signatures(self, values: np.ndarray) -> np.ndarray:
        found = [self.of_band(values, band) for band in self.bands(len(values)) if self.differing(band)]  # k = 0: equal sets only
        return np.concatenate(found) if found else np.zeros(0, _U)

    def parts(self, band: int) -> int:
        """First-level partitions: the least number of which one differs in at most K2 shingles, and some more."""
        return int(np.ceil((1 + MORE_PARTS) * -(-(self.differing(band) + 1) // (K2 + 1))))

    def of_band(self, values: np.ndarray, band: int) -> np.ndarray:
        """Signatures of pairs of parts that hold FEW shingles or more; of all pairs, unless those alone are enough.

        A partition of three such pairs agrees in none of them only if two of
        its parts differ, one of fewer such pairs only if one part does. Where
        k differing shingles are too few for that in all partitions, every
        similar set shares one of these signatures.
        """
        n1 = self.parts(band)
        dealt = mixed(values ^ _U(band * MULTIPLIER & (1 << 64) - 1))
        part = (dealt % _U(n1 * N2)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held = part[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        sums = np.zeros(n1 * N2, _U)
        sums[held[first]] = np.add.reduceat(mixed(dealt[order] + _U(1)), first)
        sums = mixed(sums + np.arange(n1 * N2, dtype=_U) + _U((band << 32) + 1)).reshape(n1, N2)
        counts = np.bincount(part, minlength=n1 * N2).reshape(n1, N2)
        pairs = list(combinations(range(N2), N2 - K2))
        found = np.stack([mixed(sums[:, s].sum(axis=1, dtype=_U) + _U(i)) for i, s in enumerate(pairs)], axis=1)
        large = np.stack([counts[:, s].sum(axis=1) >= FEW for s in pairs], axis=1)
        many = large.sum(axis=1)
        enough = (many > 0).sum() + (many == len(pairs)).sum() > self.differing(band)
        return found[large] if enough else found.reshape(-1)


def parity_bits(values: np.ndarray) -> bytes:
    """Parities of hashed shingle counts, four bits or more a shingle: sets that differ in d shingles differ in at most d bits."""
    n = max(64, 1 << (4 * len(values) - 1).bit_length()) if len(values) else 64
    return np.packbits((np.bincount((values & _U(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles in which the sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    fold = lambda z: z if len(z) == n else np.bitwise_xor.reduce(z.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum())


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """False only if the sets cannot be similar enough."""
    return min(na, nb) * den >= num * max(na, nb) and parity_distance(a, b) <= (na + nb) * (den - num) // (den + num)


def is_near(differing: int, na: int, nb: int, num: int, den: int) -> bool:
    """Is the Jaccard distance at most 1/2 plus that of a link?"""
    return differing * (den + 2 * num) <= (3 * den - 2 * num) * (na + nb)


def is_far(differing: int, na: int, nb: int) -> bool:
    """Is the Jaccard distance over 1/2?"""
    return 3 * differing > na + nb


_EMITTED = "bucket int, kind int, codes binary, ids binary, base long, id long, a long, b long, n long, h1 long, h2 long, bits binary"
_PACKED, _SPREAD, _TWINNED, _INFO = 0, 1, 2, 3


def emitted(docs: DataFrame, words: int, scheme: PartEnum, buckets: int) -> DataFrame:
    """One pass over (id, a, b, text): a row of facts per document, and signatures packed by bucket.

    Documents of a batch that share a signature in threes or more send one of
    them to the signature's bucket; the others are spread over all buckets,
    so that a signature of most documents is a row per batch in its bucket.
    """

    def packed(bucket: int, kind: int, codes: np.ndarray, ids: np.ndarray) -> tuple:
        base = int(ids.min())
        offsets = ids - base
        most = int(offsets.max())
        wide = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
        small = codes.astype(_U).view(np.uint8).reshape(-1, 8)
        return (bucket, kind, (small if kind == _SPREAD else small[:, : _CODE_BITS // 8]).tobytes(), offsets.astype(wide).tobytes(), base, *[None] * 7)

    def gathered(ids: list, hashes: list[tuple], texts: list) -> pa.RecordBatch:
        rows: list[tuple] = []
        signatures, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for i, (key, marks, text) in enumerate(zip(ids, hashes, texts)):
            values = shingles(text, words)
            both = (values.sum(dtype=_U), mixed(values + _U(3)).sum(dtype=_U))
            rows.append(((i + (key or 0)) % buckets, _INFO, None, None, None, key, *marks, len(values), *(int(x.astype(np.int64)) for x in both), parity_bits(values)))
            if key is not None and len(values):
                signatures.append(scheme.signatures(values))
                owners.append(np.full(len(signatures[-1]), key, np.int64))
        signature, owner = np.concatenate(signatures), np.concatenate(owners)
        bucket = (signature % _U(buckets)).astype(np.int64)
        code = bucket << _CODE_BITS | (signature >> _U(64 - _CODE_BITS)).astype(np.int64)
        order = np.lexsort((owner, code))
        code, owner, bucket = code[order], owner[order], bucket[order]
        opens = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        size = np.diff(np.r_[opens, len(code)])
        size = np.repeat(size, size)
        is_first = np.zeros(len(code), bool)
        is_first[opens] = True
        twin = (size > 2) & ~is_first
        where = np.where(twin, np.abs(owner) % buckets, bucket)
        kind = np.where(twin, _SPREAD, np.where(size > 2, _TWINNED, _PACKED))
        slot = where * 4 + kind
        order = np.argsort(slot, kind="stable")
        cuts = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1], True]) if len(slot) else []
        for a, b in zip(cuts, cuts[1:]):
            take = order[a:b]
            rows.append(packed(int(where[take[0]]), int(kind[take[0]]), code[take], owner[take]))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _EMITTED.split(", ")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in pieces_of(part, "text"):
                yield gathered(piece.column("id").to_pylist(), list(zip(piece.column("a").to_pylist(), piece.column("b").to_pylist())), piece.column("text").to_pylist())

    return docs.select("id", "a", "b", "text").mapInArrow(run, _EMITTED)


def sharing(packed: DataFrame, width: int) -> DataFrame:
    """The facts of all documents, and (code, id) of all signatures that two documents or more have; a bucket is held at a time."""
    ordered = packed.repartition(width, "bucket").sortWithinPartitions("bucket")
    names = ["code", "id", "a", "b", "n", "h1", "h2", "bits"]

    def unpacked(bucket: int, kind: int, codes: bytes, ids: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
        step = 8 if kind == _SPREAD else _CODE_BITS // 8
        small = np.frombuffer(codes, np.uint8).reshape(-1, step)
        full = np.zeros((len(small), 8), np.uint8)
        full[:, :step] = small
        code = full.reshape(-1).view(np.int64)
        if step < 8:
            code = code | bucket << _CODE_BITS
        wide = {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(ids) // len(code)]
        return code, np.frombuffer(ids, wide).astype(np.int64) + base

    def links(code: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(owner), *[pa.nulls(len(code), pa.int64())] * 5, pa.nulls(len(code), pa.binary())], names)

    def groups(held: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        code, owner = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        known = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
        order = np.lexsort((owner, code))
        code, owner, known = code[order], owner[order], known[order]
        opens = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[opens, len(code)])
        many = np.repeat((size > 1) | np.logical_or.reduceat(known, opens), size)
        return links(code[many], owner[many])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for part in parts:
            kinds = part.column("kind").to_numpy()
            facts = part.filter(pa.array(kinds == _INFO))
            if facts.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(facts.num_rows, pa.int64()), *[facts.column(c) for c in names[1:]]], names)
            for i in np.flatnonzero(kinds != _INFO):
                bucket, kind, *row = (part.column(c)[i].as_py() for c in ("bucket", "kind", "codes", "ids", "base"))
                if held and bucket != last:
                    yield groups(held)
                    held = []
                last = bucket
                code, owner = unpacked(bucket, kind, *row)
                if kind == _SPREAD:
                    yield links(code, owner)
                else:
                    held.append((code, owner, kind == _TWINNED))
        if held:
            yield groups(held)

    return ordered.mapInArrow(run, "code long, id long, a long, b long, n long, h1 long, h2 long, bits binary")


def rare_prefix(n: int, num: int, den: int) -> int:
    """So many of a set's shingles, in an order that all sets share, that a similar set has one of its own first ones among them."""
    return n + (-n * num) // den + 1


def frequent_shingles(docs: DataFrame, words: int, num: int, den: int) -> np.ndarray:
    """The most frequent of the shingles that come first by their hash in any document, half as many again as a prefix has; counted over all documents."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in pieces_of(part, "text"):
                sets = [shingles(t, words) for t in piece.column("text").to_pylist()]
                values, n = np.unique(np.concatenate([np.zeros(0, _U), *[x[: rare_prefix(len(x), num, den) * 3 // 2] for x in sets]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT_SHINGLES).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(_U))


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, which are broadcast only where they are counted to be few."""
    ids = materialized(ids.select("id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar enough: first by sizes and parity bits, then by the sets themselves."""
    side = lambda x: facts.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x))
    probed = pairs.join(side("a"), "a").filter(F.col("na") > 0).join(side("b"), "b")

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            columns = [part.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")]
            keep = pa.array([may_link(*x, num, den) for x in zip(*columns)], pa.bool_())
            yield part.select(["a", "b"]).filter(keep)

    near = materialized(probed.select("a", "b", "bitsa", "bitsb", "na", "nb").mapInArrow(probe, "a long, b long").distinct())
    release(docs.sparkSession)
    needed = picked(docs, near.select(F.explode(F.array("a", "b")).alias("id")))
    text = lambda x: needed.select(F.col("id").alias(x), F.col("text").alias("text" + x))
    full = near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "texta", "textb")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for part in (piece for batch in parts for piece in slices_of(batch)):
            out = []
            for a, b, one, other in zip(*(part.column(c).to_pylist() for c in ("a", "b", "texta", "textb"))):
                if kept[0] != one:
                    kept = (one, shingles(one, words))
                x, y = kept[1], shingles(other, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(den * both >= num * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    similar = materialized(full.mapInArrow(compare, "a long, b long"))
    release(docs.sparkSession)
    return similar


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches, by least labels of neighbours and of labels."""
    both = materialized(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialized(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left").select("id", "was", F.least("component", "further").alias("component"))
        new = materialized(jump)
        labels = new.select("id", "component")
        if not new.filter("component < was").limit(1).count():
            return labels


def largest_sharing(num: int, den: int) -> Column:
    """The most shingles in which a set of ``n`` and one similar to it differ."""
    return F.floor((F.col("n") + F.floor(F.col("n") * den / num)) * (den - num) / (den + num))


def incidences(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(p, id, component, size): the documents of every signature that has several components, and its pivot with the pivot's component's size."""
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    known = label.join(sizes, "component").select("id", "component", "size")
    grouped = shared.join(known, "id", "left").select("code", "id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    best = F.max(F.struct("size", (-F.col("component")).alias("back"))).alias("best")
    pivots = materialized(grouped.groupBy("code").agg(F.min("component").alias("low"), F.max("component").alias("high"), best).filter("low < high").select("code", (-F.col("best.back")).alias("p"), F.col("best.size").alias("p_size")))
    release(shared.sparkSession)
    found = materialized(grouped.join(pivots, "code").filter("id != p").select("p", "p_size", "id", "component").distinct())
    release(shared.sparkSession)
    return found


_DIFFERENCES = "p long, p_size long, id long, component long, mark long, n long, m long, d long, near boolean, far boolean, inner boolean, sketch array<bigint>, added array<bigint>, lost array<bigint>"


def differences(found: DataFrame, facts: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of each document and pivot: in how many shingles they differ and, if they may be near, in which.

    Documents whose parity bits show that they are not near are not compared.
    """
    keys = found.columns
    side = lambda x: facts.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x))
    pivots = materialized(side("p").join(found.select("p").distinct(), "p", "left_semi"))
    few = (pivots.agg(F.sum(F.octet_length("bitsp"))).first()[0] or 0) <= BROADCAST_BYTES
    probed = found.join(side("id"), "id").join(F.broadcast(pivots) if few else pivots, "p").select(*keys, "nid", "np", "bitsid", "bitsp")

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices_of(batch)):
            columns = [part.column(c).to_pylist() for c in ("bitsid", "bitsp", "nid", "np")]
            near = pa.array([is_near(parity_distance(a, b), n, m, num, den) for a, b, n, m in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], near], [*keys, "near"])

    told = stored(probed.mapInArrow(probe, "p long, p_size long, id long, component long, near boolean").groupBy(*keys).agg(F.max("near").alias("near")))
    release(docs.sparkSession)
    near = told.filter("near").drop("near")
    needed = picked(docs, near.select(F.explode(F.array("p", "id")).alias("id")))
    text = lambda x: needed.select(F.col("id").alias(x), F.col("text").alias("text" + x))
    full = near.join(text("id"), "id").join(text("p"), "p").select(*keys, "textid", "textp")
    kinds = [*[pa.int64()] * 8, *[pa.bool_()] * 3, *[pa.list_(pa.int64())] * 3]
    names = [x.split()[0] for x in _DIFFERENCES.split(", ")]

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for part in (piece for batch in parts for piece in slices_of(batch)):
            rows = []
            for *row, own, other in zip(*(part.column(c).to_pylist() for c in (*keys, "textid", "textp"))):
                if kept[0] != other:
                    kept = (other, shingles(other, words))
                x, y = shingles(own, words), kept[1]
                added, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                sketch = np.packbits((np.bincount((np.concatenate([added, lost]) & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8))
                n, m, d = len(x), len(y), len(added) + len(lost)
                near = is_near(d, n, m, num, den)
                mark = (x.sum(dtype=_U) ^ mixed(y.sum(dtype=_U, keepdims=True)))[0]
                rows.append((*row, int(mark.astype(np.int64)), n, m, d, near, is_far(d, n, m), d * (den + num) <= (n + m) * (den - num), *((v.view(np.int64) if near else None) for v in (sketch, added, lost))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    compared = full.mapInArrow(compare, _DIFFERENCES)
    unlike = told.filter("NOT near").drop("near").select(*keys, *[F.lit(None).cast("long").alias(c) for c in names[4:8]], F.lit(False).alias("near"), F.lit(True).alias("far"), F.lit(False).alias("inner"), *[F.lit(None).cast("array<bigint>").alias(c) for c in names[11:]])
    out = stored(compared.union(unlike))
    discard(told)
    return out


def once_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key; only rows whose key is counted to be there again are shuffled."""
    again = materialized(rows.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").select(*key))
    if not again.limit(1).count():
        return rows
    return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))


def pairs_of_families(told: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components that may be linked, from the shingles in which both differ from one pivot.

    Sets x and y whose differences from the pivot are X and Y differ in
    |X| + |Y| - 2 |X and Y|, so they need a number of common ones that is one
    or more unless both are linked with the pivot. In an order that all share
    (what the pivot lacks first, the rare first), the first common one comes
    before the last that many of both. X and Y also differ in no fewer
    shingles than their parities do. Rounds divide the shingles, so that what
    is shuffled of them at a time is a part.
    """
    key = ["p", "id", "mark"]
    near = once_each(told.filter("near"), key)
    sides = [near.select(*key, "component", "inner", F.explode(c).alias("shingle"), F.lit(c == "lost").alias("lost")) for c in ("added", "lost")]
    each = sides[0].union(sides[1])
    total = near.agg(F.sum(F.size("added") + F.size("lost"))).first()[0] or 0
    rounds = min(ROUNDS, total // ROUND_ROWS + 1)
    found = []
    for i in range(rounds):
        own = each.filter(F.pmod(F.col("shingle"), F.lit(rounds)) == i)
        spots = own.groupBy("p", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("inner").alias("all_inner"), F.count("*").alias("times"))
        spots = materialized(spots.filter("low < high AND NOT all_inner").select("p", "shingle", "times"))
        release(told.sparkSession)
        found.append(stored(own.select(*key, "shingle", "lost").join(F.broadcast(spots) if spots.count() <= BROADCAST_IDS else spots, ["p", "shingle"])))
        del spots
        release(told.sparkSession)
    at_spots = reduce(DataFrame.union, found)
    # all other shingles come before these: no document of another component has them
    order = Window.partitionBy(*key).orderBy("lost", "times", "shingle")
    facts = near.select(*key, "component", "n", "m", "d", "inner", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    placed = at_spots.withColumn("pos", F.row_number().over(order) - F.count("*").over(Window.partitionBy(*key)) - 1).join(facts, key).withColumn("pos", F.col("d") + F.col("pos"))
    least = F.floor((F.ceil(F.col("n") * num / den) + F.col("m")) * (den - num) / (den + num)) + 1  # of an outer document's differences
    most = largest_sharing(num, den)
    other = F.greatest(F.col("d") - most, F.when(F.col("inner"), least).otherwise(0))
    needed = F.greatest(F.ceil((F.col("d") + other - most) / 2), F.lit(1))
    kept = materialized(placed.filter(F.col("pos") <= F.col("d") - needed).drop("m", "lost", "times", "mark"))
    for df in found:
        discard(df)
    release(told.sparkSession)
    again = kept.select("p", "shingle", *[F.col(c).alias("other_" + c) for c in kept.columns if c not in ("p", "shingle")])
    most = F.floor((F.col("n") + F.col("other_n")) * (den - num) / (den + num))
    total = F.col("d") + F.col("other_d") - most
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"other_s{i}"))) for i in range(SKETCH)])
    may = (apart <= most) & (2 * (F.col("d") - F.col("pos")) >= total) & (2 * (F.col("other_d") - F.col("other_pos")) >= total)
    met = kept.join(again, ["p", "shingle"]).filter((F.col("id") < F.col("other_id")) & (F.col("component") != F.col("other_component")) & ~(F.col("inner") & F.col("other_inner")) & near_size("n", "other_n", num, den) & may)
    return met.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def near_size(n: str, m: str, num: int, den: int) -> Column:
    return (den * F.col(n) >= num * F.col(m)) & (den * F.col(m) >= num * F.col(n))


def pairs_of_strangers(told: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b) of different components that may be linked, of documents that share a signature with a pivot far from them.

    Similar sets have one of so many of their rarest shingles in common. What
    both are near the same pivot is left to that pivot. A distance of Jaccard
    is a metric: of linked documents either both are near the pivot, or both
    are far from it and come here.
    """
    homes = told.groupBy("p", "p_size", "id").agg(F.min("near").alias("near")).filter("near").groupBy("id").agg(F.max(F.struct("p_size", (-F.col("p")).alias("back"))).alias("home")).select("id", (-F.col("home.back")).alias("home"))
    far = materialized(told.filter("far").select("id", "component").distinct().join(homes, "id", "left"))
    own = docs.join(F.broadcast(far) if far.count() <= BROADCAST_IDS else far, "id")
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(own, words, num, den))
    release(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for part in parts:
            for piece in pieces_of(part, "text"):
                out: list[np.ndarray] = []
                sizes = []
                for text in piece.column("text").to_pylist():
                    values = shingles(text, words)
                    common = np.zeros(len(values), bool)
                    if len(frequent):
                        common = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] == values
                    out.append(values[np.lexsort((values, common))[: rare_prefix(len(values), num, den)]])
                    sizes.append(len(values))
                taken = np.array([len(x) for x in out], np.int64)
                owner = pa.array(np.repeat(np.arange(len(out)), taken))
                flat = np.concatenate([np.zeros(0, _U), *out]).view(np.int64)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(taken) - taken, taken)
                yield pa.RecordBatch.from_arrays([pa.array(flat), *[piece.column(c).take(owner) for c in ("id", "component", "home")], pa.array(np.repeat(np.array(sizes, np.int32), taken)), pa.array(pos.astype(np.int32))], ["shingle", "id", "component", "home", "n", "pos"])

    rare = own.select("id", "component", "home", "text").mapInArrow(run, "shingle long, id long, component long, home long, n int, pos int")
    spot = Window.partitionBy("shingle")
    marked = rare.withColumns({"low": F.min("component").over(spot), "high": F.max("component").over(spot), "one": F.min("home").over(spot), "two": F.max("home").over(spot), "at_home": F.count("home").over(spot), "all": F.count("*").over(spot)})
    rare = materialized(marked.filter("low < high AND (at_home < all OR one < two)").select(*rare.columns))
    del marked
    release(docs.sparkSession)
    again = rare.select("shingle", *[F.col(c).alias("other_" + c) for c in ("id", "component", "home", "n", "pos")])
    may = ((F.col("n") - F.col("pos")) * (den + num) >= num * (F.col("n") + F.col("other_n"))) & ((F.col("other_n") - F.col("other_pos")) * (den + num) >= num * (F.col("n") + F.col("other_n")))
    strangers = F.col("home").isNull() | F.col("other_home").isNull() | (F.col("home") != F.col("other_home"))
    met = rare.join(again, "shingle").filter((F.col("id") < F.col("other_id")) & (F.col("component") != F.col("other_component")) & strangers & near_size("n", "other_n", num, den) & may)
    return met.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents link whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer words
    than a shingle is one shingle; a null text or one without words links with
    nothing. ``component_id`` is the least id reachable by links. Ids are
    integers; rows that share an id are one document with the links of each; a
    null id is in no component (null); an empty table gives no rows; other
    columns are not read.

    Of equal texts the first alone goes on; equal sets are one node. Signatures
    go to buckets packed, seven bytes each as a rule; links and components stay
    in tables. No step emits all pairs of a group.
    """
    scheme, width = PartEnum(percent, 100), shuffle_width(docs)
    marks = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text", F.length("text")).alias("b")]
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", "text", *marks)
    known = texts.filter(F.col("id").isNotNull())
    # of equal texts the first alone goes on
    worded = known.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    first_texts = worded.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("a", "b", "first")
    text_copies = stored(worded.select("id", "a", "b").join(materialized(first_texts), ["a", "b"]).filter("id > first"))
    gone = text_copies.select("id", "a", "b").distinct()
    own = texts.join(F.broadcast(gone) if text_copies.count() <= BROADCAST_IDS else gone, ["id", "a", "b"], "left_anti")
    first_pass = stored(sharing(emitted(own, words, scheme, BUCKETS * width), width))
    release(docs.sparkSession)  # the packed signatures' shuffle, the largest
    facts = stored(first_pass.filter("code IS NULL").drop("code"))
    equal = materialized(facts.filter("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"))
    copies = materialized(facts.join(equal, ["n", "h1", "h2"]).select("id", "first").distinct())
    of_first = copies.groupBy("id").agg(F.min("first").alias("first"))
    # rows that share an id
    doubled = copies.join(of_first.withColumnRenamed("first", "least"), "id").filter("first > least").select(F.col("least").alias("a"), F.col("first").alias("b"))
    node = lambda x: F.coalesce("first", x)
    again = text_copies.select("id", F.col("first").alias("other")).join(facts.select("id").union(text_copies.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")).distinct(), "id", "left_semi")
    again = again.join(of_first, "id", "left").select(node("id").alias("x"), "other").join(of_first.withColumnRenamed("id", "other"), "other", "left").select("x", node("other").alias("y")).filter("x <> y")
    doubled = doubled.union(again.select(F.least("x", "y"), F.greatest("x", "y")))

    shared = first_pass.filter("code IS NOT NULL").select("code", "id").join(of_first, "id", "left").select("code", node("id").alias("id")).distinct()
    firsts = shared.groupBy("code").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").drop("last")
    shared = stored(shared.join(firsts, "code"))
    discard(first_pass)
    del firsts
    release(docs.sparkSession)
    starred = shared.filter("a < id").select("a", F.col("id").alias("b")).distinct()
    links = verified(starred, facts, known, words, percent, 100).union(doubled)
    label = components(links)
    release(docs.sparkSession)

    told = differences(incidences(shared.drop("a"), label), facts, known, words, percent, 100)
    discard(shared)
    release(docs.sparkSession)
    more = told.filter("inner").select("p", "id").union(verified(pairs_of_families(told, percent, 100), facts, known, words, percent, 100)).union(verified(pairs_of_strangers(told, known, words, percent, 100), facts, known, words, percent, 100))
    more = materialized(more)
    if more.limit(1).count():
        label = components(links.union(more))

    named = facts.join(of_first, "id", "left").select("id", "a", "b", "n", node("id").alias("node"))
    copied = text_copies.join(named.select(F.col("id").alias("first"), "a", "b", "n", "node").distinct(), ["first", "a", "b"]).select("id", "a", "b", "n", "node")
    whole = named.union(copied).join(label.withColumnRenamed("id", "node"), "node", "left")
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without near-duplicates of a document with a smaller id.

    Rows with a null id, a null text or no words stay; rows that share an id
    stay or go together; of equal texts the one with the least id stays; an
    empty table gives no rows; other columns may have any name.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    gone = materialized(found.filter(F.col(id_col) > F.col("component_id")).select(F.col(id_col).cast("long").alias("key")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("key"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "key", "left_anti").select("row.*")
