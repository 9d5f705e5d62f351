"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers, by hash,
is its first or its last (ties count, so that any 2k - s - 1 code points hold
one). That depends on the k-mer alone, so an edit changes only anchors that it
touches; the anchors of an edited text are those of the part that stayed and
those found around the edit. Likeness matches equal anchors in order, of the
finest scheme that both texts have: lengths of two schemes overlap, so that a
text and three quarters of it share one whose anchors fit in the quarters.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices_of, small_batches
from .words import Runs, mixed

#: (k, s) for texts, for short texts and for those too short even for these; the lengths from and below which each is used.
LONG, SHORT, TINY = (48, 12), (12, 4), (3, 2)
SCHEMES = (TINY, SHORT, LONG)
LENGTHS = ((0, 32), (24, 128), (96, 1 << 62))
_DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~", np.uint8)
_VALUE = {c: i for i, c in enumerate(_DIGITS.tobytes())}
HASH_DIGITS, GAP_DIGITS = 5, 2  # of 6 bits; the first two bits of the gap's digits are the scheme's number
HASH_BITS, GAP_BITS = 30, 10
FEW_PLACES = 16
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def syncmers(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 30-bit hashes of the closed syncmers, above a hash the scheme's number."""
    if len(points) < k:
        return _NONE
    runs = Runs(mixed(points))
    inner = mixed(runs.every(s))
    span, reach, least = k - s, 1, inner  # least of the k - s s-mers from each place
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    n = len(points) - k + 1
    at = np.flatnonzero((inner[:n] <= least[1 : n + 1]) | (inner[span : span + n] <= least[:n]))
    return at, (mixed(runs.at(at, k)) >> np.uint64(34)).astype(np.int64) | SCHEMES.index((k, s)) << HASH_BITS


def schemes_of(n: int) -> list[tuple[int, int]]:
    """The one or two schemes of a text's length, the finest first."""
    return [scheme for scheme, (least, end) in zip(SCHEMES, LENGTHS) if least <= n < end]


def scheme_of(n: int) -> tuple[int, int]:
    return schemes_of(n)[-1]


def whole(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text too short for a syncmer is one anchor; an empty text has none."""
    if not len(points):
        return _NONE
    runs = Runs(mixed(points))
    return np.zeros(1, np.int64), (mixed(runs.at(np.zeros(1, np.int64), len(points))) >> np.uint64(34)).astype(np.int64)


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes by each of the text's schemes in turn."""
    parts = [syncmers(points, *scheme) for scheme in schemes_of(len(points))]
    found = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))
    return found if len(found[0]) else whole(points)


def edited_anchors(points: np.ndarray, known: tuple[np.ndarray, np.ndarray], cut: int, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of points[:cut] + tail, from the anchors of points."""
    (k, s), *more = schemes_of(cut + len(tail))
    if more or schemes_of(len(points)) != [(k, s)] or cut < k:
        return anchors(np.concatenate([points[:cut], tail]))
    same = known[0] + k <= cut
    at, value = syncmers(np.concatenate([points[cut - k + 1 : cut], tail]), k, s)
    found = np.concatenate([known[0][same], at + cut - k + 1]), np.concatenate([known[1][same], value])
    return found if len(found[0]) else whole(np.concatenate([points[:cut], tail]))


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint: for each anchor five digits of its hash and two of its scheme and its distance from the scheme's anchor before."""
    at, value = found
    scheme = value >> HASH_BITS
    gap = np.where(np.diff(scheme, prepend=-1) > 0, at, np.diff(at, prepend=0)) | scheme << GAP_BITS
    digits = [value >> 6 * i & 63 for i in reversed(range(HASH_DIGITS))] + [gap >> 6 * i & 63 for i in reversed(range(GAP_DIGITS))]
    return _DIGITS[np.stack(digits, axis=1)].tobytes().decode() if len(at) else ""


def hashes_in(fingerprint: str) -> list[int]:
    step, out = HASH_DIGITS + GAP_DIGITS, []
    data = fingerprint.encode()
    for i in range(0, len(data), step):
        value = 0
        for c in data[i : i + HASH_DIGITS]:
            value = value << 6 | _VALUE[c]
        out.append(value | _VALUE[data[i + HASH_DIGITS]] >> GAP_BITS - 6 << HASH_BITS)
    return out


def in_order(a: list[int], b: list[int]) -> int:
    """The most values that can be matched in the same order."""
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(len(b) - 1, -1, -1):
        places[b[i]].append(i)
    a = [x for x in a if x in places]
    if sum(len(places[x]) for x in a) <= FEW_PLACES * (len(a) + len(b)):
        chain: list[int] = []  # least last place of a chain of each length
        for x in a:
            for i in places[x]:
                j = bisect_left(chain, i)
                chain[j : j + 1] = [i]
        return lead + end + len(chain)
    # repetitive texts have too many pairs of equal anchors: a row of bits for each value, a zero in the sum for each match
    full, masks = (1 << len(b)) - 1, {}
    rest = full
    for x in a:
        mask = masks.get(x)
        if mask is None:
            bits = np.zeros(len(b), np.uint8)
            bits[places[x]] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(places[x]) > FEW_PLACES:
                masks[x] = mask
        both = rest & mask
        rest = (rest + both | rest - both) & full
    return lead + end + len(b) - rest.bit_count()


def likeness(a: list[int], b: list[int]) -> float:
    """Twice the anchors matched in the same order, over all, by the finest scheme of both; two empty fingerprints are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    scheme = max(a[0], b[0]) >> HASH_BITS
    if scheme > min(a[-1], b[-1]) >> HASH_BITS:
        return 0.0
    a, b = (x if x[0] >> HASH_BITS == x[-1] >> HASH_BITS else [v for v in x if v >> HASH_BITS == scheme] for x in (a, b))
    return 0.0 if set(a).isdisjoint(b) else 2 * in_order(a, b) / (len(a) + len(b))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, guard, key, id, text) sorted so that each row's successor by (id, text) follows it.

    Ids are cut into ranges; the first row of each range also goes, as a
    guard, behind the range before it, and that of the first behind the last.
    Only the cuts and the ranges' least ids (as many as partitions) meet.
    """
    width = shuffle_width(docs)
    rows = docs.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    cuts = sorted(set(rows.approxQuantile("key", [i / width for i in range(1, width)], 0.1 / width)))
    cuts = [int(c) for c in cuts] or [0]
    split = rows.withColumn("own", F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c <= key))"))
    heads = sorted((r["own"], r["head"]) for r in split.groupBy("own").agg(F.min("key").alias("head")).collect())
    if not heads:
        return split.select(F.col("own").alias("part"), F.lit(False).alias("guard"), "key", "id", "text")
    before = F.create_map(*[x for i, (_, head) in enumerate(heads) for x in (F.lit(head), F.lit(heads[i - 1][0]))])
    sent = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guard")))
    sent = F.when(before[F.col("key")].isNotNull(), F.concat(sent, F.array(F.struct(before[F.col("key")].alias("part"), F.lit(True).alias("guard"))))).otherwise(sent)
    return split.select(F.explode(sent).alias("to"), "key", "id", "text").select("to.part", "to.guard", "key", "id", "text").repartitionByRange(width, "part").sortWithinPartitions("part", "guard", "key", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of an edited text, and their likeness, and its likeness to the next document.

    The edited text has its last floor(n / 4) code points replaced by the first
    as many (or all) of the next document by ascending id, after the last the
    first. Null texts are empty (an empty fingerprint; two of those have
    likeness 1); null ids come first; rows that share an id follow in the order
    of their texts; equal texts have equal fingerprints; an empty table gives
    no rows; other columns are not read. Ids are integers. A task holds two
    documents at a time.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def described(text: str, points: np.ndarray, found: tuple, next_text: str, next_found: tuple) -> tuple:
        n = len(points)
        replacement = next_text[: n // 4]
        changed = edited_anchors(points, found, n - n // 4, code_points(replacement))
        own = found[1].tolist()
        edited = hashlib.sha256((text[: n - n // 4] + replacement).encode()).hexdigest()
        return n, edited, written(found), written(changed), likeness(own, changed[1].tolist()), likeness(own, next_found[1].tolist())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in (piece for batch in parts for piece in slices_of(batch)):
            out: list[tuple] = []
            for to, guard, key, text in zip(*(part.column(c).to_pylist() for c in ("part", "guard", "id", "text"))):
                if guard and last is not None and last[1]:
                    continue
                points = code_points(text)
                found = anchors(points)
                if last is not None and not last[1]:
                    out.append((last[2], *described(*last[3:], text, found)))
                last = (to, guard, key, text, points, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [part.schema.field("id").type, *kinds])], names)

    kind = dict(docs.dtypes)[id_col]
    return with_next(rows).mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
