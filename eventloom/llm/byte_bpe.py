"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A match of the split pattern is encoded by halves down to runs of a few bytes.
Two encoded halves are joined by encoding a window around the seam again, one
token of each side at first, twice as many each time, until the tokens outside
it are proven final: a sequence of tokens is the encoding of its bytes exactly
if every neighbouring pair is the encoding of its own bytes. What a pair, or a
run of a few bytes, encodes to is kept.

A text is encoded by halves too. A leaf is cut into units, each a run of white
space and the word behind it. Between a non-space and a space the split
pattern always starts a new match, and a match depends only on what follows
its start, so a unit is encoded alone whatever surrounds it, once in a worker;
when two halves meet, only the last unit of the left and the first of the
right can change, and they are encoded again as one window.

Decoding concatenates the tokens' bytes up a tree of the same shape.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, arrow_map

LEAF_CHARS, LEAF_IDS, LEAF_BYTES = 1024, 512, 6
#: Units (of KEPT_CHARS at most), nodes (of KEPT_BYTES) and pairs whose ids a Python worker keeps; beyond that it starts afresh.
CACHED_UNITS, CACHED_NODES, KEPT_CHARS, KEPT_BYTES = 400_000, 150_000, 64, 10
#: A leaf without these is cut at its single spaces.
_ODD = re.compile(r"[ ]\s|[\x1c-\x1f]|\A\s|\s\Z")
_UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


#: Marks that end a word.
MARKS = ".,;:!?"


def halves(unit: str) -> tuple[str, str] | None:
    """A word and the mark behind it, which are matches of their own."""
    return (unit[:-1], unit[-1]) if unit[-1] in MARKS and unit[:-1].removeprefix(" ").isalpha() else None


class ByteRanks:
    """A vocabulary of ranks, and the encoding of single matches under it."""

    def __init__(self, rank_file: bytes):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.nodes: dict[bytes, list[int]] = {}
        self.changed: dict[tuple[int, int], list[int] | None] = {}

    def merged(self, data: bytes) -> list[int]:
        """Lowest rank first, the leftmost of equals, until no pair has a rank."""
        ranks, n = self.ranks, len(data)
        if n <= 48:
            parts, none, get = [data[i : i + 1] for i in range(n)], len(self.bytes_of), ranks.get
            rank = [get(data[i : i + 2], none) for i in range(n - 1)]
            while rank and (least := min(rank)) < none:
                i = rank.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del rank[i]
                if i:
                    rank[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(rank):
                    rank[i] = get(parts[i] + parts[i + 1], none)
            return [ranks[x] for x in parts]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i and ends at end[i]
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != to:
                continue
            gone[end[i]] = 1
            end[i] = to
            if to < n:
                before[to] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def change(self, a: int, b: int) -> list[int] | None:
        """What the bytes of two tokens are encoded to; None if to these two, which are then final."""
        if (a, b) in self.changed:
            return self.changed[a, b]
        if len(self.changed) >= CACHED_NODES:
            self.changed.clear()
        found = self.merged(self.bytes_of[a] + self.bytes_of[b])
        self.changed[a, b] = found = None if found == [a, b] else found
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, by a window around the seam that grows until what lies outside is final."""
        middle, k = self.change(left[-1], right[0]), 1
        if middle is None:
            return left + right
        while (k < len(left) and self.change(left[-k - 1], middle[0]) is not None) or (k < len(right) and self.change(middle[-1], right[k]) is not None):
            k *= 2
            middle = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-k:] + right[:k])))
        return left[:-k] + middle + right[k:]

    def node(self, data: bytes) -> list[int]:
        if (known := self.nodes.get(data)) is None:
            half = (len(data) + 1) // 2
            known = self.merged(data) if len(data) <= LEAF_BYTES else self.joined(self.node(data[:half]), self.node(data[half:]))
            if len(data) <= KEPT_BYTES:
                if len(self.nodes) >= CACHED_NODES:
                    self.nodes.clear()
                self.nodes[data] = known
        return known

    def match(self, data: bytes) -> list[int]:
        """A match that is a token is that token; any other is a tree."""
        return self.node(data) if (rank := self.ranks.get(data)) is None else [rank]


class TreeCodec:
    """Whole texts to token ids and back."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = ByteRanks(rank_file)
        inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.matches = regex.compile(inside)
        self.known: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        """Ids of a unit, as little-endian unsigned 32-bit integers."""
        if both := halves(text):
            code = b"".join([self.known.get(x) or self.unit(x) for x in both])
        elif text.removeprefix(" ").isalpha():  # letters are one match
            code = array("I", self.vocabulary.match(text.encode())).tobytes()
        else:
            code = array("I", [i for match in self.matches.findall(text) for i in self.vocabulary.match(match.encode())]).tobytes()
        if len(text) <= KEPT_CHARS:
            if len(self.known) >= CACHED_UNITS:
                self.known.clear()
            self.known[text] = code
        return code

    def leaf(self, text: str) -> tuple[list[bytes], str, str]:
        """Its units' ids, and the texts of the first and the last unit."""
        if _ODD.search(text):
            units = _UNIT.findall(text)
        else:
            first, *rest = text.split(" ")
            units = [first, *[" " + x for x in rest]]
        get, unit = self.known.get, self.unit
        return [get(u) or unit(u) for u in units], units[0], units[-1]

    def node(self, text: str) -> tuple[list[bytes], str, str]:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        half = len(text) // 2
        left, first, seam = self.node(text[:half])
        right, mate, last = self.node(text[half:])
        window, opening, closing = self.leaf(seam + mate)
        if len(left) == 1:
            first = opening
        if len(right) == 1:
            last = closing
        left.pop()
        left += window
        left += right[1:]
        return left, first, last

    def encode(self, text: str) -> bytes:
        return b"".join(self.node(text)[0]) if text else b""

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def shared_codec(rank_file: bytes, pattern: str) -> TreeCodec:
    """One codec for each Python worker, so that later tasks start with its known units."""
    return TreeCodec(rank_file, pattern)


def encoded(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the token ids of its whole text: (id, ids array<long>); null texts give no ids."""
    held = docs.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = shared_codec(held.value, pattern)
        return lambda b: {"id": b["id"], "ids": [np.frombuffer(codec.encode(t or ""), "<u4").astype(np.int64) for t in b["text"]]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, f"id {dict(docs.dtypes)[id_col]}, ids array<long>", make).withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids: (id, data binary); null ids give no bytes."""
    held = tokens.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = shared_codec(held.value, pattern)
        return lambda b: {"id": b["id"], "data": [codec.decode(x or []) for x in b["ids"]]}

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return arrow_map(rows, f"id {dict(tokens.dtypes)[id_col]}, data binary", make).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and digest of its ids, and the digest of what they decode to.

    A null text is empty: no tokens, and the digests of no bytes. Repeated
    rows each give a row, an empty table gives none, a null id stays null, and
    other columns are not read. Nothing of a document leaves its row, so the
    ids never travel between executors.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        codec = shared_codec(held.value, pattern)

        def apply(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"id": batch["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"]:
                code = codec.encode(text or "")
                out["n_tokens"].append(len(code) // 4)
                out["ids_sha256"].append(hashlib.sha256(code).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(np.frombuffer(code, "<u4").tolist())).hexdigest())
            return out

        return apply

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string", make).withColumnRenamed("id", id_col)
