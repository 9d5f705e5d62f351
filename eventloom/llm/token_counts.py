"""Token counts by rank-synchronous array merging.

Words of a batch that have not been met are split into pre-tokens, and the
pre-tokens are held together as one ragged numpy array of symbols. In each
round every pre-token merges all places of its own lowest-rank pair at once;
a pre-token leaves when no pair of it has a rank. What is left are its tokens.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, arrow_map

#: Words whose count a task keeps; beyond that it starts afresh.
CACHED_WORDS = 400_000
_CONTROL_SPACE = regex.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCounter:
    """Counts tokens of whole texts under a word-end BPE vocabulary file."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + end, -1) for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE_SPACE))
        self.spaces = regex.compile(f"[{WHITE_SPACE}]+")
        self.known: dict[str, int] = {"": 0}

    def merged_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty pre-token, all merged side by side."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        real = symbols >= 0
        symbols, owner = symbols[real], owner[real]
        counts = np.bincount(owner, minlength=len(pieces))
        no_rank = len(self.keys)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), no_rank - 1)
            mergeable = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(mergeable, self.ranks[at], no_rank)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            # a pair belongs to the owner of its left symbol; the last place of each owner has no rank
            lowest = np.minimum.reduceat(np.r_[rank, no_rank], first)
            length = np.diff(np.r_[first, len(symbols)])
            going = np.repeat(lowest < no_rank, length)
            hit = np.r_[rank, no_rank] == np.repeat(lowest, length)
            hit &= going
            if not hit.any():
                break
            index = np.arange(len(symbols))
            opens = hit & ~np.r_[False, hit[:-1]]
            hit &= (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0  # x x x: the left pair first
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            counts -= np.bincount(owner[where], minlength=len(counts))
            keep = going & ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, words: list[str]) -> None:
        """Count the words that are not known yet."""
        pieces, of = [], []
        for i, word in enumerate(words):
            # per character, as no context (final sigma) changes a letter's lower case here
            low = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            for piece in self.pieces.findall(low):
                pieces.append(piece.encode())
                of.append(i)
        totals = np.zeros(len(words), np.int64)
        if pieces:
            totals = np.bincount(of, weights=self.merged_counts(pieces), minlength=len(words)).astype(np.int64)
        self.known.update(zip(words, totals.tolist()))

    def words(self, text: str) -> list[str]:
        return self.spaces.split(text) if _CONTROL_SPACE.search(text) else text.split()

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHED_WORDS:
            self.known = {"": 0}
        extra = [0] * len(texts)
        split = []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                split.append([w for p in parts for w in self.words(p)])
            else:
                split.append(self.words(text))
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(extra, split)]


@lru_cache(maxsize=4)
def shared_counter(vocabulary: bytes) -> WordCounter:
    """One counter for each Python worker, so that later tasks start with its known words."""
    return WordCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: bytes, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the bytes and tokens of its whole text, and whether the tokens exceed ``limit``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows each give a row; other columns are not read, so their names
    can't clash; an empty table gives no rows. Words are independent of each
    other, so texts of any length take one pass. ``vocabulary`` is the content
    of the vocabulary file, of fixed size, sent to executors once.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counter = shared_counter(held.value)

        def apply(batch: dict[str, list]) -> dict[str, list]:
            texts = [t or "" for t in batch["text"]]
            counts: list[int] = []
            for i in range(0, len(texts), 256):
                counts += counter.counts(texts[i : i + 256])
            return {"id": batch["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return apply

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", make).withColumnRenamed("id", id_col)
