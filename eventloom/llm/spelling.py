"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words that differ by one inserted, deleted or replaced code point, one
contributes two disjoint chunks, its first and its last half, and the other its
positional grams of a half's length. One edit touches one chunk at most, and the
other is a gram of the other word: the first half at its own place, the last half
moved by the difference of lengths, which is one at most. Grams that no chunk can
meet at such a place are not sent. What shares a chunk is verified on the rest
of the words, as the edit is in there.

A chunk that very many words share is not verified pair by pair: what is left of
its words differs by the same one edit, so it is halved again, and so on until
few words share a signature or a single code point is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, pieces_of, small_batches

#: Letters of a word, as the contract has them.
LETTERS = r"A-Za-zÀ-ÿ"
BLOCK_CHARS = 1 << 20
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
#: Pairs of words that may be verified for one signature; above that it is made longer.
PAIRS = 1_000_000
_KEY = ["size", "head", "tail", "a", "b"]


def _blocks(text: str, other: re.Pattern) -> Iterator[str]:
    """A text in parts of about BLOCK_CHARS that cut no run of letters; ``other`` matches what is no letter."""
    start = 0
    while start < len(text):
        gap = other.search(text, start + BLOCK_CHARS)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def occurrences(docs: DataFrame, least_chars: int, drop_modulus: int | None, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the maximal runs of letters with ``least_chars`` code points or more, counted over whole texts.

    With a ``drop_modulus``, a run whose crc32 with its document's id is a
    multiple of it loses the code point at the crc's remainder by its length.
    """
    own = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, other = re.compile(f"[{LETTERS}]{{{least_chars},}}"), re.compile(f"[^{LETTERS}]")
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for part in (piece for batch in parts for piece in pieces_of(batch, "text")):
            for key, value in zip(part.column("id"), part.column("text")):
                text = value.as_py() or ""
                low = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: A-Z alone
                mark = zlib.crc32(f"{key.as_py()}:".encode())
                for block in _blocks(low, other):
                    found = Counter(runs.findall(block))
                    if drop_modulus:
                        for word in [w for w in found if zlib.crc32(w.encode(), mark) % drop_modulus == 0]:
                            at = zlib.crc32(word.encode(), mark) % len(word)
                            times, cut = found.pop(word), word[:at] + word[at + 1 :]
                            if len(cut) >= least_chars:
                                counts[cut] += times
                    counts.update(found)
                    if len(counts) > COUNTED:
                        yield sent()
        yield sent()

    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _half(n: Column | int) -> Column:
    return F.floor(n / 2).cast("int")


def _tails(word: Column, b: Column) -> Column:
    return F.substring(word, F.length(word) - b + 1, b)


def _signed(words: DataFrame, side: str) -> DataFrame:
    """Rows with ``size`` (the length of the word with the chunks), ``a`` and ``b`` (code points of the head and tail that are shared) and these."""
    long_enough = F.length("word") >= F.col("a") + F.col("b")
    return words.filter(long_enough).select("size", F.substring("word", F.lit(1), F.col("a")).alias("head"), _tails(F.col("word"), F.col("b")).alias("tail"), "a", "b", F.col("word").alias(side), F.col("n").alias(f"n_{side}"))


def _halved(words: DataFrame) -> DataFrame:
    """Each row twice: once with the head made longer by half of what is left of ``size``, once with the tail."""
    more = _half(F.col("size") - F.col("a") - F.col("b"))
    both = F.array(F.struct((F.col("a") + more).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + more).alias("b")))
    return words.select("word", "n", "size", F.explode(both).alias("cut")).select("word", "n", "size", "cut.a", "cut.b")


def near_words(words: DataFrame, least_chars: int) -> DataFrame:
    """(word, near, n_near): of every word all words one edit apart, with their counts, from (word, n)."""
    blank = [F.lit(0).alias("a"), F.lit(0).alias("b")]
    size = F.length("word").cast("int")
    chunks = words.select("word", "n", size.alias("size"), *blank)
    grams = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("size"), *blank).filter(F.col("size") >= least_chars)
    found = []
    while True:
        chunks, grams = _signed(_halved(chunks), "word"), _signed(_halved(grams), "near")
        counted = chunks.select(*_KEY, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(grams.select(*_KEY, F.lit(0), F.lit(1))).groupBy(*_KEY).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        # what is one code point can't be halved; what shares all the rest of a word is a variant
        hot = materialized(counted.filter((F.col("x") * F.col("y") > PAIRS) & (F.col("size") - F.col("a") - F.col("b") > 1)).select(*_KEY))
        again = hot.limit(1).count() > 0
        cool = chunks.join(hot, _KEY, "left_anti") if again else chunks
        met = cool.join(grams, _KEY).filter(F.col("word") != F.col("near"))
        rest = lambda c: F.substring(c, F.col("a") + 1, F.length(c) - F.col("a") - F.col("b"))
        found.append(met.filter(F.levenshtein(rest("word"), rest("near"), 1) == 1).select("word", "near", F.col("n_near").alias("n_near")))
        if not again:
            return reduce(DataFrame.unionAll, found).distinct()
        chunks, grams = (materialized(x.join(hot, _KEY, "left_semi").select(F.col(c).alias("word"), F.col(f"n_{c}").alias("n"), "size", "a", "b")) for x, c in ((chunks, "word"), (grams, "near")))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): where each word of (word, form) ends; a form counts several times its word, so that a chain is as long as a logarithm of the counts."""
    roots = materialized(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialized(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return roots


def spelling_variants(
    docs: DataFrame, least_chars: int = 6, least_count: int = 5, ratio: int = 5, drop_modulus: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``least_chars`` code points and ``least_count`` occurrences or more.

    A word is a maximal run of [A-Za-z] and U+00C0 to U+00FF with A-Z
    lower-cased. Near words differ by exactly one inserted, deleted or replaced
    code point. A word's form is its near word of largest ``n`` (ties: the
    smallest in code-point order), if that is ``ratio`` times the word's ``n``
    or more; ``root`` is where the forms lead. Null and empty texts have no
    words, a null id is an empty string to the crc; repeated rows count again;
    texts and runs may have any length; other columns are not read; no
    documents give no rows.

    Texts are counted in their tasks; only words and counts are shuffled. A word
    has at most some 180 near words for each of its code points, so that neither
    its variants nor the words that lead to it are a hot group.
    """
    words = materialized(occurrences(docs, least_chars, drop_modulus, id_col, text_col).filter(F.col("n") >= least_count))
    near = near_words(words, least_chars)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("back"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.back") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.back")).alias("form_n"))
    told = materialized(told)
    roots = followed(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
