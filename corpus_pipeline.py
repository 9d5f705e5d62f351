"""The corpus pipeline over ``documents``: quality rules, line dedup, near-duplicates, substring dedup, packing.

Each stage takes what the stage before it kept; all but the last return the
columns of ``documents``. A stage's source may be null or its texts empty, and
extra columns pass through all but the last; see the operators' own docstrings.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm.common import discard, stored
from eventloom.llm.line_dedup import without_shared_lines
from eventloom.llm.ngram_join import one_of_each
from eventloom.llm.packing import packed
from eventloom.llm.quality_rules import passing
from eventloom.llm.substring_dedup import without_repeats

SEQUENCE_TOKENS = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not condemned.

    A null or empty text fails; a null source is a host of its own; a null id
    and repeated rows are judged like any other row; of a very long text every
    word is judged; no documents give none.
    """
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share.

    A null text is one empty line and becomes an empty text; repeated rows,
    also those with a null id, count as a document each; texts are whole,
    however long; no documents give none.
    """
    return without_shared_lines(docs, min_docs=10)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each near-duplicate group (five words, similarity 0.8).

    Documents without words and rows with a null id stay; of equal texts the
    least id stays; rows that share an id stay or go together; texts are whole,
    however long; no documents give none.
    """
    return one_of_each(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of fifty words that a document with a smaller id has.

    Rows with a null id neither lose nor take words, rows that share an id do
    not repeat each other; a text may become empty and stays a document; null
    texts stay null; no documents give none.
    """
    return without_repeats(docs, window=50)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in training sequences.

    A null or empty text is the end token alone; repeated rows and null ids are
    packed like any other; longer texts than a sequence are cut into pieces;
    ties between equal lengths are placed by id; no documents give no pieces.
    """
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    return packed(docs, vocabulary, public_tokenizers.PATTERN, SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: near-duplicate components and tokens are beyond it; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written as Parquet and read again, and goes once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
