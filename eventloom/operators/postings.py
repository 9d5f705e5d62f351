"""Keyword search over impact-ordered blocks of postings, of which a query reads only those that can matter.

A term's postings are cut into blocks by the size of their weights, so that a
block's largest weight bounds all of it. A query takes its terms' first blocks,
scores what they hold exactly, and so knows a score that its k-th best document
reaches. With its terms in the order of their largest possible shares, a
document among the best is met in a block of the largest of its terms; there its
score is at most the block's bound and the largest shares of all smaller terms.
Blocks whose bound stays under the score known are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings of a block, about.
BLOCK_ROWS = 128
#: Levels of weight for each halving.
LEVELS = 4
#: Slack of a bound, over the rounding of scores.
SLACK = 1e-6
#: Places that scores are rounded to; ties go to the smaller id.
PLACES = 6


def posting_blocks(weights: DataFrame, id_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(term, top, n, postings) from (id, term, weight > 0), where ``postings`` has (id, weight) and ``top`` is their largest weight.

    Weights of one level lie within a quarter of a halving of each other; a
    level of many postings is dealt into blocks by a hash, so that no task sorts
    a term's postings, however frequent it is.
    """
    level = F.floor(-F.log2("weight") * LEVELS).cast("int")
    rows = weights.filter("weight > 0").select("term", level.alias("level"), F.col(id_col).alias("id"), "weight")
    sizes = rows.groupBy("term", "level").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("pieces"))
    # of levels that fit into one block (nearly all of them, and all of rare terms) nothing needs to be known
    large = sizes.filter("pieces > 1")
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int")
    dealt = rows.join(large, ["term", "level"], "left").withColumn("piece", piece)
    return dealt.groupBy("term", "level", "piece").agg(F.max("weight").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("id", "weight")).alias("postings")).drop("level", "piece")


def _scores(candidates: DataFrame, weights: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    """(query_id, id, score) of candidates (query_id, id), from all terms that query and document share."""
    asked = queries.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("q"))
    held = weights.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("term", "weight")).alias("d"))
    shares = F.transform("d", lambda x: F.coalesce(F.col("q")[x["term"]], F.lit(0.0)) * x["weight"])
    total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return candidates.join(held, "id").join(asked, "query_id").select("query_id", "id", F.round(total, PLACES).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def blocks_read(blocks: DataFrame, queries: DataFrame, known: DataFrame) -> DataFrame:
    """The blocks, with query_id, that may hold a document with a score of ``known`` (query_id, least) or more; without a row there, all that the query's terms have."""
    tops = blocks.groupBy("term").agg(F.max("top").alias("most"))
    shares = queries.join(tops, "term").select("query_id", "term", F.col("weight").alias("q"), (F.col("weight") * F.col("most")).alias("share"))
    smaller = Window.partitionBy("query_id").orderBy("share", "term").rowsBetween(Window.unboundedPreceding, -1)
    bounded = shares.withColumn("rest", F.coalesce(F.sum("share").over(smaller), F.lit(0.0))).join(known, "query_id", "left")
    may: Column = F.col("least").isNull() | (F.col("q") * F.col("top") + F.col("rest") >= F.col("least") - SLACK)
    return blocks.join(bounded.select("query_id", "term", "q", "rest", "least"), "term").filter(may).select("query_id", "n", "postings")


def first_blocks(blocks: DataFrame, queries: DataFrame, each: int) -> DataFrame:
    """Of each query's terms the ``each`` blocks of largest weights."""
    order = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top"), F.desc("n"), F.xxhash64("postings")))
    heads = blocks.withColumn("at", order).filter(F.col("at") <= each)
    return heads.join(queries.select("query_id", "term"), "term").select("query_id", "n", "postings")


def keyword_search(blocks: DataFrame, weights: DataFrame, queries: DataFrame, id_col: str, k: int = 10, each: int = 1) -> DataFrame:
    """(query_id, id, score, rank): the k documents of largest score to each query, as by an exhaustive search.

    ``weights`` has (id, term, weight) and ``queries`` (query_id, term, weight),
    a term once for each; ``blocks`` are ``posting_blocks`` of the weights.
    Scores are rounded to six places and ties go to the smaller id. Documents
    that share no term with a query are not found by it.
    """
    asked = queries.filter("weight > 0").select("query_id", "term", "weight")
    ids = lambda read: read.select("query_id", F.explode("postings.id").alias("id")).distinct()
    first = _best(_scores(ids(first_blocks(blocks, asked, each)), weights, asked, id_col), k)
    known = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found")).filter(F.col("found") == k).select("query_id", "least")
    read = blocks_read(blocks, asked, known)
    return _best(_scores(ids(read), weights, asked, id_col), k).withColumnRenamed("id", id_col)
