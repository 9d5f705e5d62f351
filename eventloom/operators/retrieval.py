"""Chunks of documents, and their retrieval by embeddings, by terms and by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .products import best_products, best_shared_products


def chunk_fixed(df: DataFrame, id_col: str, text_col: str, width: int = 700, step: int = 600, least: int = 100) -> DataFrame:
    """Chunks of a width at every step; short ones go, and positions count those kept."""
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    pieces = F.filter(F.transform(starts, lambda s: F.substring(F.col(text_col), s + 1, F.lit(width))), lambda t: F.length(t) >= least)
    return df.select(id_col, F.posexplode(pieces).alias("chunk_position", "chunk_text"))


def chunk_paragraphs(df: DataFrame, id_col: str, text_col: str, separator: str = "\n\n", most: int = 1000, least: int = 300, overlap: int = 100) -> DataFrame:
    """Paragraphs packed up to a size, then a little of both neighbours added to each."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(a: Column, p: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(p) + 2 <= most
        joined = F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p))
        full = F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        return F.struct(F.when(fits, a["done"]).otherwise(full).alias("done"), F.when(fits, joined).otherwise(p).alias("cur"))

    sentences = lambda p: F.when(F.length(p) > most, F.split(p, r"(?<=[.!?])\s+")).otherwise(F.array(p))
    parts = F.filter(F.flatten(F.transform(F.split(F.col(text_col), separator), lambda p: sentences(F.trim(p)))), lambda p: p != "")
    packed = F.aggregate(parts, empty, pack, lambda a: F.filter(F.concat(a["done"], F.array(a["cur"])), lambda c: F.length(c) >= least))
    rows = df.select(id_col, F.posexplode(packed).alias("chunk_position", "_c"))
    w = Window.partitionBy(id_col).orderBy("chunk_position")
    before, after = F.coalesce(F.substring(F.lag("_c").over(w), -overlap, overlap), F.lit("")), F.coalesce(F.substring(F.lead("_c").over(w), 1, overlap), F.lit(""))
    return rows.select(id_col, "chunk_position", F.trim(F.concat_ws(" ", before, "_c", after)).alias("chunk_text"))


def chunk_by_item(df: DataFrame, id_col: str, text_col: str, **sizes: int) -> DataFrame:
    """Texts split at ``[ITEM n]`` headers (FULL without one), each item chunked by paragraphs."""
    marked = F.regexp_replace(F.col(text_col), r"\[ITEM ([^\]]+)\]", "\u0001$1\u0002")
    pieces = df.select(id_col, F.explode(F.split(marked, "\u0001")).alias("_p")).filter(F.trim("_p") != "")
    item = F.when(F.col("_p").contains("\u0002"), F.split_part("_p", F.lit("\u0002"), F.lit(1))).otherwise("FULL")
    body = F.element_at(F.split("_p", "\u0002"), -1)
    items = pieces.select(F.struct(F.col(id_col).alias("id"), item.alias("item")).alias("_k"), body.alias("_t"))
    return chunk_paragraphs(items, "_k", "_t", **sizes).select(F.col("_k.id").alias(id_col), F.col("_k.item").alias("item"), "chunk_position", "chunk_text")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries that a chunk meets at a time.
QUERY_BLOCK = 256


def unit(v: Column) -> Column:
    """A vector of length 1; null for a zero vector."""
    length = F.sqrt(dot(v, v))
    return F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))[0]


def scored(chunks: DataFrame, queries: DataFrame, vector: str, query_vector: str, query_id: str) -> DataFrame:
    """Each chunk with its similarity to each of a stated set of queries, which travel in blocks; lengths are taken once."""
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    held = queries.groupBy(F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct(F.col(query_id).alias("q"), unit(F.col(query_vector)).alias("v"))).alias("_q")).select("_q")
    each = chunks.withColumn("_u", unit(F.col(vector))).crossJoin(F.broadcast(held) if blocks == 1 else held).withColumn("_q", F.explode("_q"))
    return each.withColumn("query_id", F.col("_q.q")).withColumn("score", dot(F.col("_u"), F.col("_q.v"))).drop("_q", "_u")


def retrieve_sum(chunks: DataFrame, queries: DataFrame, group: str, chunk: str, vector: str, query_vector: str, k: int) -> DataFrame:
    """The k chunks of each group with the largest summed similarity to all queries: that to the sum of the queries' unit vectors."""
    parts = queries.select(F.posexplode(unit(F.col(query_vector))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    whole = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])).scalar()
    sums = chunks.withColumn("_w", whole).select(group, chunk, dot(unit(F.col(vector)), F.col("_w")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), chunk))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= k)


def keyword_score(weights: DataFrame, queries: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """The k documents with the largest cosine to each query, from unit term weights (term, weight); queries have query_id."""
    q = queries.select("query_id", "term", F.col("weight").alias("_q"))
    scores = weights.join(q, "term").groupBy("query_id", id_col).agg(F.round(F.sum(F.col("weight") * F.col("_q")), 9).alias("keyword"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("keyword"), id_col))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def keyed_vectors(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, v): each document's terms as (at, weight), by the numbers of all terms in use, which a vocabulary bounds."""
    terms = F.array_sort(F.collect_set("term"))
    known = weights.agg(terms.alias("t")).select(F.posexplode("t").alias("at", "term"))
    return weights.join(F.broadcast(known), "term").groupBy(id_col).agg(F.collect_list(F.struct("at", "weight")).alias("v"))


def keyword_best(held: DataFrame, queries: DataFrame, id_col: str, k: int = 10, places: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k of the ``keyed_vectors`` with the largest product to each query (query_id, v).

    Scores are rounded, ties go to the smaller id; documents that share no term with a query are not found.
    """
    found = best_shared_products(held.select(F.col(id_col).alias("id"), "v"), queries.select(F.col("query_id").alias("q"), "v"), k, places)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("id").alias(id_col), "score", "rank")


def best_scored(chunks: DataFrame, queries: DataFrame, group: str, chunk: str, vector: str, query_vector: str, query_id: str, each: int = 3, places: int = 6, distance: bool = False) -> DataFrame:
    """(group, chunk, query_id, score): for each query and group the ``each`` chunks of largest cosine (or least 1 - cosine) and more, by all products.

    Vectors without a direction, or of another length than a query's, are not found by it.
    """
    rows = chunks.select(F.col(group).alias("g"), F.col(chunk).alias("id"), unit(F.col(vector)).alias("v"))
    found = best_products(rows, queries.select(F.col(query_id).alias("q"), unit(F.col(query_vector)).alias("v")), each, places, distance=distance)
    return found.select(F.col("g").alias(group), F.col("id").alias(chunk), F.col("q").alias("query_id"), "score")


def hybrid_search(semantic: DataFrame, keyword: DataFrame, keys: list[str], alpha: float = 0.7, top: int = 10) -> DataFrame:
    """alpha of the semantic score, counted for the top chunks only, and the rest of the keyword score."""
    by = [k for k in keys if k != keys[-1]]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("semantic"), keys[-1]))
    best = semantic.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")
    both = best.join(keyword, keys, "full_outer").select(*keys, F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    return both.withColumn("score", alpha * F.col("semantic") + (1 - alpha) * F.col("keyword"))


def retrieve_best(scores: DataFrame, group: str, chunk: str, query: str, score: str, each: int = 3, k: int = 5, distance: bool = False) -> DataFrame:
    """The best chunks of each query, once with their best score and its query, then the k best of a group.

    ``distance`` takes small values for good ones.
    """
    good = F.col(score) if distance else -F.col(score)
    top = scores.withColumn("_r", F.row_number().over(Window.partitionBy(group, query).orderBy(good, chunk))).filter(F.col("_r") <= each)
    best = top.groupBy(group, chunk).agg(F.min_by(F.struct(F.col(score).alias("s"), F.col(query).alias("q")), F.struct(good, F.col(query))).alias("_b")).select(group, chunk, F.col("_b.s").alias(score), F.col("_b.q").alias(query))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score) if distance else -F.col(score), chunk))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def context_column(retrieved: DataFrame, group: str, rank: str, text: str, score: str, separator: str = " [SEP] ", limit: int = 600) -> DataFrame:
    """A group's retrieved chunks as one text in rank order, their mean score and number."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.substring(text, 1, limit).alias("t")))), lambda x: x["t"])
    return retrieved.groupBy(group).agg(F.array_join(texts, separator).alias("context"), F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def nearest(chunks: DataFrame, query: list[float], vector: str, id_col: str, n: int, where: Column | None = None) -> DataFrame:
    """The n nearest of all rows, or of those that a condition keeps."""
    rows = chunks if where is None else chunks.filter(where)
    return rows.withColumn("score", cosine(F.col(vector), F.lit([float(x) for x in query]))).orderBy(F.desc("score"), id_col).limit(n)
