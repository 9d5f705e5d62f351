"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn
first, from the multivariate hypergeometric law that a uniform permutation of
all rows would give; then every block permutes its rows, deals them out by its
row of the matrix, and every shard permutes what it received. All of it is
Spark SQL: a draw walks the probabilities around the mean inside aggregate().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

#: Rows of a block at most, about; blocks grow in number, not in size. Blocks that are drawn together.
BLOCK_ROWS, FAN = 2_000, 64


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric_sql(good: str, bad: str, draws: str, uniform: str) -> str:
    """SQL of one draw: how many of ``draws`` without replacement are good.

    Inverts the distribution function at ``uniform`` by the ratio of
    neighbouring probabilities. The walk spans 12 standard deviations and 12
    steps on both sides of the mean; what lies outside is below 1e-30.
    """
    n = "(h.good + h.bad)"
    mean = f"(h.draws * h.good / greatest({n}, 1))"
    spread = f"(12 * sqrt({mean} * h.bad / greatest({n}, 1) * ({n} - h.draws) / greatest({n} - 1, 1)) + 12)"
    low = f"greatest(0L, h.draws - h.bad, CAST(floor({mean} - {spread}) AS BIGINT))"
    high = f"least(h.good, h.draws, CAST(ceil({mean} + {spread}) AS BIGINT))"
    ratio = "ln(CAST(h.good - k + 1 AS DOUBLE) * (h.draws - k + 1) / k / (h.bad - h.draws + k))"
    log_weight = f"if(k = r.low, 0D, a.w + {ratio})"
    total = f"aggregate(sequence(r.low, r.high), named_struct('w', 0D, 'sum', 0D), (a, k) -> {_let('w', log_weight, "named_struct('w', w, 'sum', a.sum + exp(w))")}, a -> a.sum)"
    step = _let("w", log_weight, "named_struct('w', w, 'sum', a.sum + exp(w), 'x', if(a.sum < t, k, a.x))")  # the last k begun below t
    walk = f"aggregate(sequence(r.low, r.high), named_struct('w', 0D, 'sum', 0D, 'x', r.low), (a, k) -> {step}, a -> a.x)"
    body = _let("r", f"named_struct('low', {low}, 'high', {high})", _let("t", f"{uniform} * {total}", walk))
    return _let("h", f"named_struct('good', {good}, 'bad', {bad}, 'draws', {draws})", body)


def communication_matrix(blocks: DataFrame, n_blocks: int, shards: int, seed: int) -> DataFrame:
    """From (block, n) to (block, bounds): bounds[s] is the last place, counted from 1, of the block's rows for shard s.

    A tree of draws: the rows of FAN ranges of blocks are drawn from the whole,
    those of FAN ranges inside each from what the range got, down to single
    blocks. A task holds FAN rows of counts at a time, whatever the size.
    """
    depth = 1
    while FAN**depth < n_blocks:
        depth += 1
    whole = blocks.agg(F.sum("n").alias("total")).filter("total > 0")
    drawn = whole.select(F.lit(0).cast("long").alias("parent"), F.expr(f"transform(sequence(0, {shards - 1}), s -> total DIV {shards} + if(s < total % {shards}, 1L, 0L))").alias("left"))
    for level in reversed(range(depth)):
        uniform = f"((shiftrightunsigned(xxhash64({seed}L, {level}, b.block, s), 11) + 0.5D) / 9007199254740992D)"
        draw = hypergeometric_sql("m.left[s]", "(d.total - m.left[s])", "d.todo", uniform)
        row = (
            f"aggregate(sequence(0, {shards - 1}), named_struct('todo', b.n, 'total', aggregate(m.left, 0L, (x, y) -> x + y), 'row', CAST(array() AS ARRAY<BIGINT>)), "
            f"(d, s) -> {_let('x', draw, "named_struct('todo', d.todo - x, 'total', d.total - m.left[s], 'row', concat(d.row, array(x)))")}, d -> d.row)"
        )
        into = "named_struct('left', zip_with(m.left, drawn, (x, y) -> x - y), 'rows', concat(m.rows, array(named_struct('block', b.block, 'row', drawn))))"
        start = "named_struct('left', left, 'rows', CAST(array() AS ARRAY<STRUCT<block: BIGINT, row: ARRAY<BIGINT>>>))"
        ranges = blocks.groupBy(F.expr(f"block DIV {FAN**level}").alias("block")).agg(F.sum("n").alias("n"))
        children = ranges.groupBy(F.expr(f"block DIV {FAN}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"))
        each = children.join(drawn, "parent").select(F.explode(F.expr(f"aggregate(blocks, {start}, (m, b) -> {_let('drawn', row, into)}, m -> m.rows)")).alias("r"))
        drawn = materialized(each.select(F.col("r.block").alias("parent"), F.col("r.row").alias("left")))
    return drawn.select(F.col("parent").alias("block"), F.expr(f"transform(sequence(1, {shards}), k -> aggregate(slice(left, 1, k), 0L, (x, y) -> x + y))").alias("bounds"))


def sharded(docs: DataFrame, shards: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into shards 0 to ``shards`` - 1 by a uniform permutation; counts are at most one apart (law ``rows``).

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard (null: this law says
    nothing of more shards). A null text has no bytes; null ids, equal texts and
    repeated rows are dealt like any others (fully equal rows may trade
    places); an empty table gives no rows; other columns are not read.

    The text never leaves its scan: 20 bytes a row are stored and exchanged. A
    block, and a bucket of a shard, hold about 2000 rows at any size of the
    input, also of rows without an id, and the result does not depend on the
    cluster's (but for rows without an id, which go by their place).
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())  # rows without an id are told apart by their place
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), salt.alias("salt"))
    rows = materialized(rows)
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    buckets = -(-blocks // shards)

    def pick(step: int) -> F.Column:
        return F.xxhash64(F.lit(seed + step), "id", "crc", "salt")  # as without a salt, where it is null

    dealt = rows.withColumn("block", F.pmod(pick(1), F.lit(blocks)).cast("long"))
    matrix = communication_matrix(materialized(dealt.groupBy("block").agg(F.count("*").alias("n"))), blocks, shards, seed)
    inside = Window.partitionBy("block").orderBy(pick(2), "id", "size", "crc")
    placed = dealt.withColumn("place", F.row_number().over(inside)).join(matrix, "block")
    sent = placed.select("id", "size", "crc", "salt", F.expr("size(filter(bounds, b -> b < place))").alias("shard"), F.pmod(pick(3), F.lit(buckets)).cast("int").alias("bucket"))
    sent = materialized(sent)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = sent.groupBy("shard", "bucket").count()
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "bucket").orderBy(pick(4), "id", "size", "crc")
    slot = (F.row_number().over(again) - 1).cast("long")
    return (
        sent.withColumn("local", slot)
        .join(starts, ["shard", "bucket"])
        .select(F.col("id").cast(kind).alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
