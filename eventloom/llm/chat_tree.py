"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

A turn's key chains the keys before it, so equal keys mean equal histories and
the keys of all conversations form a prefix tree. Sorted by their keys,
conversations come in depth-first order; each distinct one adds a chunk with
the turns that the one before it doesn't share. A chunk carries the ids of its
tokens, the position id of its first token and the intervals of the stream that
its tokens attend to besides their own chunk up to themselves; a conversation
is read as the intervals of its last turn. A turn's head, text and end are
encoded each by itself, so that turns and loss begin and end between tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import shared_codec
from .common import materialized, shuffle_width, small_batches, stored

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = "<|"


def escape(text: str) -> str:
    """No control string is left: every ``<|`` gets a backslash inside, every backslash another."""
    return text.replace("\\", "\\\\").replace(CONTROL, "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted string, and where the escaped text in it begins and ends."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def chained_turns(conversations: DataFrame, rank_file: bytes, pattern: str, loss_role: str) -> DataFrame:
    """One row per turn in order: conv_id, k, node (key of the history up to here), ids, n (of them), loss_from, loss_to.

    The rows of a conversation are met one after another in sorted order; only
    the last key is held.
    """
    rows = small_batches(conversations).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(shuffle_width(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "k", "node", "ids", "n", "loss_from", "loss_to"]
    held = conversations.sparkSession.sparkContext.broadcast(rank_file)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k, node = object(), 0, b""
        encode = shared_codec(held.value, pattern).encode
        for part in parts:
            columns: list[list] = [[] for _ in names]
            for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                k, node = (k + 1, node) if conv == last else (0, b"")
                last = conv
                node = hashlib.sha256(node + f"{len(role)}\n{role}{text}".encode()).digest()[:16]
                formatted, a, b = formatted_turn(role, text)
                head, body, end = (np.frombuffer(encode(x), "<u4").astype(np.int32) for x in (formatted[:a], formatted[a:b], formatted[b:]))
                loss = (len(head), len(head) + len(body)) if role == loss_role else (0, 0)
                for column, value in zip(columns, (conv, k, node, np.concatenate([head, body, end]), len(head) + len(body) + len(end), *loss)):
                    column.append(value)
            kinds = [part.schema.field("conv_id").type, pa.int32(), pa.binary(), pa.list_(pa.int32()), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kind = dict(conversations.dtypes)["conv_id"]
    return ordered.mapInArrow(run, f"conv_id {kind}, k int, node binary, ids array<int>, n long, loss_from long, loss_to long")


def chat_tree(conversations: DataFrame, rank_file: bytes, pattern: str, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Format conversations (conv_id, turn, role, text) as one stream without repeated histories.

    Returns chunks (start, position, ids, visible, loss) and members (conv_id,
    spans), all counted in tokens. ``start`` is a chunk's place in the stream,
    ``position`` the position id of its first token (the following count on),
    ``visible`` the earlier intervals [from, to) its tokens attend to, ``loss``
    the intervals of its own tokens under the loss mask, ``spans`` the
    intervals that make up a conversation, in order.

    Turns are ordered by turn, then role, then text; null roles and texts are
    empty; rows with a null conv_id form one conversation; repeated rows are
    turns of their own; no rows give no chunks; other columns are not read;
    texts are whole, however long, each turn in one row.
    Equal conversations collapse before the sort, which splits a tree of any
    size over partitions. A conversation's keys (16 bytes a turn), not its
    texts, are held together.
    """
    width = shuffle_width(conversations)
    turns = stored(chained_turns(conversations, rank_file, pattern, loss_role))
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "node", "n"))).alias("path"))
    paths = materialized(paths.select("conv_id", F.element_at("path", -1)["node"].alias("leaf"), F.transform("path", lambda x: x["node"]).alias("nodes"), F.transform("path", lambda x: x["n"]).alias("sizes")))
    distinct = paths.groupBy("leaf").agg(F.any_value("nodes").alias("nodes"), F.any_value("sizes").alias("sizes"))
    # the stored partition numbers make the order of the stream a fact of the data
    ordered = materialized(distinct.repartitionByRange(width, "nodes").sortWithinPartitions("nodes").withColumn("part", F.spark_partition_id()))

    ends = ordered.groupBy("part").agg(F.max("nodes").alias("end")).withColumn("end_before", F.lag("end").over(Window.orderBy("part"))).select("part", "end_before")
    in_part = Window.partitionBy("part").orderBy("nodes")
    before = ordered.withColumn("previous", F.lag("nodes").over(in_part)).join(F.broadcast(ends), "part")  # ends: a row per partition
    shared = F.size(F.array_intersect("nodes", F.coalesce("previous", "end_before", F.array().cast("array<binary>"))))
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    cut = before.withColumn("shared", shared).select("part", "leaf", "nodes", "sizes", "shared", total(F.slice("sizes", F.lit(1), F.col("shared"))).alias("position"), total("sizes").alias("whole"))
    cut = cut.withColumn("inside", F.sum(F.col("whole") - F.col("position")).over(in_part.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("whole") - F.col("position")))
    lengths = cut.groupBy("part").agg(F.sum(F.col("whole") - F.col("position")).alias("length"))
    offsets = lengths.select("part", F.coalesce(F.sum("length").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    placed = materialized(cut.join(F.broadcast(offsets), "part").select("leaf", "nodes", "sizes", "shared", "position", (F.col("offset") + F.col("inside")).alias("start")))

    each = placed.select("leaf", "start", "shared", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("k", "x")).select("leaf", "start", "shared", "k", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("size"))
    owners = each.filter("k >= shared").select("node", F.col("start").alias("owner"))
    # the turns of one chunk stand together in a path: an interval runs from the chunk's start over all of them
    steps = each.join(owners, "node").groupBy("leaf", "owner").agg(F.sum("size").alias("n"), F.min("k").alias("k"))
    spans = steps.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "owner", "n"))), lambda x: F.struct(x["owner"].alias("from"), (x["owner"] + x["n"]).alias("to"))).alias("spans"))
    spans = materialized(spans)

    content = turns.groupBy("node").agg(F.any_value(F.struct("ids", "n", "loss_from", "loss_to")).alias("turn"))
    texts = each.filter("k >= shared").join(content, "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", "turn"))).alias("turns"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("loss"))
    add = lambda a, x: F.struct((a["at"] + x["turn"]["n"]).alias("at"), F.when(x["turn"]["loss_to"] > 0, F.concat(a["loss"], F.array(F.struct((a["at"] + x["turn"]["loss_from"]).alias("from"), (a["at"] + x["turn"]["loss_to"]).alias("to"))))).otherwise(a["loss"]).alias("loss"))
    chunks = (
        placed.select("leaf", "start", "position")
        .join(spans, "leaf")
        .join(texts, "leaf")
        .select("start", "position", F.flatten(F.transform("turns", lambda x: x["turn"]["ids"])).alias("ids"), F.filter("spans", lambda x: x["from"] != F.col("start")).alias("visible"), F.aggregate("turns", zero, add, lambda a: a["loss"]).alias("loss"))
    )
    return chunks, paths.select("conv_id", "leaf").join(spans, "leaf").select("conv_id", "spans")


def read_back(chunks: DataFrame, members: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Decode and parse every conversation from the stream: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The pieces of a conversation arrive in order and only its own are held.
    """
    spans = members.select("conv_id", F.posexplode("spans").alias("i", "span")).select("conv_id", "i", F.col("span.from").alias("start"), (F.col("span.to") - F.col("span.from")).alias("n"))
    pieces = spans.join(chunks.select("start", "ids", "loss"), "start").select("conv_id", "i", F.slice("ids", F.lit(1), F.col("n").cast("int")).alias("ids"), F.filter("loss", lambda x: x["to"] <= F.col("n")).alias("loss"))
    ordered = pieces.repartition(shuffle_width(pieces), "conv_id").sortWithinPartitions("conv_id", "i")
    held = chunks.sparkSession.sparkContext.broadcast(rank_file)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(texts: list[bytes], losses: list[bytes]) -> tuple:
        formatted = b"".join(texts).decode()
        turns, loss = parsed(formatted), "".join(unescape(x.decode()) for x in losses)
        told = hashlib.sha256()
        for role, text in turns:
            told.update(f"{role}\n{text}\n".encode())
        return len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, texts, losses, done = None, [], [], []
        kind, decode = pa.int64(), shared_codec(held.value, pattern).decode
        for part in parts:
            kind = part.schema.field("conv_id").type
            for c, i, ids, loss in zip(*(part.column(x).to_pylist() for x in ("conv_id", "i", "ids", "loss"))):
                if i == 0 and texts:
                    done.append((conv, *digest(texts, losses)))
                    texts, losses = [], []
                conv = c
                texts.append(decode(ids))
                losses += [decode(ids[x["from"] : x["to"]]) for x in loss]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)
                done = []
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, *digest(texts, losses)), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

    return ordered.mapInArrow(run, f"conv_id {dict(members.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
