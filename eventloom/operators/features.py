"""Text features as relations: term weights, encodings, scaling, class weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .ranking import global_position

#: A short stop list; callers pass their own where results must match another tool's.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with"]


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of two letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w\w+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def grams(words: Column, most: int) -> Column:
    """All n-grams up to ``most`` words; stop words are gone before, so a gram may span one."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.concat(words, *[runs(n) for n in range(2, most + 1)])


#: Words of a slice of a batch that are counted at a time.
SLICE_WORDS = 500_000


def _worded(df: DataFrame, text_col: str, stop: list[str], *kept: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in kept], tokens(F.col(text_col), stop).alias("_w"))


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Slices of batches with their words and each word's row."""
    for batch in parts:
        words = pc.sum(pc.list_value_length(batch.column("_w"))).as_py() or 0
        step = max(1, batch.num_rows * SLICE_WORDS // max(words, 1))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            held = part.column("_w")
            yield part, np.repeat(np.arange(part.num_rows), pc.list_value_length(held).to_numpy()), held.flatten().dictionary_encode()


def _runs(row: np.ndarray, n: int) -> np.ndarray:
    """Where n words of one row begin."""
    return np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted: of so many different numbers np.unique alone makes a hash table, which takes ten times as long."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


def _terms(df: DataFrame, text_col: str, most: int, stop: list[str], keep: int | None = None) -> DataFrame:
    """(term, tf, df): n-grams with their occurrences and documents in a part of the rows.

    With ``keep``, a task tells the occurrences of so many terms at most, as
    Misra and Gries do: where it, or a slice of it, has more, what the next one
    has is taken from all. Each time more than ``keep`` terms lose as much, so
    that no term loses more than a ``keep``-th of the task's occurrences.
    A row without a term has their number; documents are not counted.
    """
    return _worded(df, text_col, stop).mapInArrow(_term_counter(most, keep), "term string, tf long, df long")


def _term_counter(most: int, keep: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of ``_terms`` runs."""

    def counted(row: np.ndarray, words: pa.DictionaryArray) -> tuple[int, list[pa.RecordBatch]]:
        """How many terms occur, and their counts, cut before any of them is spelled."""
        at, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        code, found, levels = at, [], [None]  # a level: of each n-gram the run of one word less and the last word

        def spelled(n: int, own: np.ndarray) -> pa.Array:
            if n == 1:
                return words.dictionary.take(pa.array(own))
            less, last = levels[n - 1]
            return pc.binary_join_element_wise(spelled(n - 1, less[own]), words.dictionary.take(pa.array(last[own])), " ")

        for n in range(1, most + 1):
            starts = _runs(row, n)
            if n == 1:
                tf = np.bincount(at, minlength=len(words.dictionary))
            else:  # by the run of one word less and the word behind it
                ahead = n < most or keep is None  # whether occurrences are looked at again
                keys, *own, tf = np.unique(code[starts] * size + at[starts + n - 1], return_inverse=ahead, return_counts=True)
                levels.append((keys // size, keys % size))
                if ahead:
                    code = np.full(len(row), -1)
                    code[starts] = own[0]
            docs = starts[:0]
            if keep is None and len(starts):
                docs = _distinct(code[starts] * (int(row[-1]) + 1) + row[starts]) // (int(row[-1]) + 1)
            found.append((tf, np.bincount(docs, minlength=len(tf))))
        tfs = np.concatenate([tf for tf, _ in found])
        less = 0 if keep is None or len(tfs) <= keep else np.partition(tfs, len(tfs) - keep - 1)[len(tfs) - keep - 1]
        out = []
        for n, (tf, docs) in enumerate(found, 1):
            own = np.flatnonzero(tf > less)
            out.append(pa.RecordBatch.from_arrays([spelled(n, own), pa.array(tf[own] - less, pa.int64()), pa.array(docs[own], pa.int64())], ["term", "tf", "df"]))
        return int(tfs.sum()), out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held = 0, None
        for _, row, words in _slices(parts):
            n, found = counted(row, words)
            if keep is None:
                yield from found
                continue
            every += n
            table = pa.Table.from_batches([*found, *(held.to_batches() if held else [])]).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
            held = cut(table.rename_columns(["term", "tf", "df"]))
        if held is not None:
            yield from held.to_batches()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([every]), pa.array([0])], ["term", "tf", "df"])

    def cut(table: pa.Table) -> pa.Table:
        tf = table.column("tf").to_numpy()
        if len(tf) <= keep:
            return table
        less = tf - np.partition(tf, len(tf) - keep - 1)[len(tf) - keep - 1]
        return table.set_column(1, "tf", pa.array(less)).filter(pa.array(less > 0))

    return run


class _Known:
    """Terms by their words: for each number of words the sorted pairs of a run of one less and its last word, and the terms that these are."""

    def __init__(self, terms: list[str]):
        split, number = [tuple(t.split(" ")) for t in terms], {t: i for i, t in enumerate(terms)}
        self.words = sorted({w for t in split for w in t})
        place, self.levels = {(w,): i for i, w in enumerate(self.words)}, []
        at = {w: i for i, w in enumerate(self.words)}
        self.single = np.array([number.get(w, -1) for w in self.words], np.int64)
        for n in range(2, max(map(len, split), default=1) + 1):
            runs = {place[t[: n - 1]] * len(at) + at[t[n - 1]]: t[:n] for t in split if len(t) >= n}
            keys = sorted(runs)
            self.levels.append((np.array(keys, np.int64), np.array([number.get(" ".join(runs[k]), -1) for k in keys], np.int64)))
            place = {runs[k]: i for i, k in enumerate(keys)}

    def found(self, row: np.ndarray, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term's number) of every occurrence."""
        known = pc.fill_null(pc.index_in(words.dictionary, pa.array(self.words, pa.string())), -1).to_numpy().astype(np.int64)
        at = known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        starts = np.flatnonzero(at >= 0)
        node = at[starts]
        rows, terms = [row[starts]], [self.single[node]]
        for n, (keys, number) in enumerate(self.levels, 2):
            goes = starts + n - 1 < len(row)
            starts, node = starts[goes], node[goes]
            goes = (row[starts] == row[starts + n - 1]) & (at[starts + n - 1] >= 0)
            starts, node = starts[goes], node[goes]
            key = node * len(self.words) + at[starts + n - 1]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            goes = keys[node] == key
            starts, node = starts[goes], node[goes]
            rows.append(row[starts])
            terms.append(number[node])
        row, term = np.concatenate(rows), np.concatenate(terms)
        return row[term >= 0], term[term >= 0]


def _counts(df: DataFrame, text_col: str, stop: list[str], terms: list[str]) -> DataFrame:
    """(term, tf, df) of some terms in each task's rows."""
    sent = df.sparkSession.sparkContext.broadcast(terms)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        tf, docs = (np.zeros(len(sent.value), np.int64) for _ in range(2))
        for part, row, words in _slices(parts):
            row, term = known.found(row, words)
            tf += np.bincount(term, minlength=len(tf))
            docs += np.bincount(_distinct(row * len(tf) + term) % max(1, len(tf)), minlength=len(tf))
        some = np.flatnonzero(tf)
        yield pa.RecordBatch.from_arrays([pa.array([sent.value[i] for i in some], pa.string()), pa.array(tf[some]), pa.array(docs[some])], ["term", "tf", "df"])

    return _worded(df, text_col, stop).mapInArrow(run, "term string, tf long, df long")


#: The terms that are not among the first m of the merged tasks have no more than 2 / m of all occurrences: an m-th is cut, an m-th is left.
SKETCH_ERROR = 2.0
#: Terms that a task tells for each of the vocabulary's: a term's share falls about with its rank.
TRACKED = 40


def candidates(terms: DataFrame, tracked: int) -> tuple[DataFrame, float]:
    """The first terms (at most ``tracked``) that tasks' cut counts show, and how often any other may occur at most."""
    told = terms.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.col("term").isNotNull(), F.desc("tf"), "term").limit(tracked + 1).collect()
    n = told[0]["tf"] if told else 0
    return terms.sparkSession.createDataFrame([(r["term"],) for r in told[1:]], "term string"), SKETCH_ERROR / tracked * n


def vocabulary(df: DataFrame, id_col: str, text_col: str, max_features: int = 1000, min_df: int = 1, max_df: float = 1.0, most: int = 2, stop: list[str] = STOP_WORDS, tracked: int | None = None) -> DataFrame:
    """(term, df, total, idf): the ``max_features`` terms of most occurrences among those in at least ``min_df`` and at most a share ``max_df`` of the documents.

    Each task's frequent terms are merged, and what they show is counted
    exactly; if the last term taken has more occurrences than any that was not
    shown, that is the vocabulary. Otherwise all terms are counted. Either way
    the result is exact. Only candidates are shuffled, ``tracked`` rows for each
    task at most (a power of two by default), and sent to the tasks that count.
    """
    n = df.count()
    m = tracked or 1 << max(14, (TRACKED * max_features - 1).bit_length())
    shown, unseen = candidates(_terms(df, text_col, most, stop, m), m)

    def counted(rows: DataFrame) -> list:
        counts = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"))
        return counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("total"), "term").limit(max_features).collect()  # max_features rows

    rows = counted(_counts(df, text_col, stop, [r["term"] for r in shown.collect()]))
    # a term that was not shown is in fewer documents than it occurs
    if unseen >= max(1, min_df) and (len(rows) < max_features or rows[-1]["total"] <= unseen):
        rows = counted(_terms(df, text_col, most, stop))
    known = df.sparkSession.createDataFrame([(r["term"], r["df"], r["total"]) for r in rows], "term string, df long, total long")
    return known.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def term_weights(df: DataFrame, id_col: str, text_col: str, known: DataFrame, most: int = 2, sublinear: bool = True, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(id, term, weight) over a vocabulary (term, idf) that may be another table's: optional sublinear tf, rows of length 1. Ids are distinct.

    A task counts its documents' terms, so that a row for each document and term is shuffled, once, by the document.
    """
    # the vocabulary's max_features rows; terms of more words than asked for are not looked for
    sent = df.sparkSession.sparkContext.broadcast([t for (t,) in known.select("term").collect() if t.count(" ") < most])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, names = _Known(sent.value), pa.array(sent.value, pa.string())
        for part, row, words in _slices(parts):
            row, term = looked.found(row, words)
            pairs, tf = np.unique(row * len(names) + term, return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(pairs // max(1, len(names)))), names.take(pa.array(pairs % max(1, len(names)))), pa.array(tf, pa.int64())], [id_col, "term", "tf"])

    kind = StructType([df.schema[id_col], StructField("term", StringType()), StructField("tf", LongType())])
    each = _worded(df, text_col, stop, id_col).mapInArrow(run, kind).join(F.broadcast(known.select("term", "idf")), "term")
    tf = each.repartition(id_col).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"), F.first("idf").alias("idf"))
    raw = tf.withColumn("w", (1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf"))
    return raw.select(id_col, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))).alias("weight"))


def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int = 1000, min_df: int = 1, max_df: float = 1.0, most: int = 2, sublinear: bool = True, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(id, term, weight): smooth idf, optional sublinear tf, rows of length 1; the top terms by corpus count.

    The vocabulary is known before a document's terms are shuffled, so that only its own are.
    """
    return term_weights(df, id_col, text_col, vocabulary(df, id_col, text_col, max_features, min_df, max_df, most, stop), most, sublinear, stop)


def term_vectors(df: DataFrame, id_col: str, weights: DataFrame, known: DataFrame, name: str = "text_vector") -> DataFrame:
    """``df`` with a sparse vector of its term weights, places by the vocabulary's alphabetical order; a document without any has an empty one."""
    order = {r["term"]: i for i, r in enumerate(known.select("term").orderBy("term").collect())}  # the vocabulary's max_features rows
    size, kind = len(order), StructType([*df.schema.fields, StructField(name, VectorUDT())])
    places = df.sparkSession.createDataFrame(list(order.items()), "term string, _i int")
    held = weights.join(F.broadcast(places), "term").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_i", "weight"))).alias("_w"))
    empty = F.array().cast("array<struct<_i: int, weight: double>>")
    rows = df.join(held, id_col, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.transform(F.coalesce("_w", empty), lambda x: x["_i"]).alias("_at"), F.transform(F.coalesce("_w", empty), lambda x: x["weight"]).alias("_of"))

    columns = df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:  # as Spark ML stores a sparse vector
            n = part.num_rows
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), part.column("_at"), part.column("_of")], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], vector], [*columns, name])

    return rows.mapInArrow(run, kind).withMetadata(name, {"ml_attr": {"num_attrs": size}})  # its length, as Spark ML looks for it


def label_encode(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Alphabetical codes of a training table's values; null is 'unknown', unseen values get 0.

    The distinct values are numbered by ranges and joined, not held in one array.
    """
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
        values = (df if train is None else train).select(value.alias("_v")).distinct()
        numbered = values.repartitionByRange("_v").sortWithinPartitions("_v").select("_v", F.monotonically_increasing_id().alias("_at"))
        codes = global_position(numbered, ["_at"], "_code").select("_v", "_code")
        df = df.withColumn("_v", value).join(codes, "_v", "left").withColumn(f"{c}_code", F.coalesce("_code", F.lit(0)).cast("int")).drop("_v", "_code")
    return df


def numeric_features(df: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Missing numbers are 0, flags 0 or 1, in a fixed order as one array."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers] + [F.coalesce(F.col(c), F.lit(False)).cast("double") for c in flags]
    return df.withColumn("features", F.array(*filled))


def scaled(df: DataFrame, columns: list[str], centre: bool = False) -> DataFrame:
    """Divided by the population standard deviation (1 where that is 0), optionally centred."""
    facts = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"s_{c}") for c in columns])).scalar()
    return df.withColumn("_f", facts).select(*df.columns, *[((F.col(c) - (F.col(f"_f.m_{c}") if centre else F.lit(0.0))) / F.col(f"_f.s_{c}")).alias(f"{c}_scaled") for c in columns])


def standardize(df: DataFrame, column: str) -> DataFrame:
    facts = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))).scalar()
    return df.withColumn("_f", facts).withColumns({f"{column}_z": (F.col(column) - F.col("_f.m")) / F.col("_f.s"), f"{column}_back": F.col("_f.m") + (F.col(column) - F.col("_f.m")) / F.col("_f.s") * F.col("_f.s")}).drop("_f")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    facts = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.select(label, (facts["n"] / (facts["k"] * F.col("_n"))).alias("weight"))
    return df.join(weights, label)
