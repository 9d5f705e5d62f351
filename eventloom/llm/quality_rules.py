"""Quality rules with verdicts on whole hosts, in built-in Spark functions only.

Each document is held against base rules. The failures are summed by host; an
empirical beta prior over all hosts shrinks each host's failure rate, so that
a host with few documents is not condemned on thin evidence; hosts whose shrunk
rate is over the limit lose their other documents too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, looked_up, materialized

BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: F.Column, body) -> F.Column:
    """Evaluate ``value`` once for all uses of it in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: F.Column) -> F.Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    bare = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(grams: F.Column) -> F.Column:
    """How many words lie in three-word windows that occur twice or more; ``grams`` has the windows' hashes in order."""

    def covered(ordered: F.Column) -> F.Column:
        last = F.size(ordered) - 1
        twin = F.filter(ordered, lambda g, j: ((j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == g["h"])) | ((j < last) & (ordered[F.least(j + 1, last)]["h"] == g["h"])))
        starts = F.sort_array(F.transform(twin, lambda g: g["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(ordered, covered))


def gram_hashes(words: F.Column) -> F.Column:
    spans = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(spans, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def fails(text: F.Column, min_words: int, max_repeat_percent: int) -> F.Column:
    """Whether a text fails the base rules, as one expression that holds the words once wherever Spark moves it."""

    def judged(words: F.Column) -> F.Column:
        n = F.size(words)
        return F.when(n < min_words, True).otherwise(100 * _let(gram_hashes(words), repeated_words) > max_repeat_percent * n)

    return _let(words_of(F.coalesce(text, F.lit(""))), judged)


def measured(docs: DataFrame, text_col: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    """Add n_words, the base measures and base_failed to ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    split = docs.withColumns({"_words": words_of(text), "_lines": lines, "_text": text})
    full = split.withColumn("_grams", gram_hashes(F.col("_words"))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", ASCII_SPACE, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_grams")).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return full.withColumn("base_failed", failed).drop("_words", "_lines", "_grams", "_text")


def host_verdicts(judged: DataFrame, max_host_rate: float) -> DataFrame:
    """(host, n, host_rate, host_kept) from rows (host, base_failed).

    The prior's mean is the overall failure rate and its strength follows, by
    the method of moments, from how much more the hosts' rates vary than
    chance would make them; without such a surplus all hosts get the mean.
    """
    hosts = materialized(judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("bad")))
    m = F.sum("bad") / F.sum("n")
    moments = hosts.groupBy().agg(m.alias("mean"), (F.sum(F.col("bad") * F.col("bad") / F.col("n")) / F.sum("n") - m * m).alias("var"), (F.count("*") / F.sum("n")).alias("noise"))
    within = F.col("mean") * (1 - F.col("mean"))
    surplus = F.greatest(F.col("var") - within * F.col("noise"), F.lit(1e-9))
    prior = moments.select(F.struct("mean", F.greatest(within / surplus - 1, F.lit(1.0)).alias("strength"))).scalar()
    rate = (F.col("bad") + F.col("prior.mean") * F.col("prior.strength")) / (F.col("n") + F.col("prior.strength"))
    return hosts.withColumn("prior", prior).select("host", "n", rate.alias("host_rate"), (rate <= max_host_rate).alias("host_kept"))


def quality_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.75) -> DataFrame:
    """Per document its measures, base_failed, its host's shrunk failure rate and kept.

    A null text has no words and fails; null hosts count as the host ''; null
    ids and repeated rows each give a row; an empty table gives no rows; other
    columns are not read. Documents are reduced to their measures before any
    exchange, and hosts to two sums before the shuffle; verdicts come back by a
    broadcast, of all hosts if they are few, else of those with very many
    documents, so a host with a third of all documents costs no more than
    another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    judged = materialized(measured(rows, "text", min_words, max_repeat_percent).drop("text"))
    verdicts = materialized(host_verdicts(judged, max_host_rate))
    return looked_up(judged, verdicts, "host", "n").select(F.col("id").alias(id_col), "n_words", *BASE, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rate")


def passing(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.75) -> DataFrame:
    """The rows of ``docs``, unchanged, that the rules and their hosts' verdicts keep.

    The documents are measured twice rather than stored; their rows meet the
    condemned hosts by a broadcast where these are counted to be few.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    failed = fails(F.col(text_col), min_words, max_repeat_percent)
    bad = host_verdicts(docs.select(host.alias("host"), failed.alias("base_failed")), max_host_rate).filter(~F.col("host_kept"))
    whole = docs.filter(~failed).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host.alias("host"))
    gone = materialized(bad.select("host"))
    return whole.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "host", "left_anti").select("row.*")
