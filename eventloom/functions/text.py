"""Text clean-up, section splitting, labels and prompts as column expressions and small jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Descriptions of the event codes.
ITEM_DESCRIPTIONS = {
    "1.01": "Entry into Material Agreement",
    "1.02": "Termination of Material Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety",
    "2.01": "Completion of Acquisition/Disposition",
    "2.02": "Results of Operations",
    "2.03": "Creation of Financial Obligation",
    "2.04": "Triggering Events",
    "2.05": "Exit/Restructuring Costs",
    "2.06": "Material Impairments",
    "3.01": "Delisting Notice",
    "3.02": "Unregistered Securities Sales",
    "3.03": "Material Modifications",
    "4.01": "Accountant Changes",
    "4.02": "Non-Reliance on Financials",
    "5.01": "Control Changes",
    "5.02": "Officer/Director Changes",
    "5.03": "Bylaw Amendments",
    "5.04": "Trading Suspension",
    "5.05": "Code of Ethics Changes",
    "5.06": "Shell Company Status Change",
    "5.07": "Shareholder Matters",
    "5.08": "Shareholder Nominations",
    "6.01": "ABS Information",
    "6.02": "Change of Servicer",
    "6.03": "Change in Credit Enhancement",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Material Events",
    "9.01": "Financial Statements/Exhibits",
}
#: Words whose presence, in lower case, is counted by category.
KEYWORDS = {
    "high_impact": ["bankrupt", "fraud", "investigation", "sec", "lawsuit", "recall", "default", "breach", "violation", "criminal"],
    "earnings": ["earnings", "revenue", "profit", "loss", "guidance", "forecast", "outlook", "miss", "beat", "exceed"],
    "change": ["acquisition", "merger", "restructuring", "ceo", "cfo", "resignation", "appointment", "departure"],
    "uncertainty": ["unexpected", "surprise", "significant", "material", "substantial", "unprecedented", "unusual"],
}


def clean_text(c: Column) -> Column:
    """Without tags and odd punctuation, white space squeezed."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s.,;:!?()$%-]", "")
    return F.trim(c)


def strip_markup(c: Column) -> Column:
    """Without tags and entities, in this order."""
    for pattern in (r"<[^>]+>", r"&nbsp;", r"&[a-z]+;", r"&#\d+;"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def extract_item_text(c: Column, blocks: int = 10, limit: int = 50_000) -> Column:
    """The first item blocks up to the next item or the signature, else the first <TEXT> block."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)(item\s+\d+\.\d+.*?)(?=item\s+\d+\.\d+|signature|\z)"), F.lit(1))
    body = F.regexp_extract(c, r"(?is)<TEXT>(.*?)</TEXT>", 1)
    return F.substring(F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, blocks), " ")).otherwise(body), 1, limit)


def extract_key_items(c: Column, items: list[str], each: int = 2, fallback: int = 5) -> Column:
    """At most ``each`` blocks of each named item, else the first generic blocks."""
    block = lambda number: F.regexp_extract_all(c, F.lit(rf"(?is)(item\s+{number}.*?)(?=item\s+\d+\.\d+|signature|\z)"), F.lit(1))
    named = F.concat(*[F.slice(block(i.replace(".", r"\.")), 1, each) for i in items])
    return F.array_join(F.when(F.size(named) > 0, named).otherwise(F.slice(block(r"\d+\.\d+"), 1, fallback)), " ")


HEADER = r"(?im)^[ \t]*item[ \t]+(\d{1,3}(?:\.\d*)?)[^\n]*"
_MARK = "\u0001"


def split_sections(df: DataFrame, id_col: str, text_col: str, fallback: int = 20_000) -> DataFrame:
    """One row per item header, with the text to the next header or the signature; the header's own line is dropped."""
    marked = F.regexp_replace(F.col(text_col), HEADER, f"{_MARK}$1\n")
    pieces = df.select(id_col, F.posexplode(F.split(marked, _MARK)).alias("position", "_piece")).filter("position > 0")
    number, rest = F.regexp_extract("_piece", r"^([^\n]*)\n", 1), F.regexp_extract("_piece", r"(?s)^[^\n]*\n(.*)", 1)
    signed = F.regexp_extract(rest, r"(?is)^(.*?)(?:\n\s*signatures?\b|\z)", 1)
    return pieces.select(id_col, "position", number.alias("raw_number"), F.substring(signed, 1, fallback).alias("item_text"))


def normalize_item(c: Column) -> Column:
    """2 to 2.01, 2.2 to 2.02, two decimals kept; null unless then of the form dd.dd."""
    whole, part = F.split_part(c, F.lit("."), F.lit(1)), F.split_part(c, F.lit("."), F.lit(2))
    code = F.when(~c.contains("."), F.concat(c, F.lit(".01"))).when(F.length(part) == 1, F.concat(whole, F.lit(".0"), part)).otherwise(F.concat(whole, F.lit("."), F.substring(part, 1, 2)))
    return F.when(code.rlike(r"^\d{1,2}\.\d{2}$"), code)


def keep_substantive(df: DataFrame, keys: list[str], text_col: str, position: str, least: int = 200, letters: int = 50, limit: int = 10_000) -> DataFrame:
    """Sections with enough text and letters; the last of equal keys holds."""
    text = F.trim(F.col(text_col))
    good = df.filter((F.length(text) > least) & (F.length(F.regexp_replace(text, "[^a-zA-Z]", "")) > letters))
    return good.groupBy(*keys).agg(F.max_by(F.substring(text, 1, limit), position).alias(text_col))


def with_mixed_fallback(sections: DataFrame, docs: DataFrame, id_col: str, number_col: str, text_col: str, limit: int = 10_000) -> DataFrame:
    """A row MIXED with the text's beginning for documents without sections."""
    rest = docs.join(sections.select(id_col), id_col, "left_anti").select(id_col, F.lit("MIXED").alias(number_col), F.substring(text_col, 1, limit).alias(text_col))
    return sections.select(id_col, number_col, text_col).unionByName(rest)


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """A small fixed mapping as an expression."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.element_at(pairs, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def describe_item(c: Column) -> Column:
    return lookup(c, ITEM_DESCRIPTIONS, "Unknown")


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def header_field(c: Column, name: str, lines: int = 5) -> Column:
    """The value of a ``Name: value`` line among the first lines."""
    hits = F.filter(F.slice(F.split(c, "\n"), 1, lines), lambda x: x.startswith(f"{name}:"))
    return F.when(F.size(hits) > 0, F.trim(F.substring(hits[0], len(name) + 2, 2**31 - 1)))


def find_accession(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{10}-\d{2}-\d{6})", 1), F.lit(""))


def after_marker(c: Column, marker: str = "Content:") -> Column:
    at = F.instr(c, marker)
    return F.when(at > 0, F.trim(F.substring(c, at + F.lit(len(marker)), F.lit(2**31 - 1)))).otherwise(c)


def prefix_contained(a: Column, b: Column, n: int = 50) -> Column:
    """Whether either text's squeezed beginning is in the other."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    a, b = squeeze(a), squeeze(b)
    return b.contains(F.substring(a, 1, n)) | a.contains(F.substring(b, 1, n))


def keyword_counts(c: Column, keywords: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    """Distinct words of each list that occur, and the number of words."""
    low = F.lower(c)
    counts = {f"{k}_count": sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) for k, words in keywords.items()}
    return counts | {"word_count": F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))}


def final_columns(df: DataFrame, wanted: list[str], renames: dict[str, str]) -> DataFrame:
    """The wanted columns that are there, renamed."""
    return df.select(*[c for c in wanted if c in df.columns]).withColumnsRenamed(renames)


def drop_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows without a value; nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(value))


def removed_count(df: DataFrame, column: str, value: str) -> DataFrame:
    """How many rows ``drop_value`` keeps and removes."""
    gone = F.col(column).eqNullSafe(value)
    return df.agg(F.count("*").alias("n"), F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def with_item(df: DataFrame, items: str, code: str) -> DataFrame:
    return df.filter(F.array_contains(items, code))


def normalize_symbol(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("-"))


def prompt_column(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places, filled from columns; nulls read N/A."""
    text = F.lit(template)
    for name, c in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("N/A")))
    return text


def few_shot_prompt(df: DataFrame, examples: DataFrame, text_col: str, label_col: str, order: str, k: int = 3, preview: int = 300) -> DataFrame:
    """Each row behind the same k labelled examples, which are joined to one string first."""
    shot = F.concat(F.lit("Text: "), F.substring(text_col, 1, preview), F.lit("\nLabel: "), F.col(label_col).cast("string"), F.lit("\n\n"))
    block = examples.orderBy(order).limit(k).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), shot.alias("s")))), lambda x: x["s"]), "").alias("b")).select("b").scalar()
    return df.withColumn("prompt", F.concat(block, F.lit("Text: "), F.substring(text_col, 1, preview), F.lit("\nLabel:")))


def ensure_labels(df: DataFrame, return_col: str, label_col: str = "label", names: dict | None = None) -> DataFrame:
    """Numeric labels become words; without a label column, words follow from the return."""
    if label_col in df.columns:
        return df.withColumn(label_col, lookup(F.col(label_col), names or {0: "DOWN", 1: "UP"}))
    return df.withColumn(label_col, F.when(F.col(return_col) > 0, "UP").otherwise("DOWN"))
