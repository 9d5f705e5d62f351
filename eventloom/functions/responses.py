"""Parsing of model answers, as input columns, into typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each task's fields as output name: (field, type, default, default when the call failed).
TASKS = {
    "subtopic": {"sub_topic": ("sub_topic", "string", "routine_filing", "error"), "sub_topic_confidence": ("confidence", "double", 0.5, 0.0)},
    "novelty": {
        "novelty_score": ("novelty_score", "double", 0.5, 0.5),
        "change_tags": ("change_tags", "array<string>", "[]", "[]"),
        "is_material": ("is_material", "boolean", False, False),
        "surprise_level": ("surprise_level", "string", "medium", "error"),
    },
    "salience": {
        "salience_score": ("salience_score", "double", 0.5, 0.5),
        "impact_magnitude": ("impact_magnitude", "string", "moderate", "error"),
        "time_horizon": ("time_horizon", "string", "short_term", "error"),
        "uncertainty_level": ("uncertainty_level", "string", "medium", "high"),
        "business_impact": ("business_impact", "string", "unclear", "error"),
    },
    "tone": {
        "tone_score": ("tone_score", "double", 0.0, 0.0),
        "tone_confidence": ("confidence", "double", 0.5, 0.0),
        "tone_drivers": ("tone_drivers", "array<string>", "[]", "[]"),
        "quantitative_support": ("quantitative_support", "boolean", False, False),
    },
    "risks": {
        "risk_factors": ("risk_factors", "array<string>", "[]", "[]"),
        "positive_catalysts": ("positive_catalysts", "array<string>", "[]", "[]"),
        "net_risk_assessment": ("net_risk_assessment", "string", "balanced", "error"),
        "action_orientation": ("action_orientation", "string", "neutral", "error"),
    },
    "volatility": {
        "volatility_score": ("volatility_score", "double", 0.5, 0.5),
        "surprise_factor": ("surprise_factor", "string", "medium", "error"),
        "outcome_clarity": ("outcome_clarity", "string", "developing", "error"),
        "event_type": ("event_type", "string", "continuous", "error"),
        "expected_reaction": ("expected_reaction", "string", "moderate", "error"),
    },
}
#: Patterns of a pair answer's first line, in order.
PAIR_PATTERNS = [
    r"(?i)Filing ([AB]) resulted in better",
    r"(?i)Filing ([AB]) performed better",
    r"(?i)Filing ([AB]) outperformed",
    r"(?i)([AB]) resulted in better",
    r"(?i)([AB]) performed better",
    r"(?i)Filing ([AB]) .*better",
    r"(?i)Answer:\s*Filing ([AB])",
    r"(?i)Answer:\s*([AB])",
]
#: Stated confidence, in order; None takes the number, 100 a per cent.
CONFIDENCE_PATTERNS = [
    (r"confidence:\s*high", 0.85),
    (r"confidence:\s*medium", 0.6),
    (r"confidence:\s*low", 0.4),
    (r"high confidence", 0.85),
    (r"highly confident", 0.85),
    (r"very confident", 0.8),
    (r"medium confidence", 0.6),
    (r"moderate confidence", 0.6),
    (r"somewhat confident", 0.55),
    (r"low confidence", 0.4),
    (r"confidence:\s*([\d.]+)", None),
    (r"(\d+)%\s*confident", 100),
]
STRONG_WORDS = ["definitely", "clearly", "obviously", "strong", "significant"]
WEAK_WORDS = ["might", "possibly", "perhaps", "may", "could", "uncertain"]


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def unfenced(c: Column) -> Column:
    """JSON without a code fence around it."""
    inner = lambda x: F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(c.contains("```"), _once(inner(c), lambda x: F.when(x != "", x).otherwise(c))).otherwise(c))


def _schema(tasks: list[str]) -> str:
    """All fields of some tasks; lists are kept as their JSON text."""
    kinds = {field: "string" if kind.startswith("array") else kind for t in tasks for field, kind, _, _ in TASKS[t].values()}
    return ", ".join(f"{field} {kind}" for field, kind in kinds.items())


def _columns(parsed: Column, status: Column, task: str) -> dict[str, Column]:
    failed = ~status.eqNullSafe("success")
    out = {name: F.when(failed, F.lit(bad)).otherwise(F.coalesce(parsed[field], F.lit(default))) for name, (field, _, default, bad) in TASKS[task].items()}
    if task == "tone":
        out["tone_score"] = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out["tone_score"]))
    return out


def parse_response(c: Column, status: Column, task: str) -> Column:
    """A task's typed fields as one struct, with defaults for missing fields and broken JSON, and others where the call failed."""
    return _once(F.from_json(unfenced(c), _schema([task])), lambda p: F.struct(*[v.alias(k) for k, v in _columns(p, status, task).items()]))


def assemble_features(responses: DataFrame, key: str, tasks: list[str]) -> DataFrame:
    """One wide row per key from its tasks' answers (key, task, status, response).

    An answer is parsed once, with the fields of all tasks, and its own task's
    are taken from it; of several answers to a task the largest holds.
    """
    task, said = F.col("task"), F.when(F.col("task").isin(tasks), F.col("response"))
    # a step of its own: what the next one names many times is then made once, and its columns are compiled
    parsed = responses.select(key, "task", "status", F.from_json(unfenced(said), _schema(tasks)).alias("_p"))
    by_task = F.struct(*[F.when(task == t, F.struct(*[v.alias(k) for k, v in _columns(F.col("_p"), F.col("status"), t).items()])).alias(t) for t in tasks])
    each = parsed.select(key, by_task.alias("_a"))
    wide = each.groupBy(key).agg(*[F.max(f"_a.{t}").alias(t) for t in tasks])
    return wide.select(key, *[F.col(f"{t}.{name}").alias(name) for t in tasks for name in TASKS[t]])


def parse_direction(c: Column) -> tuple[Column, Column]:
    """UP, DOWN or STAY with its confidence; UP counts only before the first DOWN."""
    up = F.upper(c)
    count = lambda word: F.regexp_count(up, F.lit(word))
    at_up, at_down = F.instr(up, "UP"), F.instr(up, "DOWN")
    is_up = (at_up > 0) & ((at_down == 0) | (at_down > at_up))
    stays = up.contains("STAY") | up.contains("NEUTRAL")
    label = F.when(is_up, "UP").when(at_down > 0, "DOWN").otherwise("STAY")
    sure = lambda a, b: F.when(count(a) > count(b), 0.9).otherwise(0.7)
    return label, F.when(is_up, sure("UP", "DOWN")).when(at_down > 0, sure("DOWN", "UP")).when(stays, 0.8).otherwise(0.5)


def parse_pair(c: Column) -> Column:
    """A or B: by patterns on the first line, else by mentions in three lines, else by the first mention; else UNCLEAR."""
    first = F.split_part(c, F.lit("\n"), F.lit(1))
    hits = [F.nullif(F.upper(F.regexp_extract(first, p, 1)), F.lit("")) for p in PAIR_PATTERNS]
    lines = F.lower(F.array_join(F.slice(F.split(c, "\n"), 1, 3), " "))
    a, b = (F.regexp_count(lines, F.lit(f"filing {x}")) for x in "ab")
    at_a, at_b = (F.instr(F.lower(c), f"filing {x}") for x in "ab")
    later = F.when(a > b, "A").when(b > a, "B").when((at_a > 0) & ((at_b == 0) | (at_a < at_b)), "A").when(at_b > 0, "B").otherwise("UNCLEAR")
    return F.coalesce(*hits, later)


def parse_confidence(c: Column) -> Column:
    low = F.lower(c)
    found = []
    for pattern, value in CONFIDENCE_PATTERNS:
        if value is None or value == 100:
            number = F.regexp_extract(low, pattern, 1).try_cast("double")
            found.append(number / 100 if value else number)
        else:
            found.append(F.when(low.rlike(pattern), value))
    present = lambda words: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
    strong, weak = present(STRONG_WORDS), present(WEAK_WORDS)
    return F.coalesce(*found, F.when(strong > weak, 0.75).when(weak > strong, 0.45).otherwise(0.6))


def raw_label(c: Column) -> Column:
    up = F.upper(c)
    has = lambda *words: F.greatest(*[up.contains(w) for w in words]) if len(words) > 1 else up.contains(words[0])
    return F.when(has("POSITIVE"), "POSITIVE").when(has("NEGATIVE"), "NEGATIVE").when(has("OUTPERFORM", "BEAT"), "POSITIVE").when(has("UNDERPERFORM", "MISS"), "NEGATIVE")


def calibrated_label(c: Column, threshold: float) -> Column:
    """An unsure POSITIVE turns NEGATIVE; so does an unclear answer."""
    raw = raw_label(c)
    return F.when(raw.isNull(), "NEGATIVE").when((raw == "POSITIVE") & (parse_confidence(c) < threshold), "NEGATIVE").otherwise(raw)


def parse_strength(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    strong, negative, positive = (low.contains(w) for w in ("strong", "negative", "positive"))
    pick = lambda *v: F.when(strong & negative, v[0]).when(negative, v[1]).when(positive & ~strong, v[2]).when(strong & positive, v[3]).otherwise(v[4])
    return {
        "direction": pick("DOWN", "DOWN", "UP", "UP", "NEUTRAL"),
        "magnitude": pick("STRONG", "MODERATE", "MODERATE", "STRONG", "NONE"),
        "signal": pick("SELL", "WEAK_SELL", "WEAK_BUY", "BUY", "HOLD"),
        "class_index": pick(0, 1, 2, 3, 2),
    }


def parse_fallback(c: Column) -> dict[str, Column]:
    up = F.upper(c)
    return {
        "prediction": F.when(up.contains("UP"), "UP").when(up.contains("DOWN"), "DOWN").otherwise("STAY"),
        "sentiment": F.when(up.contains("POSITIVE"), "POSITIVE").when(up.contains("NEGATIVE"), "NEGATIVE").otherwise("NEUTRAL"),
    }


def calibration_report(df: DataFrame, raw: str, calibrated: str, actual: str) -> DataFrame:
    """Accuracy before and after calibration, and how many answers it changed."""
    share = lambda c: F.avg(F.coalesce(F.col(c) == F.col(actual), F.lit(False)).cast("double"))
    return df.agg(F.count("*").alias("n"), share(raw).alias("raw_accuracy"), share(calibrated).alias("calibrated_accuracy"), F.count_if(~F.col(raw).eqNullSafe(F.col(calibrated))).alias("changed"))


def accuracy_by_confidence(df: DataFrame, predicted: str, actual: str, confidence: str, levels: list[float], more_than: int = 3) -> DataFrame:
    """Accuracy among the answers at least so sure, where there are enough."""
    each = df.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).filter(F.col(confidence) >= F.col("level"))
    hit = F.coalesce(F.col(predicted) == F.col(actual), F.lit(False)).cast("double")
    return each.groupBy("level").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).filter(F.col("n") > more_than)


def cost_columns(text: Column, tokens: Column, per_million: float = 0.25) -> tuple[Column, Column]:
    """Tokens, or a quarter of the characters where unknown, and their cost."""
    used = F.coalesce(tokens.cast("long"), F.floor(F.length(text) / 4))
    return used, used * per_million / 1e6


def derived_llm_features(risks: Column, level: Column, salience: Column) -> dict[str, Column]:
    """Number of risks in a JSON list, an ordinal surprise level, and salience lowered by risks."""
    n = F.coalesce(F.size(F.from_json(risks, "array<string>")), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    ordinal = F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)
    return {"n_risks": n, "surprise_ordinal": ordinal, "risk_adjusted_salience": salience / (1 + n)}
