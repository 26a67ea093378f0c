"""Tokens, injection phrases and structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt patterns (matched on lower-cased text).
PROMPT_PATTERNS = (
    r"ignore previous\s*(instructions|prompts?)",
    r"return all tables",
    r"show hidden schemas",
    r"system prompt",
    r"you are now\s*(a|an)?\s*(unrestricted|admin)",
    r"bypass\s*(rules|validation|safety)",
    r"drop\s+(table|database)",
)

# Assistant phrases (matched as substrings of lower-cased text).
ASSISTANT_PHRASES = (
    "ignore previous instructions",
    "system prompt",
    "system command",
    "you are now",
    "developer message",
    "drop table",
    "delete all",
    "always pass",
)

MAX_PROMPT = 2000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def flag_injection(df: DataFrame, text: str, patterns: str = "prompt") -> DataFrame:
    """Add ``matched`` (the first pattern that hits), ``too_long`` and ``is_flagged``."""
    lowered = F.lower(F.col(text))
    matched = F.lit(None).cast("string")
    if patterns == "prompt":
        for pattern in reversed(PROMPT_PATTERNS):
            matched = F.when(lowered.rlike(pattern), F.lit(pattern)).otherwise(matched)
        too_long = F.length(F.col(text)) > MAX_PROMPT
    elif patterns == "assistant":
        for phrase in reversed(ASSISTANT_PHRASES):
            matched = F.when(lowered.contains(phrase), F.lit(phrase)).otherwise(matched)
        too_long = F.lit(False)
    else:
        raise ValueError(f"unknown pattern list: {patterns}")
    return (
        df.withColumn("matched", matched)
        .withColumn("too_long", too_long)
        .withColumn("is_flagged", F.col("matched").isNotNull() | F.col("too_long"))
    )


# The text of a failed answer and the fields an answer must have.
FALLBACK_SUMMARY = "AI enrichment failed to generate a valid structured response."
ANSWER_FIELDS = ("summary", "root_causes", "suggested_fixes", "business_impact", "confidence")
_ANSWER_SCHEMA = (
    "summary string, root_causes array<string>, suggested_fixes array<string>, "
    "business_impact string, confidence string"
)


def validate_answers(df: DataFrame, raw: str) -> DataFrame:
    """Check a JSON answer per row and lower its confidence where it is thin.

    The raw text is parsed as a variant, which knows the kind of every field, and once by schema
    for the values.
    """
    parsed = F.try_parse_json(F.col(raw))
    answer = F.from_json(F.col(raw), _ANSWER_SCHEMA)

    def kind(name):
        return F.schema_of_variant(F.try_variant_get(F.col("_parsed"), f"$.{name}", "variant"))

    def stripped(column):
        return F.regexp_replace(column, r"^\s+|\s+$", "")

    has_all = F.lit(True)
    for name in ANSWER_FIELDS:
        has_all = has_all & kind(name).isNotNull()

    def listed(name):
        return kind(name).startswith("ARRAY")

    summary = F.col("_answer.summary")
    valid = (
        has_all
        & listed("root_causes")
        & listed("suggested_fixes")
        & (kind("summary") == "STRING")
        & (stripped(summary) != "")
    )
    stated = F.lower(stripped(F.col("_answer.confidence")))
    known = F.when(stated.isin("high", "medium", "low"), stated).otherwise("low")
    no_causes = F.size(F.col("_answer.root_causes")) == 0
    lowered = F.when((known == "high") & no_causes, "medium").otherwise(known)
    confidence = F.when(F.length(summary) < 20, "low").otherwise(lowered)
    empty = F.array().cast("array<string>")

    checked = (
        df.withColumn("_parsed", parsed)
        .withColumn("_answer", answer)
        .withColumn("_valid", F.coalesce(valid, F.lit(False)))
    )
    ok = F.col("_valid")
    return checked.select(
        *[F.col(f"`{name}`") for name in df.columns],
        F.when(ok, stripped(summary)).otherwise(FALLBACK_SUMMARY).alias("summary"),
        F.when(ok, F.col("_answer.root_causes")).otherwise(empty).alias("root_causes"),
        F.when(ok, F.col("_answer.suggested_fixes")).otherwise(empty).alias("suggested_fixes"),
        F.when(ok, stripped(F.col("_answer.business_impact"))).otherwise("").alias("business_impact"),
        F.when(ok, confidence).otherwise("low").alias("confidence"),
        (~ok).alias("parsing_failure"),
    )
