"""Redaction of personal data and masking of named fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and tags, in the order they are applied.
PERSONAL_DATA_PATTERNS = (
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[EMAIL REDACTED]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN REDACTED]"),
    ("card", r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[CC REDACTED]"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP REDACTED]"),
)

# The export patterns and tags. The pipe in the last class is part of the pattern.
EXPORT_PATTERNS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
)

# Words that mark a field name as sensitive.
SENSITIVE_WORDS = ("password", "secret", "token", "ssn", "credit_card", "email", "phone")

FIELD_TAG = "[FIELD REDACTED]"
TRUNCATION_TAG = "...[TRUNCATED]"
MAX_TEXT = 80


def redact(text: Column) -> Column:
    for _, pattern, tag in PERSONAL_DATA_PATTERNS:
        text = F.regexp_replace(text, pattern, tag)
    return text


def personal_data_counts(text: Column) -> list[Column]:
    """Hits per kind, each counted on the text left by the kinds before it."""
    counts = []
    for name, pattern, tag in PERSONAL_DATA_PATTERNS:
        counts.append(F.regexp_count(text, F.lit(pattern)).cast("long").alias(f"{name}_hits"))
        text = F.regexp_replace(text, pattern, tag)
    return counts


def export_redact(text: Column) -> Column:
    for pattern, tag in EXPORT_PATTERNS:
        text = F.regexp_replace(text, pattern, tag)
    return text


def is_masked(name: str, mode: str = "denylist", names=SENSITIVE_WORDS) -> bool:
    lowered = name.lower()
    if mode == "allowlist":
        return lowered not in {item.lower() for item in names}
    return any(word in lowered for word in names)


def mask_map(fields: Column, mode: str = "denylist", names=SENSITIVE_WORDS) -> Column:
    """The same masking for the entries of a map column."""
    if mode == "allowlist":
        allowed = [item.lower() for item in names]

        def hidden(key):
            return ~F.lower(key).isin(*allowed) if allowed else F.lit(True)
    else:
        def hidden(key):
            return F.lower(key).rlike("|".join(names))

    return F.transform_values(
        fields, lambda key, value: F.when(hidden(key), F.lit(FIELD_TAG)).otherwise(value)
    )


def mask_fields(df: DataFrame, mode: str = "denylist", names=SENSITIVE_WORDS) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if is_masked(field.name, mode, names):
            value = F.lit(FIELD_TAG)
        elif isinstance(field.dataType, T.MapType) and isinstance(
            field.dataType.valueType, T.StringType
        ):
            value = mask_map(value, mode, names)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def truncate(text: Column, limit: int = MAX_TEXT) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_TAG))
    ).otherwise(text)


def sanitize_rows(
    df: DataFrame,
    mode: str = "denylist",
    names=SENSITIVE_WORDS,
    order: str = "truncate_first",
    redact_patterns: bool = True,
) -> DataFrame:
    """Mask sensitive fields; truncate and redact the remaining text fields.

    ``truncate_first`` can leave a pattern that the cut has split; ``redact_first`` cannot.
    """
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if is_masked(field.name, mode, names):
            value = F.lit(FIELD_TAG)
        elif isinstance(field.dataType, T.StringType):
            steps = [truncate, redact] if order == "truncate_first" else [redact, truncate]
            for step in steps:
                if step is truncate or redact_patterns:
                    value = step(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)
