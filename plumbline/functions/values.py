"""JSON-safe values, JSON lists, JSON embedded in text, HTML escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_number(value: Column) -> Column:
    """Text of a decimal: whole numbers without a fraction, others as a float."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(
        value.cast("double").cast("string")
    )


def iso_text(value: Column, kind: T.DataType) -> Column:
    """ISO text; a timestamp shows microseconds only when it has some."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(kind, T.TimestampType):
        return F.concat(text, F.lit("+00:00"))
    return text


def json_safe(df: DataFrame) -> DataFrame:
    """Every decimal and temporal column as its JSON-ready text; others unchanged."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            value = json_number(value)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = iso_text(value, field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def json_list(value: Column, default: list[str]) -> Column:
    """A JSON array of strings, or *default* where the text is NULL, broken or no array."""
    fallback = F.array(*[F.lit(item) for item in default])
    is_array = F.trim(value).startswith("[")
    parsed = F.when(is_array, F.from_json(value, "array<string>"))
    return F.coalesce(parsed, fallback)


def strip_fences(text: Column) -> Column:
    """Remove code-fence markers and the blanks after them."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"```(?:json)?\s*", "")), r"`+$", "")


def outermost_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL where there is none."""
    found = F.regexp_extract(strip_fences(text), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def outermost_array(text: Column) -> Column:
    found = F.regexp_extract(strip_fences(text), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


# The HTML entities, ampersand first.
HTML_ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
)


def html_escape(text: Column) -> Column:
    """Trim, then escape."""
    escaped = F.regexp_replace(text, r"^\s+|\s+$", "")
    for plain, entity in HTML_ENTITIES:
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    return escaped


def html_escape_list(texts: Column) -> Column:
    """Escape each entry and drop the blank ones."""
    return F.filter(F.transform(texts, html_escape), lambda item: item != "")
