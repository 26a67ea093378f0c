"""Jobs over a table of rules: text audit, fingerprints, activation, updates, listings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The texts a rule may not contain.
FORBIDDEN_STATEMENTS = (
    "ALTER", "CALL", "COPY", "CREATE", "DELETE", "DO", "DROP", "GRANT", "INSERT", "MERGE",
    "REVOKE", "TRUNCATE", "UPDATE", "VACUUM",
)
FORBIDDEN_FUNCTIONS = (
    "dblink", "lo_export", "lo_import", "pg_ls_dir", "pg_read_binary_file", "pg_read_file",
    "pg_sleep",
)
STRICT_KEYWORDS = (
    "CROSS JOIN", "LATERAL", "COPY", "EXPORT", "INFORMATION_SCHEMA", "PG_CATALOG", "INTO", "OVER",
)
COMMENT_ARTIFACTS = (
    "ignore previous instructions", "system prompt", "system command", "you are now",
)

# A quoted piece ends at its quote or at the end of the text; a doubled quote is two pieces in a
# row. Whichever of quote and comment starts first hides the other.
QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
COMMENT = r"--[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)"
# One look at the next character rules most places out before the alternatives are tried.
AT_PIECE, AT_QUOTE = r"""(?=['"/-])""", r"""(?=['"])"""


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, f"{AT_PIECE}(?:({QUOTED})|{COMMENT})", "$1")


def comments_of(sql: Column) -> Column:
    pieces = F.regexp_extract_all(sql, F.lit(f"{AT_PIECE}(?:{QUOTED}|{COMMENT})"), F.lit(0))
    is_comment = lambda piece: piece.startswith("--") | piece.startswith("/*")
    return F.array_join(F.filter(pieces, is_comment), " ")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def without_trailing_semicolon(sql: Column) -> Column:
    return _trimmed(F.regexp_replace(_trimmed(strip_comments(sql)), r";\z", ""))


def mask_literals(sql: Column, with_text: str = "  ") -> Column:
    """Blank out quoted pieces (comments are expected to be gone already)."""
    return F.regexp_replace(sql, f"{AT_QUOTE}(?:{QUOTED})", with_text)


# Word edges that count letters and digits of every script, whatever the Java version.
EDGE_LEFT, EDGE_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _starting(words: tuple[str, ...]) -> str:
    """A word edge on the left, asked only where one of *words* can start."""
    return f"(?i)(?=[{''.join(sorted({w[0] for w in words}))}]){EDGE_LEFT}(?:{'|'.join(words)})"


def _first_finding(sql: Column, stripped: Column, masked: Column, upper: Column, strict: bool) -> Column:
    """The code of a text from its forms: without comments, that with quoted pieces blanked, and that in upper case. A
    semicolon at the end and blanks around it change none of the searches in the blanked text."""
    first_word = F.upper(F.regexp_extract(masked, rf"{EDGE_LEFT}[A-Za-z_][A-Za-z0-9_]*{EDGE_RIGHT}", 0))
    any_of = lambda text, words: reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    code = (
        F.when(stripped == "", "INVALID_SQL")
        .when(stripped.contains(";") & mask_literals(stripped, "''").rlike(r";\s*\S"), "INVALID_SQL")
        .when(first_word != "SELECT", "INVALID_SQL")
        .when(masked.rlike(_starting(FORBIDDEN_STATEMENTS) + EDGE_RIGHT), "DISALLOWED_SQL")
        .when(masked.contains("(") & masked.rlike(_starting(FORBIDDEN_FUNCTIONS) + r"\s*\("), "DISALLOWED_SQL_FUNCTION")
    )
    if not strict:
        return code
    remarked = any_of(sql, ("--", "/*")) & any_of(F.lower(comments_of(sql)), COMMENT_ARTIFACTS)
    return (
        code.when(upper.contains("*") & upper.rlike(r"SELECT\s+\*\s+FROM"), "AI_SELECT_STAR_BLOCKED")
        .when(any_of(upper, STRICT_KEYWORDS), "AI_KEYWORD_BLOCKED")
        .when(remarked, "AI_INJECTION_ARTIFACT")
        .when(~upper.contains("VIOLATION_COUNT"), "AI_MISSING_ALIAS")
    )


def audit_code(sql: Column, strict: bool = False) -> Column:
    """The first finding per rule text, or NULL when there is none. For few texts; ``audit_rules`` takes a table's."""
    stripped = _trimmed(strip_comments(sql))
    masked = mask_literals(stripped)
    return _first_finding(sql, stripped, masked, F.upper(masked), strict)


def audit_rules(rules: DataFrame, strict: bool = False, sql: str = "sql_text") -> DataFrame:
    """Add ``audit_code``. Each form of a text is a column of its own first, so it is made once for all searches."""
    forms = rules.withColumn("_stripped", _trimmed(strip_comments(F.col(sql)))).withColumn(
        "_masked", mask_literals(F.col("_stripped")))
    upper = F.col("_masked")
    if strict:
        forms, upper = forms.withColumn("_upper", F.upper("_masked")), F.col("_upper")
    code = _first_finding(F.col(sql), F.col("_stripped"), F.col("_masked"), upper, strict)
    return forms.withColumn("audit_code", code).drop("_stripped", "_masked", "_upper")


def normalized_sql(sql: Column) -> Column:
    """No comments, single blanks, lower case outside quotes."""
    text = _trimmed(F.regexp_replace(without_trailing_semicolon(sql), r"\s+", " "))
    pieces = F.regexp_extract_all(text, F.lit(rf"""{QUOTED}|[^'"]+"""), F.lit(0))
    quoted = lambda piece: piece.startswith("'") | piece.startswith('"')
    return F.array_join(
        F.transform(pieces, lambda piece: F.when(quoted(piece), piece).otherwise(F.lower(piece))), ""
    )


def normalized_number(value: Column) -> Column:
    """1.00 and 1.0 give '1'."""
    text = value.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def fingerprint() -> Column:
    """sha256 over connection, normalised SQL and expectation of the row's rule."""
    payload = F.struct(
        F.col("database_connection_id"),
        F.struct(
            F.col("expected_result_type").alias("type"),
            normalized_number(F.col("expected_result_value")).alias("value"),
        ).alias("expected_result"),
        normalized_sql(F.col("sql_text")).alias("sql"),
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def with_fingerprint(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rule_fingerprint", fingerprint())


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """One row per repeated rule: the first id, how many there are.

    Only (fingerprint, id) is shuffled, and merged per fingerprint before that.
    """
    return (
        rules.select(fingerprint().alias("rule_fingerprint"), "rule_id")
        .groupBy("rule_fingerprint")
        .agg(F.min("rule_id").alias("first_rule_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


# Number ranges and names of the five schedule fields.
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DAYS = "mon|tue|wed|thu|fri|sat|sun"
_FIELDS = (
    r"[0-5]?\d",
    r"(?:[01]?\d|2[0-3])",
    r"(?:0?[1-9]|[12]\d|3[01])",
    rf"(?:0?[1-9]|1[0-2]|{_MONTHS})",
    rf"(?:[0-6]|{_DAYS})",
)


def _schedule_pattern() -> str:
    fields = []
    for unit in _FIELDS:
        item = rf"(?:\*|{unit}(?:-{unit})?)(?:/[1-9]\d*)?"
        fields.append(rf"{item}(?:,{item})*")
    return r"(?i)^\s*" + r"\s+".join(fields) + r"\s*$"


def schedule_status(enabled: Column, cron: Column) -> Column:
    """disabled, missing_schedule, invalid_cron or schedulable. Only the form of the five fields
    is checked; computing run times is a scheduler's job."""
    return (
        F.when(~enabled, "disabled")
        .when(cron.isNull() | (F.trim(cron) == ""), "missing_schedule")
        .when(~cron.rlike(_schedule_pattern()), "invalid_cron")
        .otherwise("schedulable")
    )


def active_rules(rules: DataFrame) -> DataFrame:
    """Schedulable rules, the lowest id of each set of equal rules."""
    live = rules.filter(schedule_status(F.col("is_enabled"), F.col("schedule_cron")) == "schedulable")
    first = live.groupBy(fingerprint().alias("_fp")).agg(F.min("rule_id").alias("rule_id"))
    return live.join(first.select("rule_id"), "rule_id", "left_semi")


def delete_rules(
    rules: DataFrame, results: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Rules without the *doomed* ids, and results whose deleted rule_id has become NULL."""
    ids = doomed.select(F.col("rule_id")).distinct()
    kept = rules.join(ids, "rule_id", "left_anti")
    marked = ids.select(F.col("rule_id").alias("_gone"))
    detached = results.join(marked, results["rule_id"] == marked["_gone"], "left").withColumn(
        "rule_id", F.when(F.col("_gone").isNull(), F.col("rule_id"))
    )
    return kept, detached.drop("_gone")


NULLABLE_PATCH_FIELDS = ("schedule_text", "schedule_cron")
PATCH_FIELDS = ("severity", "notification_channels", "is_enabled")


def update_rules(rules: DataFrame, patches: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Apply partial updates, one patch per rule.

    *patches* has rule_id, the changed columns and, for the schedule columns, ``set_<column>``
    flags: a flagged NULL clears the schedule, while a NULL in the other columns means "keep".
    """
    patch = patches.select(*[F.col(name).alias(f"_p_{name}") for name in patches.columns])
    joined = rules.join(patch, F.col("rule_id") == F.col("_p_rule_id"), "left")
    columns = []
    for name in rules.columns:
        if name in NULLABLE_PATCH_FIELDS and f"set_{name}" in patches.columns:
            value = F.when(F.col(f"_p_set_{name}"), F.col(f"_p_{name}")).otherwise(F.col(name))
        elif name in PATCH_FIELDS and name in patches.columns:
            value = F.coalesce(F.col(f"_p_{name}"), F.col(name))
        elif name == "updated_at":
            now = F.current_timestamp() if as_of is None else as_of
            value = F.when(F.col("_p_rule_id").isNotNull(), now).otherwise(F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    return joined.select(*columns)


def set_enabled(rules: DataFrame, ids: DataFrame, enabled: bool, as_of: Column | None = None):
    """Pause or resume."""
    return update_rules(
        rules, ids.select("rule_id").distinct().withColumn("is_enabled", F.lit(enabled)), as_of
    )


def list_rows(df: DataFrame, order: list[Column], limit: int, **equal) -> DataFrame:
    """A listing: optional equality filters (None = no filter), newest first, top *limit*."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df.orderBy(*order).limit(limit)


def rules_mentioning(rules: DataFrame, table: str, n: int = 3) -> DataFrame:
    """Enabled rules whose text mentions *table*, whatever its case; the *n* lowest ids."""
    hit = F.lower(F.col("sql_text")).contains(table.lower())
    return rules.filter(F.col("is_enabled") & hit).orderBy("rule_id").limit(n)


def set_status(df: DataFrame, updates: DataFrame, as_of: Column | None = None, key: str = "id"):
    """Overwrite the status of the rows named in *updates* (key, status)."""
    change = updates.select(F.col(key).alias("_key"), F.col("status").alias("_status"))
    now = F.current_timestamp() if as_of is None else as_of
    joined = df.join(change, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    if "updated_at" in df.columns:
        joined = joined.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return joined.withColumn(
        "status", F.when(hit, F.col("_status")).otherwise(F.col("status"))
    ).drop("_key", "_status")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark trims each task to one row per group before the
    shuffle, so a hot group costs no more than a cold one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
