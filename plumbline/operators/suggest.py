"""Rule suggestions derived from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import outermost_array
from plumbline.operators.rule_table import fingerprint
from plumbline.operators.rules import RuleSpec, run_rules

# Thresholds of the suggestion rules.
MAX_CATEGORIES = 20
KEY_UNIQUE_PCT = 98
NULL_TOLERANCE_PCT = 5.0
TOLERANCE_MARGIN = 1.1
PROFILE_TOP_VALUES = 10

# The wording of suggested rule names, each after the column's name.
NOT_NULL_NAME = " must not contain nulls"
NULL_TOLERANCE_NAME = " null count within acceptable limit"
UNIQUE_NAME = " must be unique (no duplicates)"
RANGE_NAME = " values within observed range ["
CATEGORY_NAME = " contains only known categories"


def _number(value: Column) -> Column:
    return value.cast("string")


def suggest_rules(profile: DataFrame, compat: bool = False) -> DataFrame:
    """Up to four suggestions per profiled column: null, uniqueness, range, category.

    A category list needs all of a column's values: profile with ``k=20``. With *compat* a
    shorter list is used as it is; otherwise such a column gets no category rule.
    """
    name, table = F.col("column_name"), F.col("table_name")
    select_from = F.concat(F.lit("SELECT COUNT(*) AS violation_count FROM "), table, F.lit(" WHERE "))
    nulls_sql = F.concat(select_from, name, F.lit(" IS NULL"))
    tolerance = F.greatest(
        F.lit(1).cast("long"),
        F.floor(F.col("null_pct") / 100 * F.col("row_count") * TOLERANCE_MARGIN),
    )
    listed = F.col("top_values") if not compat else F.slice("top_values", 1, PROFILE_TOP_VALUES)
    categories = F.array_join(
        F.transform(
            listed,
            lambda row: F.concat(F.lit("'"), F.replace(row["value"], F.lit("'"), F.lit("''")), F.lit("'")),
        ),
        ", ",
    )
    low, high = _number(F.col("min")), _number(F.col("max"))

    def kind(order, label, holds, rule_name, sql, confidence, result="zero_violations", value=None):
        return F.when(holds, F.struct(
            F.lit(order).alias("rule_order"),
            F.lit(label).alias("rule_kind"),
            rule_name.alias("suggested_rule_name"),
            sql.alias("suggested_sql"),
            F.lit(result).alias("expected_result_type"),
            (F.lit(None) if value is None else value).cast("decimal(38,10)").alias("expected_result_value"),
            F.lit(confidence).alias("confidence"),
        ))

    complete = F.lit(True) if compat else F.size("top_values") >= F.col("unique_count")
    kinds = [
        kind(1, "not_null", F.col("null_pct") == 0,
             F.concat(name, F.lit(NOT_NULL_NAME)), nulls_sql, 0.95),
        kind(1, "null_tolerance",
             (F.col("null_pct") > 0) & (F.col("null_pct") <= NULL_TOLERANCE_PCT),
             F.concat(name, F.lit(NULL_TOLERANCE_NAME)), nulls_sql, 0.75,
             "max_threshold", tolerance),
        kind(2, "unique", F.col("unique_pct") >= KEY_UNIQUE_PCT,
             F.concat(name, F.lit(UNIQUE_NAME)),
             F.concat(F.lit("SELECT COUNT(*) - COUNT(DISTINCT "), name,
                      F.lit(") AS violation_count FROM "), table), 0.9),
        kind(3, "range",
             F.col("dtype").isin("integer", "float", "decimal") & (F.col("min") != F.col("max")),
             F.concat(name, F.lit(RANGE_NAME), low, F.lit(", "), high, F.lit("]")),
             F.concat(select_from, name, F.lit(" < "), low, F.lit(" OR "), name, F.lit(" > "), high), 0.7),
        kind(4, "category",
             F.col("dtype").isin("string", "categorical")
             & F.col("unique_count").between(2, MAX_CATEGORIES) & complete,
             F.concat(name, F.lit(CATEGORY_NAME)),
             F.concat(select_from, name, F.lit(" NOT IN ("), categories, F.lit(")")), 0.8),
    ]
    found = F.filter(F.array(*kinds), lambda row: row.isNotNull())
    return profile.select(
        "table_name", "position", "column_name", F.lit("heuristic").alias("suggestion_type"),
        "min", "max", "top_values", F.inline(found),
    )


_ITEM = (
    "array<struct<column_name:string,suggested_rule_name:string,suggested_sql:string,"
    "expected_result_type:string,expected_result_value:string,confidence:string>>"
)


def ingest_suggestions(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Rows from a JSON array of rule objects inside free text; other entries are dropped."""
    raw = F.from_json(outermost_array(F.col(text)), "array<string>")
    items = df.select(*(keep or []), F.explode(raw).alias("_raw")).filter(
        F.trim(F.col("_raw")).startswith("{")
    )
    parsed = items.withColumn("_item", F.from_json(F.concat(F.lit("["), "_raw", F.lit("]")), _ITEM)[0])
    item = lambda name: F.col(f"_item.{name}")
    confidence = item("confidence").try_cast("double")
    return parsed.select(
        *(keep or []),
        F.coalesce(item("column_name"), F.lit("__dataset__")).alias("column_name"),
        F.lit("external").alias("suggestion_type"),
        F.coalesce(item("suggested_rule_name"), F.lit("Unnamed rule")).alias("suggested_rule_name"),
        F.coalesce(item("suggested_sql"), F.lit("")).alias("suggested_sql"),
        F.coalesce(item("expected_result_type"), F.lit("zero_violations")).alias("expected_result_type"),
        item("expected_result_value").try_cast("double").alias("expected_result_value"),
        F.when((confidence == 0) | confidence.isNull(), 0.5).otherwise(confidence).alias("confidence"),
    )


def apply_suggestions(
    suggestions: DataFrame, rules: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new rules, suggestions with ``applied`` moved).

    A chosen suggestion becomes a rule unless it is already applied or an equal rule exists; of
    equal suggestions the lowest id wins. The new rule takes the suggestion's id as its source.
    """
    chosen = suggestions.join(ids.select("suggestion_id").distinct(), "suggestion_id", "left_semi")
    as_rule = chosen.filter(~F.col("applied")).select(
        "suggestion_id",
        "table_name",
        F.col("suggested_rule_name").alias("rule_name"),
        F.col("suggested_sql").alias("sql_text"),
        F.col("expected_result_type"),
        F.col("expected_result_value").cast("decimal(38,10)").alias("expected_result_value"),
        F.lit(None).cast("long").alias("database_connection_id"),
    ).withColumn("rule_fingerprint", fingerprint())
    known = rules.select(fingerprint().alias("rule_fingerprint")).distinct()
    fresh = as_rule.join(known, "rule_fingerprint", "left_anti")
    first = fresh.groupBy("rule_fingerprint").agg(F.min("suggestion_id").alias("suggestion_id"))
    new_rules = fresh.join(first.select("suggestion_id"), "suggestion_id", "left_semi")
    applied = new_rules.select("suggestion_id", F.lit(True).alias("_now"))
    moved = (
        suggestions.join(applied, "suggestion_id", "left")
        .withColumn("applied", F.col("applied") | F.coalesce("_now", F.lit(False)))
        .drop("_now")
    )
    return new_rules, moved


def specs_from(suggestions: DataFrame) -> list[RuleSpec]:
    """Suggestions as rule specifications. Their number is bounded by the table's columns."""
    specs = []
    rows = suggestions.orderBy("position", "rule_order").collect()
    for number, row in enumerate(rows, 1):
        common = dict(
            rule_id=number,
            rule_name=row["suggested_rule_name"],
            column=row["column_name"],
            expected_type=row["expected_result_type"],
            expected_value=row["expected_result_value"],
        )
        match row["rule_kind"]:
            case "not_null" | "null_tolerance":
                specs.append(RuleSpec(rule_type="null_check", **common))
            case "unique":
                specs.append(RuleSpec(rule_type="uniqueness_check", **common))
            case "range":
                limits = {"min_value": row["min"], "max_value": row["max"]}
                specs.append(RuleSpec(rule_type="range_check", params=limits, **common))
            case "category":
                values = [item["value"] for item in row["top_values"]]
                specs.append(RuleSpec(rule_type="category_check", params={"values": values}, **common))
    return specs


def verify_suggestions(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Run the suggested rules on the table they came from."""
    return run_rules(df, specs_from(suggestions))
