"""Rule quality from run history and human feedback."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rule_table import first_per_group

DAYS = 30


def _recent(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    return df.filter(F.col(time) > as_of - F.expr(f"INTERVAL {DAYS} DAYS"))


def execution_stats(results: DataFrame, as_of: Column) -> DataFrame:
    """(rule_id, executions, fails) of the trailing 30 days; an ERROR is no fail."""
    return _recent(results, "executed_at", as_of).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("executions"),
        F.count_if(F.col("status") == "FAIL").alias("fails"),
    )


def feedback_stats(feedback: DataFrame, as_of: Column) -> DataFrame:
    """(rule_id, rejects, feedbacks) of the trailing 30 days."""
    return _recent(feedback, "created_at", as_of).groupBy("rule_id").agg(
        F.count_if(F.col("feedback_type") == "reject").alias("rejects"),
        F.count(F.lit(1)).alias("feedbacks"),
    )


def _false_positives(fails: Column, rejects: Column) -> Column:
    return F.least(F.lit(100.0), rejects / F.greatest(F.lit(1), fails) * 100.0)


def score_rules(rules: DataFrame, results: DataFrame, feedback: DataFrame, as_of: Column) -> DataFrame:
    """(rule_id, quality_score, is_noisy, false_positive_rate) for enabled rules.

    *feedback* is linked to batches already (an inner join dropped what has no batch). Two
    aggregates and two joins of one row per rule.
    """
    zero = F.lit(0).cast("long")
    joined = (
        rules.filter("is_enabled")
        .select("rule_id")
        .join(execution_stats(results, as_of), "rule_id", "left")
        .join(feedback_stats(feedback, as_of), "rule_id", "left")
    )
    fails, rejects = F.coalesce("fails", zero), F.coalesce("rejects", zero)
    at_least_one = lambda name: F.greatest(F.coalesce(F.col(name), zero), F.lit(1))
    fail_rate = fails / at_least_one("executions")
    reject_rate = rejects / at_least_one("feedbacks")
    penalty = F.when(fail_rate > 0.5, 10.0).when(fail_rate > 0.1, 5.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty - reject_rate * 30))
    noisy = (score < 70.0) | (reject_rate > 0.4)
    fp = _false_positives(fails, rejects)
    return joined.select(
        "rule_id",
        F.coalesce("executions", zero).alias("executions"),
        fails.alias("fails"),
        rejects.alias("rejects"),
        F.round(score, 2).alias("quality_score"),
        noisy.alias("is_noisy"),
        F.round(fp, 2).alias("false_positive_rate"),
    )


#: Newest feedback rows of a rule that its evidence tells of.
NEWEST = 5


def feedback_evidence(feedback: DataFrame, as_of: Column, first_failures: DataFrame | None = None) -> DataFrame:
    """(rule_id, rejects, rejections, corrections) of the trailing 30 days: rejects of all rows, and of the newest five the rejects
    and the texts of edits, NULL without any.

    With *first_failures* (rule_id, first_failure) rows before their rule's first failure do not count; without, all are linked
    to batches already. Rows of a rule are put in order once, newest first, and counted up to each row. The rows that count come
    before those that do not, so the last one that counts has the rule's figures.
    """
    newest = Window.partitionBy("rule_id").orderBy(F.desc("created_at"), F.desc("id"))
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rejected = F.col("feedback_type") == "reject"
    edited = F.col("feedback_type").isin("edit", "annotate") & (F.col("edited_summary") != "")
    line = F.when(edited, F.concat(F.lit("- "), F.col("edited_summary")))
    of_newest = lambda column: [F.nth_value(column, i).over(so_far) for i in range(1, NEWEST + 1)]
    counted = _recent(feedback, "created_at", as_of).select(
        "rule_id", "created_at",
        F.lead("created_at").over(newest).alias("_older"),
        F.count(F.when(rejected, 1)).over(so_far).alias("rejects"),
        reduce(add, [F.coalesce(n, F.lit(0).cast("long")) for n in of_newest(F.when(rejected, 1).cast("long"))]).alias("rejections"),
        F.nullif(F.concat_ws("\n", *of_newest(line)), F.lit("")).alias("corrections"),
    )
    if first_failures is None:
        last = counted.filter(F.col("_older").isNull())
    else:
        first = F.col("first_failure")
        last = counted.join(first_failures, "rule_id").filter(
            (F.col("created_at") >= first) & (F.col("_older").isNull() | (F.col("_older") < first)))
    return last.select("rule_id", "rejects", "rejections", "corrections")


def improvement_evidence(
    rules: DataFrame, results: DataFrame, feedback: DataFrame, as_of: Column, first_failures: DataFrame | None = None
) -> DataFrame:
    """Per rule: its text, executions and fails, and from its five newest feedback rows the rejects and
    the texts of edits. *rules* have a false_positive_rate, as ``score_rules`` gives it; without that column it is worked out
    here by the same formula, so that results and feedback are read and put in order once. *feedback* is linked to batches
    already, or by *first_failures*, as in ``feedback_evidence``."""
    zero = F.lit(0).cast("long")
    fails = F.coalesce("fails", zero)
    rate = F.col("false_positive_rate") if "false_positive_rate" in rules.columns else F.when(
        F.col("is_enabled"), F.round(_false_positives(fails, F.coalesce("rejects", zero)), 2))
    return (
        rules.join(execution_stats(results, as_of), "rule_id", "left")
        .join(feedback_evidence(feedback, as_of, first_failures), "rule_id", "left")
        .select(
            "rule_id", "rule_name", "sql_text", rate.alias("false_positive_rate"),
            F.coalesce("executions", zero).alias("executions"),
            fails.alias("failures"),
            F.coalesce("rejections", zero).alias("rejections"),
            F.coalesce("corrections", F.lit("None recorded.")).alias("human_corrections"),
        )
    )


def needs_review(evidence: DataFrame) -> DataFrame:
    """Add ``review``: none where the evidence is too thin."""
    thin = (
        (F.col("failures") < 5)
        & (F.col("rejections") == 0)
        & (F.coalesce(F.col("false_positive_rate"), F.lit(0.0)) < 5.0)
    )
    return evidence.withColumn("review", F.when(thin, "none").otherwise("review"))


def apply_human_override(summaries: DataFrame, feedback: DataFrame) -> DataFrame:
    """Replace summaries by the rule's newest accepted, edited or annotated interpretation.

    *feedback* carries rule_id and llm_summary_id.
    """
    usable = F.col("feedback_type").isin("edit", "accept", "annotate") & (
        F.col("edited_summary").isNotNull() | (F.col("feedback_type") == "accept")
    )
    newest = first_per_group(
        feedback.filter(usable), ["rule_id"], [F.desc("created_at"), F.desc("id")]
    )
    original = summaries.select(
        F.col("id").alias("llm_summary_id"), F.col("summary").alias("_original")
    )
    fixes = F.col("edited_fixes") if "edited_fixes" in feedback.columns else F.lit(None).cast("string")
    chosen = newest.join(original, "llm_summary_id").select(
        "rule_id",
        F.coalesce(F.nullif("edited_summary", F.lit("")), "_original").alias("_text"),
        F.coalesce(F.col("user_id"), F.lit("ops_admin")).alias("_user")
        if "user_id" in feedback.columns else F.lit("ops_admin").alias("_user"),
        fixes.alias("_fixes"),
    )
    text = F.concat(
        F.lit("Human-validated interpretation:\n"), F.col("_text"),
        F.lit("\n\nOriginally AI-generated, corrected by: "), F.col("_user"),
        F.lit("\nConfidence: High"),
    )
    joined = summaries.join(chosen, "rule_id", "left")
    columns = [c for c in summaries.columns if c not in ("summary", "confidence", "suggested_fixes")]
    result = [
        *[F.col(c) for c in columns],
        F.when(F.coalesce(F.col("_text"), F.lit("")) != "", text).otherwise(F.col("summary")).alias("summary"),
        F.when(F.col("_user").isNotNull(), "High (Human Validated)")
        .otherwise(F.col("confidence") if "confidence" in summaries.columns else F.lit(None))
        .alias("confidence"),
    ]
    if "suggested_fixes" in summaries.columns:
        parsed = F.from_json(F.nullif("_fixes", F.lit("")), "array<string>")
        result.append(F.coalesce(parsed, F.col("suggested_fixes")).alias("suggested_fixes"))
    return joined.select(*result)


def approve(generations: DataFrame, reviews: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Mark reviewed generations approved and keep the reviewed SQL; generations approved before
    stay as they are. *reviews* has id, reviewed_sql, approved_by and passes the strict audit."""
    review = reviews.select(
        F.col("id").alias("_id"), F.col("reviewed_sql").alias("_sql"), F.col("approved_by").alias("_by")
    )
    joined = generations.join(review, F.col("id") == F.col("_id"), "left")
    now = F.current_timestamp() if as_of is None else as_of
    hit = F.col("_id").isNotNull() & ~F.col("approved")
    new = {
        "approved": F.lit(True),
        "approved_by": F.col("_by"),
        "reviewed_sql": F.col("_sql"),
        "edited_after_generation": ~F.col("generated_sql").eqNullSafe(F.col("_sql")),
        "approval_timestamp": now,
    }
    return joined.select(*[
        (F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c)
        for c in generations.columns
    ])
