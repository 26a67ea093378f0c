"""Reports over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import json_list
from plumbline.operators.rule_table import first_per_group, list_rows, schedule_status
from plumbline.session import settle

NEWEST_RESULT = ("executed_at", "result_id")


def rules_report(rules: DataFrame, connections: DataFrame) -> DataFrame:
    names = connections.select(
        F.col("id").alias("database_connection_id"), F.col("name").alias("database_name")
    )
    return rules.join(names, "database_connection_id", "left").orderBy("rule_id")


def recent_results(results: DataFrame, rule_id: int | None = None, n: int | None = None) -> DataFrame:
    """Newest first: of one rule (20) or of all (50)."""
    n = n or (50 if rule_id is None else 20)
    return list_rows(results, [F.desc(c) for c in NEWEST_RESULT], n, rule_id=rule_id)


def latest_per_rule(results: DataFrame) -> DataFrame:
    """Last status, value and time of every rule. One aggregate: each task sends one row per
    rule, however many results a rule has."""
    newest = F.max_by(
        F.struct("status", "observed_value", "executed_at"), F.struct(*NEWEST_RESULT)
    )
    return results.filter(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(
        newest.alias("_last")
    ).select(
        "rule_id",
        F.col("_last.status").alias("last_status"),
        F.col("_last.observed_value").alias("last_observed_value"),
        F.col("_last.executed_at").alias("last_run_at"),
    )


def jobs_report(rules: DataFrame, results: DataFrame) -> DataFrame:
    status = schedule_status(F.col("is_enabled"), F.col("schedule_cron"))
    return rules.withColumn("scheduler_status", status).join(
        latest_per_rule(results), "rule_id", "left"
    )


def newest_events(
    events: DataFrame, n: int = 50, time: str = "executed_at", row_id: str = "result_id"
) -> DataFrame:
    return events.orderBy(F.desc(time), F.desc(row_id)).limit(n)


def alert_notifications(shown: DataFrame, deliveries: DataFrame) -> DataFrame:
    """All deliveries of the rules shown, one row each: a rule may have any number of them."""
    return deliveries.join(shown.select("rule_id").distinct(), "rule_id", "left_semi")


def alerts_report(
    events: DataFrame, rules: DataFrame, deliveries: DataFrame, n: int = 50,
    time: str = "executed_at", row_id: str = "result_id",
) -> DataFrame:
    """The *n* newest events with their rule, the number of its deliveries and the latest one.

    Deliveries are cut down to the rules shown and merged within each task before they are
    shuffled; ``alert_notifications`` lists them.
    """
    top = settle(newest_events(events, n, time, row_id))
    named = top.join(rules.select("rule_id", "rule_name", "table_name"), "rule_id", "left")
    newest = F.max_by(F.struct("id", "channel", "status", "sent_at"), F.struct("sent_at", "id"))
    per_rule = alert_notifications(top, deliveries).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("notifications"), newest.alias("latest_notification")
    )
    return named.join(per_rule, "rule_id", "left").withColumn(
        "notifications", F.coalesce("notifications", F.lit(0).cast("long"))
    ).orderBy(F.desc(time), F.desc(row_id))


def last_delivery(deliveries: DataFrame) -> DataFrame:
    """Latest delivery per rule and channel."""
    newest = F.max_by(F.struct("id", "status", "sent_at"), F.struct("sent_at", "id"))
    return deliveries.groupBy("rule_id", "channel").agg(newest.alias("_last")).select(
        "rule_id", "channel", "_last.*"
    )


def failed_deliveries(deliveries: DataFrame, n: int = 4) -> DataFrame:
    return list_rows(deliveries, [F.desc("sent_at"), F.desc("id")], n, status="failed")


def dashboard(
    connections: DataFrame, rules: DataFrame, results: DataFrame, deliveries: DataFrame, as_of: Column
) -> DataFrame:
    """One row: counts, the eight latest results and deliveries by status.

    The parts are one-row aggregates, joined on a constant.
    """
    one = F.lit(1).alias("_one")
    bases = connections.agg(F.count(F.lit(1)).alias("database_count")).select("*", one)
    active = rules.agg(F.count_if("is_enabled").alias("active_job_count")).select("*", one)
    today = (
        results.filter(
            F.col("status").isin("FAIL", "ERROR")
            & (F.col("executed_at") >= F.date_trunc("day", as_of))
        )
        .agg(F.count(F.lit(1)).alias("failure_count_today"))
        .select("*", one)
    )
    latest = (
        results.orderBy(*[F.desc(c) for c in NEWEST_RESULT])
        .limit(8)
        .agg(F.sort_array(
            F.collect_list(F.struct(*NEWEST_RESULT, "rule_id", "status", "observed_value")), asc=False
        ).alias("latest_results"))
        .select("*", one)
    )
    by_status = (
        deliveries.groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("notification_counts"))
        .select("*", one)
    )
    result = bases
    for part in (active, today, latest, by_status):
        result = result.join(F.broadcast(part), "_one")
    return result.drop("_one")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def system_metrics(batches: DataFrame, summaries: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals. Suppression compares recorded events with batches and can be negative."""
    one = F.lit(1).alias("_one")
    batch_totals = batches.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(F.col("status") == "open").alias("open_batches"),
        F.count_if(F.col("status") == "dispatched").alias("dispatched_batches"),
        F.count_if(F.col("status") == "failed").alias("failed_batches"),
    ).select("*", one)
    made = summaries.agg(
        F.count(F.lit(1)).alias("_made"),
        F.count_if("parsing_failure").alias("_broken"),
        F.avg("token_usage").alias("_tokens"),
    ).select("*", one)
    recorded = events.agg(F.count(F.lit(1)).alias("total_events")).select("*", one)
    success = _share(F.col("_made") - F.col("_broken"), F.col("_made"))
    return (
        recorded.join(F.broadcast(batch_totals), "_one")
        .join(F.broadcast(made), "_one")
        .select(
            "total_events", "total_batches", "open_batches", "dispatched_batches", "failed_batches",
            F.round(success, 2).alias("enrichment_success_rate"),
            F.when(F.col("_made") > 0, F.round(100 - success, 2)).otherwise(0.0)
            .alias("enrichment_failure_rate"),
            F.round(F.coalesce("_tokens", F.lit(0.0)), 2).alias("avg_token_usage"),
            F.round(
                _share(F.col("total_events") - F.col("total_batches"), F.col("total_events")), 2
            ).alias("duplicate_suppression_rate"),
        )
    )


BATCH_KEY = ["rule_id", "batch_no"]


def latest_summaries(summaries: DataFrame, keys: list[str] = BATCH_KEY) -> DataFrame:
    return first_per_group(summaries, keys, [F.desc("created_at"), F.desc("id")])


def batches_report(
    batches: DataFrame, summaries: DataFrame, status: str | None = None, n: int | None = 50
) -> DataFrame:
    """Batches by last activity with their latest summary nested: NULL without one, and for one that has neither a text nor
    a parsing failure. Columns that *summaries* lack are NULL, lists empty."""
    if status is not None:
        batches = batches.filter(F.col("status") == status)
    if n is not None:
        batches = batches.orderBy(F.desc("last_seen"), "rule_id", "batch_no").limit(n)
    def given(name: str) -> Column:
        return F.col(name) if name in summaries.columns else F.lit(None).cast("string")

    def listed(name: str) -> Column:
        return json_list(given(name), []).cast("array<string>").alias(name)

    enrichment = F.struct(
        F.col("id").alias("summary_id"), F.col("summary").alias("ai_summary"), listed("root_causes"), listed("suggested_fixes"),
        given("effective_confidence").alias("confidence_score"), given("prompt_version").alias("prompt_version"),
        given("provider_name").alias("provider_name"), given("model_name").alias("model_name"), "token_usage", "parsing_failure",
    )
    newest = latest_summaries(summaries).select(
        *BATCH_KEY, F.when((F.coalesce("summary", F.lit("")) != "") | F.col("parsing_failure"), enrichment).alias("ai_enrichment"))
    return batches.join(newest, BATCH_KEY, "left").orderBy(F.desc("last_seen"), "rule_id", "batch_no")


def feedback_history(feedback: DataFrame, summaries: DataFrame) -> DataFrame:
    """Feedback with the summary it is about, oldest first."""
    about = summaries.select(
        F.col("id").alias("llm_summary_id"), F.col("summary").alias("_summary"),
        *[F.col(c).alias(f"_{c}") for c in ("suggested_fixes", "effective_confidence", "prompt_version")
          if c in summaries.columns],
    )
    joined = feedback.join(about, "llm_summary_id")
    optional = []
    if "suggested_fixes" in summaries.columns:
        optional.append(json_list(F.col("_suggested_fixes"), []).cast("array<string>").alias("original_fixes"))
    if "edited_fixes" in feedback.columns:
        optional.append(F.from_json("edited_fixes", "array<string>").alias("edited_fixes_list"))
    for source, out in (("effective_confidence", "confidence_level"), ("prompt_version", "prompt_version")):
        if source in summaries.columns:
            optional.append(F.coalesce(F.col(f"_{source}"), F.lit("unknown")).alias(out))
    return joined.select(
        *[F.col(c) for c in feedback.columns],
        F.coalesce("_summary", F.lit("")).alias("original_summary"),
        *optional,
    ).orderBy(*[c for c in ("created_at", "id") if c in feedback.columns])


def attach_feedback(feedback: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add the id of the batch's latest summary; feedback on a batch without one is refused."""
    newest = latest_summaries(summaries).select(*BATCH_KEY, F.col("id").alias("llm_summary_id"))
    return feedback.join(newest, BATCH_KEY)
