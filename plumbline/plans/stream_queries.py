"""Streams over the events file, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import violations as V
from plumbline.operators.rules import RuleSpec
from plumbline.plans.catalog import Lake, number, query, results_from, us, with_control
from plumbline.session import scratch_path
from plumbline.sources.tables import stream_files
from plumbline.streaming import rules as SR
from plumbline.streaming import violations as SV


#: What a micro-batch of the streams below reads at most.
MICRO_BATCH_BYTES = 1 << 30


def event_stream(lake: Lake) -> DataFrame:
    events = lake.table("events")
    stream = stream_files(lake.spark, f"{lake.sf_dir}/event[s].parquet", events.schema, MICRO_BATCH_BYTES)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(lake: Lake, stream: DataFrame, label: str) -> DataFrame:
    """Run *stream* until the input is used up, into a table in the shared folder."""
    path = scratch_path(lake.spark, label)
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return lake.spark.read.schema(stream.schema).parquet(path)


def event_rules() -> list[RuleSpec]:
    return [
        RuleSpec(1, "value floor", "min_value", "value", {"min_value": 1}),
        RuleSpec(2, "few errors", "forbidden_value", "event_type", {"value": "error"},
                 expected_type="max_threshold", expected_value=3),
        RuleSpec(3, "some traffic", "row_count_min", expected_type="min_threshold", expected_value=10),
    ]


_METRICS = (
    (1, "value floor", "count(*) FILTER (WHERE value < 1)", "= 0"),
    (2, "few errors", "count(*) FILTER (WHERE event_type = 'error')", "<= 3"),
    (3, "some traffic", "count(*)", ">= 10"),
)


def _windows_sql(keep: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS BIGINT) AS rule_id, '{name}' AS rule_name, epoch_us(w) AS window_start, CAST({m} AS DOUBLE) AS observed_value, "
        f"CASE WHEN {m} {verdict} THEN 'PASS' ELSE 'FAIL' END AS status "
        f"FROM (SELECT *, date_trunc('hour', ts) AS w FROM events) GROUP BY w {keep}"
        for i, name, m, verdict in _METRICS
    )


# a window is final once the watermark, one hour behind the newest event, has passed its end
@query("stream_rule_windows", _windows_sql(
    "HAVING w + INTERVAL 1 HOUR <= (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 1 HOUR FROM events)"))
def stream_rule_windows(lake: Lake):
    graded = SR.stream_rules(event_stream(lake), event_rules())
    return drain(lake, graded, "windows").select(
        "rule_id", "rule_name", us("window_start"), number("observed_value"), "status"
    )


@query("rule_windows", _windows_sql(""))
def rule_windows(lake: Lake):
    df = lake.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SR.batch_rules(df, event_rules()).select(
        "rule_id", "rule_name", us("window_start"), number("observed_value"), "status"
    )


@query("stream_rule_batches", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS rule_id, '{name}' AS rule_name, CAST({m} AS DOUBLE) AS observed_value, "
    f"CASE WHEN {m} {verdict} THEN 'PASS' ELSE 'FAIL' END AS status FROM events"
    for i, name, m, verdict in _METRICS))
def stream_rule_batches(lake: Lake):
    """Rules per micro-batch; the input is one file and so one batch."""
    path = scratch_path(lake.spark, "micro-batches")
    writer = SR.stream_rules_to_sink(event_stream(lake), event_rules, path, f"{path}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return lake.spark.read.parquet(path).select(
        "rule_id", "rule_name", number("observed_value"), "status"
    )


def failure_stream(lake: Lake) -> DataFrame:
    failed = V.failures(results_from(event_stream(lake)))
    ready = V.with_policy(V.with_severity(failed, lake.rules()), lake.policies())
    return ready.withColumn("fingerprint", V.fingerprint(F.col("rule_id"), F.col("status"))).select(
        "result_id", "rule_id", "status", "severity", "observed_value", "executed_at", "fingerprint",
        "deduplication_window_minutes",
    )


@query("stream_dedup", with_control("fails anchor_ids", """
SELECT f.result_id, f.rule_id, epoch_us(f.executed_at) AS executed_at, a.result_id IS NOT NULL AS is_new
FROM fails f LEFT JOIN anchor_ids a USING (result_id)"""))
def stream_dedup(lake: Lake):
    return drain(lake, SV.stream_dedup(failure_stream(lake)), "dedup").select(
        F.col("row_id").alias("result_id"), "rule_id", F.col("us").alias("executed_at"), "is_new"
    )


def _held_stream_sql() -> str:
    from plumbline.plans.violation_queries import held_sql

    # closed by a later failure of the rule, or by the watermark ten minutes behind the newest one
    return held_sql("""
SELECT rule_id, severity, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, total_occurrences AS occurrences,
       CAST(coalesce(total_violation_count, 0) AS DOUBLE) AS violation_total
FROM (SELECT b.*, max(batch_no) OVER (PARTITION BY rule_id) AS newest, m.m,
             (SELECT max(date_trunc('milliseconds', executed_at)) - INTERVAL 10 MINUTE FROM fails) AS watermark
      FROM held_batches b JOIN (SELECT rule_id, max(m) AS m FROM held_fails GROUP BY rule_id) m USING (rule_id))
WHERE batch_no < newest OR (epoch_us(first_seen) + CAST(m AS BIGINT) * 60000000) // 1000 + 1 <= epoch_us(watermark) // 1000""")


@query("stream_held_batches", _held_stream_sql())
def stream_held_batches(lake: Lake):
    held = drain(lake, SV.stream_batches(failure_stream(lake)), "held")
    return held.withColumn("violation_total", F.round("violation_total", 2))


@query("stream_alert_context", with_control("fails", """
SELECT rule_id, epoch_us(ws) AS window_start, count(*) AS failure_count, CAST(sum(coalesce(observed_value, 0)) AS DOUBLE) AS observed_total
FROM (SELECT *, unnest([CAST(date_trunc('day', executed_at) AS TIMESTAMP), CAST(date_trunc('day', executed_at) AS TIMESTAMP) - INTERVAL 1 DAY]) AS ws FROM fails)
WHERE ws + INTERVAL 2 DAY <= (SELECT max(date_trunc('milliseconds', executed_at)) - INTERVAL 1 HOUR FROM fails)
GROUP BY rule_id, ws"""))
def stream_alert_context(lake: Lake):
    context = SV.stream_alert_context(failure_stream(lake), "2 days", "1 day")
    return drain(lake, context, "context").select(
        "rule_id", us("window_start"), "failure_count", number("observed_total")
    )
