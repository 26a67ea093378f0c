"""Reports, scoring and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import reports as R
from plumbline.operators import rule_table as RT
from plumbline.operators import scoring as S
from plumbline.operators.drift import drift
from plumbline.operators.violations import failures, first_failures, in_some_batch
from plumbline.plans.catalog import AS_OF, Lake, as_of, number, query, us, with_control
from plumbline.plans.profile_queries import _CUR, _REF, _drift_pair, _drift_sql, union
from plumbline.plans.violation_queries import status_batches_of
from plumbline.session import scratch_path
from plumbline.sources import sinks

_CRON_STATUS = """CASE WHEN NOT is_enabled THEN 'disabled' WHEN schedule_cron IS NULL OR trim(schedule_cron) = '' THEN 'missing_schedule'
  WHEN schedule_cron IN ('every day', '61 * * * *') THEN 'invalid_cron' ELSE 'schedulable' END"""


@query("rules_report", with_control("rules", """
SELECT r.rule_id, r.rule_name, r.database_connection_id, n.n_name AS database_name, r.severity
FROM rules r LEFT JOIN nation n ON n.n_nationkey = r.database_connection_id"""))
def rules_report(lake: Lake):
    return R.rules_report(lake.rules(), lake.connections()).select(
        "rule_id", "rule_name", "database_connection_id", "database_name", "severity"
    )


@query("recent_results", with_control("test_results", """
SELECT result_id, rule_id, status, CAST(observed_value AS DOUBLE) AS observed_value, epoch_us(executed_at) AS executed_at
FROM test_results ORDER BY executed_at DESC, result_id DESC LIMIT 50"""))
def recent_results(lake: Lake):
    return R.recent_results(lake.results()).select(
        "result_id", "rule_id", "status", number("observed_value"), us("executed_at")
    )


@query("recent_rule_results", with_control("test_results", """
SELECT result_id, status, CAST(observed_value AS DOUBLE) AS observed_value
FROM test_results WHERE rule_id = 3 ORDER BY executed_at DESC, result_id DESC LIMIT 20"""))
def recent_rule_results(lake: Lake):
    return R.recent_results(lake.results(), rule_id=3).select(
        "result_id", "status", number("observed_value")
    )


@query("jobs_report", with_control("rules test_results", f"""
SELECT r.rule_id, r.rule_name, {_CRON_STATUS} AS scheduler_status, l.status AS last_status,
       CAST(l.observed_value AS DOUBLE) AS last_observed_value, epoch_us(l.executed_at) AS last_run_at
FROM rules r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY executed_at DESC, result_id DESC) AS n
                        FROM test_results) l ON l.rule_id = r.rule_id AND l.n = 1"""))
def jobs_report(lake: Lake):
    return R.jobs_report(lake.rules(), lake.results()).select(
        "rule_id", "rule_name", "scheduler_status", "last_status", number("last_observed_value"),
        us("last_run_at"),
    )


@query("alerts_report", with_control("vevents rules deliveries", """
SELECT v.result_id, v.rule_id, r.rule_name, r.table_name, v.severity, CAST(v.observed_value AS DOUBLE) AS violation_count,
       count(d.id) AS notifications, arg_max(d.id, (d.sent_at, d.id)) AS latest_notification,
       arg_max(d.status, (d.sent_at, d.id)) AS latest_status, v.place
FROM (SELECT *, CAST(row_number() OVER (ORDER BY executed_at DESC, result_id DESC) AS BIGINT) AS place FROM vevents WHERE is_new QUALIFY place <= 50) v
LEFT JOIN rules r USING (rule_id) LEFT JOIN deliveries d ON d.rule_id = v.rule_id
GROUP BY ALL"""))
def alerts_report(lake: Lake):
    from plumbline.operators.violations import dedup

    recorded = dedup(lake.failures()).filter("is_new")
    alerts = R.alerts_report(recorded, lake.rules(), lake.deliveries())
    latest = F.col("latest_notification")
    rows = alerts.collect()  # 50 rows: their places are those of the list as it comes
    listed = lake.spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], alerts.schema.add("place", "long"))
    return listed.select(
        "place", "result_id", "rule_id", "rule_name", "table_name", "severity",
        number("observed_value", "violation_count"), "notifications",
        latest["id"].alias("latest_notification"), latest["status"].alias("latest_status"),
    )


@query("alert_notifications", with_control("vevents deliveries", """
SELECT id, rule_id, channel, status FROM deliveries WHERE rule_id IN (
  SELECT rule_id FROM (SELECT * FROM vevents WHERE is_new ORDER BY executed_at DESC, result_id DESC LIMIT 50))"""))
def alert_notifications(lake: Lake):
    from plumbline.operators.violations import dedup

    shown = R.newest_events(dedup(lake.failures()).filter("is_new"))
    return R.alert_notifications(shown, lake.deliveries()).select("id", "rule_id", "channel", "status")


@query("last_delivery", with_control("deliveries", """
SELECT rule_id, channel, arg_max(id, (sent_at, id)) AS id, arg_max(status, (sent_at, id)) AS status,
       epoch_us(max(sent_at)) AS sent_at
FROM deliveries GROUP BY rule_id, channel"""))
def last_delivery(lake: Lake):
    return R.last_delivery(lake.deliveries()).select("rule_id", "channel", "id", "status", us("sent_at"))


@query("failed_deliveries", with_control("deliveries", """
SELECT id, rule_id, channel FROM deliveries WHERE status = 'failed' ORDER BY sent_at DESC, id DESC LIMIT 4"""))
def failed_deliveries(lake: Lake):
    return R.failed_deliveries(lake.deliveries()).select("id", "rule_id", "channel")


@query("delivery_log", with_control("deliveries", """
SELECT id, rule_id, channel, status, epoch_us(sent_at) AS sent_at FROM deliveries ORDER BY sent_at DESC, id DESC LIMIT 50"""))
def delivery_log(lake: Lake):
    return RT.list_rows(lake.deliveries(), [F.desc("sent_at"), F.desc("id")], 50).select(
        "id", "rule_id", "channel", "status", us("sent_at")
    )


_DASH_DAY = "2024-01-29 18:00:00"


@query("dashboard", with_control("test_results rules deliveries", f"""
SELECT (SELECT count(*) FROM nation) AS database_count, (SELECT count(*) FROM rules WHERE is_enabled) AS active_job_count,
  (SELECT count(*) FROM test_results WHERE status IN ('FAIL', 'ERROR') AND executed_at >= date_trunc('day', TIMESTAMP '{_DASH_DAY}')) AS failure_count_today,
  (SELECT string_agg(CAST(result_id AS VARCHAR), ',' ORDER BY executed_at DESC, result_id DESC)
   FROM (SELECT * FROM test_results ORDER BY executed_at DESC, result_id DESC LIMIT 8)) AS latest_results,
  (SELECT count(*) FROM deliveries WHERE status = 'sent') AS sent, (SELECT count(*) FROM deliveries WHERE status = 'failed') AS failed,
  (SELECT count(*) FROM deliveries WHERE status = 'skipped') AS skipped"""))
def dashboard(lake: Lake):
    board = R.dashboard(
        lake.connections(), lake.rules(), lake.results(), lake.deliveries(),
        F.lit(_DASH_DAY).cast("timestamp"),
    )
    ids = F.array_join(F.transform("latest_results", lambda r: r["result_id"].cast("string")), ",")
    return board.select(
        "database_count", "active_job_count", "failure_count_today", ids.alias("latest_results"),
        *[F.coalesce(F.col("notification_counts")[s], F.lit(0)).cast("long").alias(s)
          for s in ("sent", "failed", "skipped")],
    )


@query("system_metrics", with_control("vevents status_batches summaries", """
SELECT e.total_events, b.total_batches, b.open_batches, b.dispatched_batches, b.failed_batches,
  round((s.made - s.broken) * 100.0 / s.made, 2)::DOUBLE AS enrichment_success_rate,
  round(100 - (s.made - s.broken) * 100.0 / s.made, 2)::DOUBLE AS enrichment_failure_rate, round(s.tokens, 2) AS avg_token_usage,
  round((e.total_events - b.total_batches) * 100.0 / e.total_events, 2)::DOUBLE AS duplicate_suppression_rate
FROM (SELECT count(*) AS total_events FROM vevents WHERE is_new) e,
  (SELECT count(*) AS total_batches, count(*) FILTER (WHERE status = 'open') AS open_batches,
          count(*) FILTER (WHERE status = 'dispatched') AS dispatched_batches, count(*) FILTER (WHERE status = 'failed') AS failed_batches FROM status_batches) b,
  (SELECT count(*) AS made, count(*) FILTER (WHERE parsing_failure) AS broken, avg(token_usage) AS tokens FROM summaries) s"""))
def system_metrics(lake: Lake):
    numbered = lake.numbered(
        lake.recorded(), deliveries=(lake.deliveries(), "sent_at"), summaries=(lake.raw_summaries(), "created_at"))
    return R.system_metrics(status_batches_of(lake, numbered), numbered["summaries"], numbered["events"].filter("is_new"))


@query("batches_report", with_control("status_batches full_summaries", """
SELECT b.rule_id, CAST(b.batch_no AS BIGINT) AS batch_no, b.severity, epoch_us(b.last_seen) AS last_seen, b.total_occurrences, b.status,
       s.id AS summary_id, s.summary AS ai_summary, s.root_causes, s.suggested_fixes, s.effective_confidence AS confidence_score,
       s.prompt_version, s.provider_name, s.model_name, s.token_usage, s.parsing_failure
FROM (SELECT * FROM status_batches WHERE status = 'dispatched' ORDER BY last_seen DESC, rule_id, batch_no LIMIT 50) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rule_id, batch_no ORDER BY created_at DESC, id DESC) AS n FROM full_summaries) s
  ON s.rule_id = b.rule_id AND s.batch_no = b.batch_no AND s.n = 1 AND (s.summary <> '' OR s.parsing_failure)"""))
def batches_report(lake: Lake):
    numbered = lake.numbered(
        lake.recorded(), deliveries=(lake.deliveries(), "sent_at"), summaries=(lake.full_summaries(), "created_at"))
    report = R.batches_report(status_batches_of(lake, numbered), numbered["summaries"], status="dispatched")
    told = F.col("ai_enrichment")
    return report.select(
        "rule_id", "batch_no", "severity", us("last_seen"), "total_occurrences", "status",
        *[told[c].alias(c) for c in ("summary_id", "ai_summary", "confidence_score", "prompt_version", "provider_name", "model_name",
                                     "token_usage", "parsing_failure")],
        *[F.array_join(told[c], "|").alias(c) for c in ("root_causes", "suggested_fixes")],
    )


_LATEST = """latest AS (SELECT *, row_number() OVER (PARTITION BY rule_id, batch_no ORDER BY created_at DESC, id DESC) AS n FROM summaries),
linked AS (SELECT f.*, l.id AS llm_summary_id, l.summary AS original_summary FROM feedback f
           JOIN latest l ON l.rule_id = f.rule_id AND l.batch_no = f.batch_no AND l.n = 1)"""


def linked_sql(body: str, extra: str = "") -> str:
    return with_control(f"feedback summaries {extra}".strip(), "").rstrip() + ", " + _LATEST + body


def linked_feedback(lake: Lake, events):
    numbered = lake.numbered(events, summaries=(lake.raw_summaries(), "created_at"), feedback=(lake.raw_feedback(), "created_at"))
    return R.attach_feedback(numbered["feedback"], numbered["summaries"]), numbered["summaries"]


@query("attached_feedback", linked_sql("""
SELECT id, rule_id, CAST(batch_no AS BIGINT) AS batch_no, llm_summary_id FROM linked"""))
def attached_feedback(lake: Lake):
    linked, _ = linked_feedback(lake, lake.recorded())
    return linked.select("id", "rule_id", "batch_no", "llm_summary_id")


@query("feedback_history", linked_sql("""
SELECT id, rule_id, CAST(batch_no AS BIGINT) AS batch_no, feedback_type, edited_summary, original_summary FROM linked"""))
def feedback_history(lake: Lake):
    linked, summaries = linked_feedback(lake, lake.recorded())
    return R.feedback_history(linked, summaries).select(
        "id", "rule_id", "batch_no", "feedback_type", "edited_summary", "original_summary"
    )


@query("score_rules", with_control("rules test_results feedback", f"""
SELECT rule_id, executions, fails, rejects, round(score, 2) AS quality_score, score < 70 OR reject_rate > 0.4 AS is_noisy,
       round(least(100.0, rejects / greatest(1, fails)::DOUBLE * 100), 2) AS false_positive_rate
FROM (SELECT *, greatest(0.0, least(100.0, 100.0::DOUBLE - CASE WHEN fails / greatest(1, executions)::DOUBLE > 0.5 THEN 10
                  WHEN fails / greatest(1, executions)::DOUBLE > 0.1 THEN 5 ELSE 0 END - reject_rate * 30)) AS score
  FROM (SELECT r.rule_id, coalesce(x.executions, 0) AS executions, coalesce(x.fails, 0) AS fails, coalesce(f.rejects, 0) AS rejects,
               coalesce(f.rejects, 0) / greatest(1, coalesce(f.n, 0))::DOUBLE AS reject_rate
        FROM rules r
        LEFT JOIN (SELECT rule_id, count(*) AS executions, count(*) FILTER (WHERE status = 'FAIL') AS fails FROM test_results
                   WHERE executed_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY rule_id) x USING (rule_id)
        LEFT JOIN (SELECT rule_id, count(*) FILTER (WHERE feedback_type = 'reject') AS rejects, count(*) AS n FROM feedback
                   WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY rule_id) f USING (rule_id)
        WHERE r.is_enabled))"""))
def score_rules(lake: Lake):
    return S.score_rules(lake.rules(), lake.results(), _feedback_in_batches(lake), as_of())


def _feedback_in_batches(lake: Lake):
    return in_some_batch(failures(lake.results()), lake.raw_feedback(), "created_at")


def _evidence_sql(columns: str) -> str:
    return with_control("rules test_results feedback", f"""
SELECT rule_id, {columns} FROM (
SELECT r.rule_id, r.sql_text, CASE WHEN r.is_enabled THEN round(least(100.0, coalesce(f.all_rejects, 0) / greatest(1, coalesce(x.fails, 0))::DOUBLE * 100), 2) END AS false_positive_rate,
       coalesce(x.executions, 0) AS executions, coalesce(x.fails, 0) AS failures, coalesce(f.rejects, 0) AS rejections,
       coalesce(f.texts, 'None recorded.') AS human_corrections
FROM rules r
LEFT JOIN (SELECT rule_id, count(*) AS executions, count(*) FILTER (WHERE status = 'FAIL') AS fails FROM test_results
           WHERE executed_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY rule_id) x USING (rule_id)
LEFT JOIN (SELECT rule_id, count(*) FILTER (WHERE feedback_type = 'reject' AND n <= 5) AS rejects, count(*) FILTER (WHERE feedback_type = 'reject') AS all_rejects,
                  string_agg('- ' || edited_summary, chr(10) ORDER BY n) FILTER (WHERE n <= 5 AND feedback_type IN ('edit', 'annotate') AND edited_summary <> '') AS texts
           FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY created_at DESC, id DESC) AS n FROM feedback
                 WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) GROUP BY rule_id) f USING (rule_id))""")


def _evidence(lake: Lake):
    opened = first_failures(failures(lake.results()))
    return S.improvement_evidence(lake.rules(), lake.results(), lake.raw_feedback(), as_of(), opened)


@query("improvement_evidence", _evidence_sql("md5(sql_text) AS sql_md5, false_positive_rate, executions, failures, rejections, human_corrections"))
def improvement_evidence(lake: Lake):
    return _evidence(lake).withColumn("sql_md5", F.md5("sql_text")).drop("rule_name", "sql_text")


@query("needs_review", _evidence_sql("CASE WHEN failures < 5 AND rejections = 0 AND coalesce(false_positive_rate, 0) < 5 THEN 'none' ELSE 'review' END AS review"))
def needs_review(lake: Lake):
    return S.needs_review(_evidence(lake)).select("rule_id", "review")


@query("human_override", linked_sql("""
SELECT s.id, s.rule_id, CASE WHEN o.text IS NULL THEN s.summary ELSE 'Human-validated interpretation:' || chr(10) || o.text || chr(10) || chr(10) ||
         'Originally AI-generated, corrected by: ops_admin' || chr(10) || 'Confidence: High' END AS summary,
       coalesce(CASE WHEN o.text IS NOT NULL THEN 'High (Human Validated)' END, '') AS confidence
FROM summaries s LEFT JOIN (
  SELECT rule_id, coalesce(edited_summary, original_summary) AS text,
         row_number() OVER (PARTITION BY rule_id ORDER BY created_at DESC, id DESC) AS n
  FROM linked WHERE feedback_type = 'accept' OR (feedback_type IN ('edit', 'annotate') AND edited_summary IS NOT NULL)) o
  ON o.rule_id = s.rule_id AND o.n = 1"""))
def human_override(lake: Lake):
    linked, summaries = linked_feedback(lake, lake.recorded())
    return S.apply_human_override(summaries, linked).select(
        "id", "rule_id", "summary", F.coalesce("confidence", F.lit("")).alias("confidence")
    )


@query("reviewed_suggestions", """
SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal > 5000 THEN 'accepted' ELSE 'pending' END AS status FROM customer""")
def reviewed_suggestions(lake: Lake):
    customer = lake.table("customer")
    pending = customer.select(F.col("c_custkey").alias("id"), F.lit("pending").alias("status"))
    updates = customer.filter("c_acctbal < 0 OR c_acctbal > 5000").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, "rejected").otherwise("accepted").alias("status"),
    )
    return RT.set_status(pending, updates)


def generations(lake: Lake):
    """Customers' rule texts as generated rules; every sixth one is approved already."""
    key = F.col("rule_id")
    return lake.rules().select(
        key.alias("id"),
        F.concat(F.lit("check "), "rule_name", F.lit(" write to a.b@mail.example.com or 123-45-6789")).alias("prompt"),
        F.col("sql_text").alias("generated_sql"),
        F.when(key % 6 == 0, F.col("sql_text")).alias("reviewed_sql"),
        F.lit(False).alias("edited_after_generation"),
        (key % 6 == 0).alias("approved"),
        F.when(key % 6 == 0, "system").alias("approved_by"),
        F.lit(None).cast("timestamp").alias("approval_timestamp"),
        F.col("severity").alias("confidence"), F.lit("m").alias("model_name"),
        F.lit("v1").alias("prompt_version"), F.lit(False).alias("parsing_failure"),
        F.timestamp_seconds(key).alias("created_at"),
    )


@query("approved_generations", with_control("rules", """
SELECT rule_id AS id, rule_id % 6 = 0 OR is_enabled AS approved,
       CASE WHEN rule_id % 6 = 0 THEN 'system' WHEN is_enabled THEN rule_name END AS approved_by,
       CASE WHEN rule_id % 6 = 0 THEN sql_text WHEN is_enabled THEN lower(sql_text) END AS reviewed_sql,
       rule_id % 6 <> 0 AND is_enabled AND lower(sql_text) <> sql_text AS edited_after_generation
FROM rules"""))
def approved_generations(lake: Lake):
    reviews = lake.rules().filter("is_enabled").select(
        F.col("rule_id").alias("id"), F.lower("sql_text").alias("reviewed_sql"),
        F.col("rule_name").alias("approved_by"),
    )
    return S.approve(generations(lake), reviews, as_of()).select(
        "id", "approved", "approved_by", "reviewed_sql", "edited_after_generation"
    )


@query("export_lines", with_control("rules", r"""
SELECT rule_id AS id, CAST(to_json({'id': 'gen_' || rule_id, 'prompt': 'check ' || rule_name || ' write to [EMAIL_REDACTED] or [SSN_REDACTED]',
  'generated_sql': sql_text, 'reviewed_sql': sql_text, 'edited_after_generation': false,
  'metadata': {'confidence': severity, 'model_name': 'm', 'prompt_version': 'v1', 'parsing_failure': false}}) AS VARCHAR) AS value
FROM rules WHERE rule_id % 6 = 0"""))
def export_lines(lake: Lake):
    from plumbline.sources.sinks import export_lines as lines

    return lines(generations(lake)).select("id", "value")


@query("exported_file", with_control("rules", r"""
SELECT row_number() OVER (ORDER BY rule_id) AS line, CAST(to_json({'id': 'gen_' || rule_id, 'prompt': 'check ' || rule_name || ' write to [EMAIL_REDACTED] or [SSN_REDACTED]',
  'generated_sql': sql_text, 'reviewed_sql': sql_text, 'edited_after_generation': false,
  'metadata': {'confidence': severity, 'model_name': 'm', 'prompt_version': 'v1', 'parsing_failure': false}}) AS VARCHAR) AS value
FROM rules WHERE rule_id % 6 = 0"""))
def exported_file(lake: Lake):
    """The lines as they stand in the written files, taken in order of name."""
    path = scratch_path(lake.spark, "export")
    sinks.export_jsonl(generations(lake), path)
    lines = lake.spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.select(F.row_number().over(Window.orderBy("file", "at")).cast("long").alias("line"), "value")


@query("violations_csv", with_control("fails", """
SELECT CAST(result_id AS VARCHAR) AS result_id, status, CAST(observed_value AS DOUBLE) AS observed_value, '[{"k":"' || (props->>'$.k') || '"}]' AS sample_rows, NULL::VARCHAR AS c_name FROM fails
UNION ALL SELECT NULL, NULL, NULL, NULL, c_name FROM customer WHERE c_acctbal < 0"""))
def violations_csv(lake: Lake):
    """Rows of two shapes in one CSV, read back under its header."""
    path = scratch_path(lake.spark, "csv")
    failed = lake.failures().select("result_id", "status", "observed_value", "sample_rows")
    sinks.write_violations_csv([failed, lake.table("customer").filter("c_acctbal < 0").select("c_name")], path)
    return lake.spark.read.option("header", True).csv(path).withColumn("observed_value", F.col("observed_value").cast("double"))


@query("stored_metrics", f"""
SELECT column_name, position, drift_score, '{{"column_name":"' || column_name || '"}}' AS about, n FROM (
  SELECT column_name, position, drift_score, 2::BIGINT AS n FROM ({union(_drift_sql(i, c, _REF, _CUR) for i, c in enumerate(("o_totalprice", "o_custkey")))}))""")
def stored_metrics(lake: Lake):
    """Two appends of the same drift rows, read back."""
    path = scratch_path(lake.spark, "metrics")
    rows = drift(*_drift_pair(lake), ["o_totalprice", "o_custkey"]).select(
        "column_name", "position", "drift_score", F.struct("column_name").alias("about"))
    for _ in range(2):
        sinks.append_metrics(rows, path, ["about"])
    return lake.spark.read.parquet(path).groupBy("column_name", "position", "drift_score", "about").agg(F.count(F.lit(1)).alias("n"))
