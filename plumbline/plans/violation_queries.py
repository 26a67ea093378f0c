"""Violations: events, dedup, batches, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import violations as V
from plumbline.operators.rule_table import list_rows
from plumbline.plans.catalog import Lake, number, query, us, with_control
from plumbline.session import settle


@query("violation_failures", with_control("test_results rules policies", """
SELECT r.result_id, r.rule_id, r.status, coalesce(u.severity, 'medium') AS severity,
       CAST(coalesce(p.minutes, 5) AS BIGINT) AS dedup_minutes, CAST(60 AS INTEGER) AS batch_minutes,
       CAST(r.observed_value AS DOUBLE) AS observed_value,
       sha256(CAST(r.rule_id AS VARCHAR) || ':' || r.status || ':' || '[{"k":"' || (r.props->>'$.k') || '"}]') AS fingerprint
FROM (SELECT * REPLACE (CASE WHEN observed_value > 200 THEN NULL ELSE rule_id END AS rule_id) FROM test_results) r
LEFT JOIN rules u USING (rule_id) LEFT JOIN policies p USING (rule_id)
WHERE r.status IN ('FAIL', 'ERROR') AND r.rule_id IS NOT NULL"""))
def violation_failures(lake: Lake):
    ad_hoc = F.col("observed_value") > 200
    results = lake.results().withColumn(
        "rule_id", F.when(ad_hoc, None).otherwise(F.col("rule_id"))
    )
    ready = V.with_policy(V.with_severity(V.failures(results), lake.rules()), lake.policies())
    return ready.select(
        "result_id", "rule_id", "status", "severity",
        F.col("deduplication_window_minutes").alias("dedup_minutes"),
        F.col("batch_window_minutes").alias("batch_minutes"),
        number("observed_value"),
        V.fingerprint(F.col("rule_id"), F.col("status"), F.col("sample_rows")).alias("fingerprint"),
    )


@query("violation_dedup", with_control("fails anchor_ids", """
SELECT f.result_id, f.rule_id, f.status, epoch_us(f.executed_at) AS executed_at, a.result_id IS NOT NULL AS is_new
FROM fails f LEFT JOIN anchor_ids a USING (result_id)"""))
def violation_dedup(lake: Lake):
    return V.dedup(lake.failures()).select(
        "result_id", "rule_id", "status", us("executed_at"), "is_new"
    )


@query("violation_batches", with_control("batches", """
SELECT rule_id, CAST(batch_no AS BIGINT) AS batch_no, severity, epoch_us(first_seen) AS first_seen,
       epoch_us(last_seen) AS last_seen, total_occurrences, CAST(total_violation_count AS DOUBLE) AS total_violation_count
FROM batches"""))
def violation_batches(lake: Lake):
    return V.batch_summary(lake.events()).select(
        "rule_id", "batch_no", "severity", us("first_seen"), us("last_seen"), "total_occurrences",
        number("total_violation_count"),
    )


_HELD = """
held_times AS (
  SELECT rule_id, min(executed_at) AS t, max(m) AS m FROM held_fails WHERE m > 0 GROUP BY rule_id
  UNION ALL
  SELECT f.rule_id, min(f.executed_at), max(f.m) FROM held_times a JOIN held_fails f
    ON f.rule_id = a.rule_id AND f.executed_at >= a.t + a.m * INTERVAL 1 MINUTE GROUP BY f.rule_id),
held_ids AS (
  SELECT min(f.result_id) AS result_id FROM held_times a
  JOIN held_fails f ON f.rule_id = a.rule_id AND f.executed_at = a.t GROUP BY f.rule_id, a.t
  UNION ALL SELECT result_id FROM held_fails WHERE m <= 0),
held AS (
  SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY executed_at, result_id ROWS UNBOUNDED PRECEDING) AS batch_no
  FROM (SELECT f.*, h.result_id IS NOT NULL AS is_new FROM held_fails f LEFT JOIN held_ids h USING (result_id))),
held_batches AS (
  SELECT rule_id, batch_no, max(severity) AS severity, min(executed_at) AS first_seen, max(executed_at) AS last_seen,
         count(*) AS total_occurrences,
         CASE WHEN count(*) = 1 THEN max(observed_value) ELSE sum(coalesce(observed_value, 0)) END AS total_violation_count
  FROM held GROUP BY rule_id, batch_no)"""
_HELD_FAILS = """, held_fails AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 15
  WHEN 'medium' THEN 60 WHEN 'low' THEN 360 ELSE 60 END AS m FROM fails), """


def held_sql(body: str) -> str:
    return with_control("fails", "").rstrip() + _HELD_FAILS + _HELD + body


def held_batches_of(lake: Lake):
    held = settle(V.hold_batches(lake.failures()))
    return V.batch_summary(V.assign_batches(held))


@query("held_batches", held_sql("""
SELECT rule_id, CAST(batch_no AS BIGINT) AS batch_no, severity, epoch_us(first_seen) AS first_seen,
       epoch_us(last_seen) AS last_seen, total_occurrences, CAST(total_violation_count AS DOUBLE) AS total_violation_count
FROM held_batches"""))
def held_batches(lake: Lake):
    return held_batches_of(lake).select(
        "rule_id", "batch_no", "severity", us("first_seen"), us("last_seen"), "total_occurrences",
        number("total_violation_count"),
    )


@query("due_batches", held_sql("""
SELECT rule_id, CAST(batch_no AS BIGINT) AS batch_no, severity, epoch_us(first_seen) AS first_seen
FROM held_batches
WHERE first_seen + CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 15 WHEN 'medium' THEN 60
      WHEN 'low' THEN 360 ELSE 60 END * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-15 12:00:00'"""))
def due_batches(lake: Lake):
    moment = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return V.due_batches(held_batches_of(lake), moment).select(
        "rule_id", "batch_no", "severity", us("first_seen")
    )


@query("missing_channels", with_control("batches deliveries rules", """
SELECT b.rule_id, CAST(b.batch_no AS BIGINT) AS batch_no, c.channel
FROM batches b JOIN rules r USING (rule_id)
CROSS JOIN (VALUES ('slack'), ('email')) c(channel)
WHERE (c.channel = 'email' OR coalesce(r.notification_channels, '') <> '["email"]')
  AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.rule_id = b.rule_id AND d.channel = c.channel
                  AND d.status = 'sent' AND d.sent_at >= b.first_seen)"""))
def missing_channels(lake: Lake):
    from plumbline.functions.values import json_list

    wanted = lake.rules().select(
        "rule_id", json_list(F.col("notification_channels"), ["slack", "email"]).alias("channels")
    )
    batches = V.batch_summary(lake.events()).join(wanted, "rule_id")
    return V.missing_channels(batches, lake.deliveries(), "channels")


@query("batch_status", with_control("status_batches", """
SELECT rule_id, CAST(batch_no AS BIGINT) AS batch_no, status FROM status_batches"""))
def batch_status(lake: Lake):
    return status_batches_of(lake, _with_deliveries(lake)).select("rule_id", "batch_no", "status")


def known_rules_of(lake: Lake):
    return lake.rules().filter(F.col("table_name") != "sales.furniture")


def _with_deliveries(lake: Lake):
    return lake.numbered(lake.recorded(), deliveries=(lake.deliveries(), "sent_at"))


def status_batches_of(lake: Lake, numbered):
    return V.batch_status(V.batch_summary(numbered["events"]), numbered["deliveries"], known_rules_of(lake))


@query("event_status", with_control("vevents status_batches", """
SELECT v.result_id, v.rule_id,
       CASE WHEN v.batch_no <= m.reached THEN 'dispatched' ELSE 'open' END AS event_status
FROM vevents v LEFT JOIN (SELECT rule_id, max(batch_no) AS reached FROM status_batches
                          WHERE status = 'dispatched' GROUP BY rule_id) m USING (rule_id)
WHERE v.is_new"""))
def event_status(lake: Lake):
    return event_status_of(lake).select("result_id", "rule_id", "event_status")


def event_status_of(lake: Lake):
    numbered = _with_deliveries(lake)
    return V.event_status(numbered["events"].filter("is_new"), status_batches_of(lake, numbered))


@query("listed_events", with_control("vevents status_batches", """
SELECT v.result_id, v.rule_id, epoch_us(v.executed_at) AS executed_at
FROM vevents v LEFT JOIN (SELECT rule_id, max(batch_no) AS reached FROM status_batches
                          WHERE status = 'dispatched' GROUP BY rule_id) m USING (rule_id)
WHERE v.is_new AND NOT coalesce(v.batch_no <= m.reached, FALSE) ORDER BY v.executed_at DESC, v.result_id DESC LIMIT 100"""))
def listed_events(lake: Lake):
    """The newest events that are still open."""
    return list_rows(event_status_of(lake), [F.desc("executed_at"), F.desc("result_id")], 100, event_status="open").select(
        "result_id", "rule_id", us("executed_at"))


@query("delivery_outcome", with_control("sent_batches", """
SELECT rule_id, CAST(batch_no AS BIGINT) AS batch_no, count(*) FILTER (WHERE status <> 'skipped') AS attempted,
       count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'skipped') AS skipped
FROM sent_batches GROUP BY rule_id, batch_no"""))
def delivery_outcome(lake: Lake):
    return V.delivery_outcome(_with_deliveries(lake)["deliveries"])


@query("alert_context", with_control("fails", """
SELECT f.result_id, f.rule_id, count(*) AS recent_failure_count,
       CAST(sum(coalesce(g.observed_value, 0)) AS DOUBLE) AS recent_observed_total,
       epoch_us(any_value(f.executed_at) - any_value(f.w) * INTERVAL 1 MINUTE) AS window_started_at, epoch_us(any_value(f.executed_at)) AS window_ended_at
FROM fails f JOIN fails g ON g.rule_id = f.rule_id AND g.executed_at <= f.executed_at
  AND g.executed_at >= f.executed_at - f.w * INTERVAL 1 MINUTE
GROUP BY f.result_id, f.rule_id"""))
def alert_context(lake: Lake):
    return V.alert_context(lake.failures()).select(
        "result_id", "rule_id", "recent_failure_count", number("recent_observed_total"), us("window_started_at"), us("window_ended_at")
    )


@query("alert_context_batches", with_control("vevents batches", """
SELECT f.result_id, f.rule_id, n.recent_failure_count, CAST(f.batch_no AS BIGINT) AS batch_no, b.total_occurrences AS batch_occurrences,
       CAST(b.total_violation_count AS DOUBLE) AS batch_violation_count, epoch_us(b.first_seen) AS batch_first_seen, epoch_us(b.last_seen) AS batch_last_seen
FROM vevents f JOIN batches b USING (rule_id, batch_no)
JOIN (SELECT f.result_id, count(*) AS recent_failure_count FROM fails f JOIN fails g ON g.rule_id = f.rule_id AND g.executed_at <= f.executed_at
        AND g.executed_at >= f.executed_at - f.w * INTERVAL 1 MINUTE GROUP BY f.result_id) n USING (result_id)"""))
def alert_context_batches(lake: Lake):
    """The context of every failure with the totals of the batch it is in."""
    events = settle(lake.events())
    return V.with_batch_totals(V.alert_context(events), events).select(
        "result_id", "rule_id", "recent_failure_count", "batch_no", "batch_occurrences", number("batch_violation_count"),
        us("batch_first_seen"), us("batch_last_seen"))


@query("latest_sample", with_control("vevents", """
SELECT rule_id, arg_max(props->>'$.k', (executed_at, result_id)) AS sample_k FROM vevents WHERE is_new GROUP BY rule_id"""))
def latest_sample(lake: Lake):
    recorded = V.dedup(lake.failures()).filter("is_new")
    return V.latest_sample(recorded).select(
        "rule_id", F.col("sample_rows")[0]["k"].alias("sample_k")
    )


@query("batch_context", with_control("vevents batches rules", """
SELECT b.rule_id, CAST(b.batch_no AS BIGINT) AS batch_no, r.rule_name, b.severity,
       coalesce(s.samples, '') AS samples,
       'This rule has triggered ' || b.total_occurrences || ' time(s) in this batch with a total of ' ||
       CASE WHEN coalesce(b.total_violation_count, 0) = floor(coalesce(b.total_violation_count, 0))
            THEN CAST(CAST(coalesce(b.total_violation_count, 0) AS BIGINT) AS VARCHAR)
            ELSE CAST(CAST(b.total_violation_count AS DOUBLE) AS VARCHAR) END || ' cumulative violations.' AS trend_summary
FROM batches b JOIN rules r USING (rule_id)
LEFT JOIN (SELECT rule_id, string_agg(props->>'$.k', ',' ORDER BY n) AS samples
           FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY executed_at DESC, result_id DESC) AS n
                 FROM vevents WHERE is_new) WHERE n <= 5 GROUP BY rule_id) s USING (rule_id)"""))
def batch_context(lake: Lake):
    recorded = lake.recorded()
    batches = V.batch_summary(lake.events(recorded))
    context = V.batch_context(batches, recorded.filter("is_new"), lake.rules())
    samples = F.array_join(F.transform("sample_rows", lambda row: row["k"]), ",")
    return context.select(
        "rule_id", "batch_no", "rule_name", "severity", samples.alias("samples"), "trend_summary"
    )


