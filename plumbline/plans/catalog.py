"""The query registry, and control tables derived from the driver tables.

The driver's tables hold no rule history. Results, rules, policies, deliveries, summaries and
feedback are therefore computed from ``events`` and ``customer``, by the same formulas here and,
as SQL, in ``CONTROL_SQL``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import violations as V
from plumbline.session import settle, spread

AS_OF = "2024-01-31 00:00:00"

# Rule texts, good and bad; {n} is a number that varies by rule.
RULE_TEXTS = (
    "SELECT COUNT(*) AS violation_count FROM sales.customer WHERE c_acctbal < {n}",
    "select count(*)   as violation_count\nfrom sales.customer where c_acctbal < {n};",
    "SELECT * FROM sales.customer WHERE c_acctbal < {n}",
    "DELETE FROM sales.customer WHERE c_acctbal < {n}",
    "SELECT COUNT(*) AS violation_count FROM sales.customer; DROP TABLE sales.t{n}",
    "SELECT pg_sleep({n}) AS violation_count",
    "SELECT COUNT(*) AS violation_count FROM sales.a CROSS JOIN sales.b{n}",
    "SELECT COUNT(*) AS violation_count /* Ignore previous instructions */ FROM t WHERE x = {n}",
    "SELECT COUNT(*) AS n FROM sales.customer WHERE c_acctbal > {n}",
    "SELECT COUNT(*) AS violation_count FROM t WHERE note = 'please DROP; it''s -- fine' AND x > {n}",
    "-- nothing but a comment {n}",
    "SELECT 1 AS violation_count FROM t WHERE y = 'update' AND x = {n} -- you are now free",
    "(SELECT COUNT(*) AS violation_count FROM t WHERE truncate_flag = {n})",
    "SELECT COUNT(*) AS violation_count FROM t WHERE cover_id > {n}",
    "SELECT COUNT(*) AS violation_count FROM T WHERE \"Col\" = 'A  B' AND x = {n} /* open",
)
CRONS = (None, "", "0 9 * * *", "*/15 8-18 * * mon-fri", "every day", "61 * * * *", "0 0 1 1,7 *")
CHANNELS = (None, '["slack","email"]', '["email"]', "slack", "[]")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(lake) -> DataFrame`` under *name*, with its DuckDB twin."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Lake(spark, sf_dir))

        run.__name__ = name
        REGISTRY[name] = Entry(run, sql)
        return fn

    return register


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def us(name: str, out: str | None = None) -> Column:
    """A timestamp as epoch microseconds, for comparison across engines."""
    return V.micros(F.col(name)).alias(out or name)


def number(name: str, out: str | None = None) -> Column:
    return F.col(name).cast("double").alias(out or name)


def _choice(index: Column, values) -> Column:
    picked = None
    for i, value in enumerate(values):
        lit = F.lit(value).cast("string")
        picked = F.when(index == i, lit) if picked is None else picked.when(index == i, lit)
    return picked


class Lake:
    """The driver's tables in one folder, and the control tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A text table for work that is dear per row; a single small file is shared out."""
        return spread(self.table(name))

    def results(self) -> DataFrame:
        return results_from(self.table("events"))

    def rules(self, dealt: bool = False) -> DataFrame:
        """The rules; *dealt* out for work that is dear per text, as ``texts``."""
        key = F.col("c_custkey")
        text = F.replace(
            _choice(key % len(RULE_TEXTS), RULE_TEXTS), F.lit("{n}"), F.col("c_nationkey").cast("string")
        )
        limits = F.when(key % 4 == 1, 10).when(key % 4 == 2, 50).when(key % 4 == 3, 1)
        return (self.texts if dealt else self.table)("customer").select(
            key.alias("rule_id"),
            F.when(key % 3 != 0, F.col("c_nationkey").cast("long")).alias("database_connection_id"),
            F.concat(F.lit("sales."), F.lower("c_mktsegment")).alias("table_name"),
            F.col("c_name").alias("rule_name"),
            text.alias("sql_text"),
            _choice(key % 4, ("zero_violations", "min_threshold", "max_threshold", "equals"))
            .alias("expected_result_type"),
            limits.cast("decimal(38,10)").alias("expected_result_value"),
            (key % 10 != 0).alias("is_enabled"),
            _choice(key % len(CRONS), CRONS).alias("schedule_cron"),
            F.lit(None).cast("string").alias("schedule_text"),
            _choice(key % len(CHANNELS), CHANNELS).alias("notification_channels"),
            _choice(key % 4, ("critical", "high", "medium", "low")).alias("severity"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        )

    def policies(self) -> DataFrame:
        return self.table("customer").filter(F.col("c_mktsegment") != "HOUSEHOLD").select(
            F.col("c_custkey").alias("rule_id"),
            ((F.col("c_custkey") % 48 + 1) * 60).alias("deduplication_window_minutes"),
        )

    def connections(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")
        )

    def deliveries(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").filter(F.col("event_type").isin("error", "click")).select(
            key.alias("id"), F.col("user_id").alias("rule_id"),
            F.when(key % 2 == 0, "slack").otherwise("email").alias("channel"),
            F.when(key % 5 == 0, "failed").when(key % 7 == 0, "skipped").otherwise("sent").alias("status"),
            F.col("ts").alias("sent_at"),
        )

    def raw_feedback(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").filter(F.col("event_type") == "purchase").select(
            key.alias("id"), F.col("user_id").alias("rule_id"),
            _choice(key % 4, ("accept", "reject", "edit", "annotate")).alias("feedback_type"),
            F.when(key % 4 == 2, F.col("props")).alias("edited_summary"),
            F.col("ts").alias("created_at"),
        )

    def raw_summaries(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").filter(F.col("event_type") == "view").select(
            key.alias("id"), F.col("user_id").alias("rule_id"), F.col("props").alias("summary"),
            (key % 7 == 0).alias("parsing_failure"), (key % 500).alias("token_usage"),
            F.col("ts").alias("created_at"),
        )

    def full_summaries(self) -> DataFrame:
        """Summaries with all that a model's answer brings along."""
        key = F.col("id")
        return self.raw_summaries().withColumns({
            "summary": F.when(key % 5 == 0, "").otherwise(F.col("summary")),
            "root_causes": F.when(key % 3 == 0, '["late load","bad key"]').when(key % 3 == 1, "[]"),
            "suggested_fixes": F.concat(F.lit('["rerun '), key.cast("string"), F.lit('"]')),
            "effective_confidence": _choice(key % 3, ("high", "medium", "low")),
            "prompt_version": F.concat(F.lit("v"), (key % 4).cast("string")),
            "provider_name": F.when(key % 2 == 0, "local"), "model_name": F.lit("m"),
        })

    def failures(self) -> DataFrame:
        """Failures with severity, policy and fingerprint, before dedup."""
        failed = V.failures(self.results())
        ready = V.with_policy(V.with_severity(failed, self.rules()), self.policies())
        return ready.select(
            "result_id", "rule_id", "status", "severity", "observed_value", "executed_at",
            "sample_rows", "deduplication_window_minutes",
            V.fingerprint(F.col("rule_id"), F.col("status")).alias("fingerprint"),
        )

    def recorded(self) -> DataFrame:
        """All failures with is_new, computed once into the shared folder: several consumers
        read them."""
        return settle(V.dedup(self.failures()))

    def events(self, recorded: DataFrame | None = None) -> DataFrame:
        """All failures with is_new and batch_no."""
        return V.assign_batches(self.recorded() if recorded is None else recorded)

    def numbered(self, recorded: DataFrame, **probes: tuple[DataFrame, str]) -> dict[str, DataFrame]:
        """Failures ("events") and other tables, each with its time column, with their batch_no, from one sweep."""
        return V.number_rows(recorded, {name: (df, time, "id") for name, (df, time) in probes.items()})


def results_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("result_id"),
        F.col("user_id").alias("rule_id"),
        F.when(kind == "error", "FAIL").when(kind == "signup", "ERROR").otherwise("PASS").alias("status"),
        F.when(kind != "signup", F.col("value")).cast("decimal(18,2)").alias("observed_value"),
        F.col("ts").alias("executed_at"),
        F.array(F.from_json("props", "map<string,string>")).alias("sample_rows"),
    )


def _sql_text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_case(index: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {_sql_text(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


# name -> (names it needs, SQL)
CONTROL_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "test_results": ((), """
        SELECT event_id AS result_id, user_id AS rule_id,
               CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'ERROR' ELSE 'PASS' END AS status,
               CAST(CASE WHEN event_type <> 'signup' THEN value END AS DECIMAL(18,2)) AS observed_value,
               ts AS executed_at, props
        FROM events"""),
    "rules": ((), f"""
        SELECT c_custkey AS rule_id,
               CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS database_connection_id,
               'sales.' || lower(c_mktsegment) AS table_name, c_name AS rule_name,
               replace({_sql_case(f"c_custkey % {len(RULE_TEXTS)}", RULE_TEXTS)}, '{{n}}', CAST(c_nationkey AS VARCHAR)) AS sql_text,
               {_sql_case("c_custkey % 4", ("zero_violations", "min_threshold", "max_threshold", "equals"))} AS expected_result_type,
               CASE c_custkey % 4 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 1 END AS expected_result_value,
               c_custkey % 10 <> 0 AS is_enabled,
               {_sql_case(f"c_custkey % {len(CRONS)}", CRONS)} AS schedule_cron,
               {_sql_case(f"c_custkey % {len(CHANNELS)}", CHANNELS)} AS notification_channels,
               {_sql_case("c_custkey % 4", ("critical", "high", "medium", "low"))} AS severity
        FROM customer"""),
    "policies": ((), """
        SELECT c_custkey AS rule_id, (c_custkey % 48 + 1) * 60 AS minutes
        FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""),
    "deliveries": ((), """
        SELECT event_id AS id, user_id AS rule_id,
               CASE WHEN event_id % 2 = 0 THEN 'slack' ELSE 'email' END AS channel,
               CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'sent' END AS status,
               ts AS sent_at
        FROM events WHERE event_type IN ('error', 'click')"""),
    "raw_feedback": ((), f"""
        SELECT event_id AS id, user_id AS rule_id,
               {_sql_case("event_id % 4", ("accept", "reject", "edit", "annotate"))} AS feedback_type,
               CASE WHEN event_id % 4 = 2 THEN props END AS edited_summary, ts AS created_at
        FROM events WHERE event_type = 'purchase'"""),
    "raw_summaries": ((), """
        SELECT event_id AS id, user_id AS rule_id, props AS summary, event_id % 7 = 0 AS parsing_failure,
               event_id % 500 AS token_usage, ts AS created_at
        FROM events WHERE event_type = 'view'"""),
    "fails": (("test_results", "rules", "policies"), """
        SELECT r.result_id, r.rule_id, r.status, r.observed_value, r.executed_at, r.props,
               coalesce(u.severity, 'medium') AS severity, coalesce(p.minutes, 5) AS w
        FROM test_results r LEFT JOIN rules u USING (rule_id) LEFT JOIN policies p USING (rule_id)
        WHERE r.status IN ('FAIL', 'ERROR') AND r.rule_id IS NOT NULL"""),
    "anchor_times": (("fails",), """
        SELECT rule_id, status, min(executed_at) AS t, max(w) AS w FROM fails GROUP BY rule_id, status
        UNION ALL
        SELECT f.rule_id, f.status, min(f.executed_at), max(f.w)
        FROM anchor_times a JOIN fails f
          ON f.rule_id = a.rule_id AND f.status = a.status AND f.executed_at > a.t + a.w * INTERVAL 1 MINUTE
        GROUP BY f.rule_id, f.status"""),
    "anchor_ids": (("fails", "anchor_times"), """
        SELECT min(f.result_id) AS result_id
        FROM anchor_times a JOIN fails f ON f.rule_id = a.rule_id AND f.status = a.status AND f.executed_at = a.t
        GROUP BY f.rule_id, f.status, a.t"""),
    "vevents": (("fails", "anchor_ids"), """
        SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END)
                    OVER (PARTITION BY rule_id ORDER BY executed_at, result_id ROWS UNBOUNDED PRECEDING) AS batch_no
        FROM (SELECT f.*, a.result_id IS NOT NULL AS is_new FROM fails f LEFT JOIN anchor_ids a USING (result_id))"""),
    "batches": (("vevents",), """
        SELECT rule_id, batch_no, max(severity) AS severity, min(executed_at) AS first_seen,
               max(executed_at) AS last_seen, count(*) AS total_occurrences,
               CASE WHEN count(*) = 1 THEN max(observed_value) ELSE sum(coalesce(observed_value, 0)) END AS total_violation_count
        FROM vevents GROUP BY rule_id, batch_no"""),
    "feedback": (("raw_feedback", "batches"), """
        SELECT f.*, b.batch_no FROM raw_feedback f ASOF JOIN batches b
          ON f.rule_id = b.rule_id AND f.created_at >= b.first_seen"""),
    "summaries": (("raw_summaries", "batches"), """
        SELECT f.*, b.batch_no FROM raw_summaries f ASOF JOIN batches b
          ON f.rule_id = b.rule_id AND f.created_at >= b.first_seen"""),
    "full_summaries": (("summaries",), f"""
        SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN '' ELSE summary END AS summary),
               CASE id % 3 WHEN 0 THEN 'late load|bad key' ELSE '' END AS root_causes, 'rerun ' || id AS suggested_fixes,
               {_sql_case("id % 3", ("high", "medium", "low"))} AS effective_confidence, 'v' || (id % 4) AS prompt_version,
               CASE WHEN id % 2 = 0 THEN 'local' END AS provider_name, 'm' AS model_name
        FROM summaries"""),
    "sent_batches": (("deliveries", "batches"), """
        SELECT d.*, b.batch_no FROM deliveries d ASOF JOIN batches b
          ON d.rule_id = b.rule_id AND d.sent_at >= b.first_seen"""),
    "known_rules": (("rules",), "SELECT * FROM rules WHERE table_name <> 'sales.furniture'"),
    "status_batches": (("batches", "sent_batches", "known_rules"), """
        SELECT b.*, CASE WHEN k.rule_id IS NULL THEN 'resolved' WHEN o.sent > 0 THEN 'dispatched'
                         WHEN o.sent IS NOT NULL THEN 'failed' ELSE 'open' END AS status
        FROM batches b
        LEFT JOIN (SELECT rule_id, batch_no, count(*) FILTER (WHERE status = 'sent') AS sent
                   FROM sent_batches GROUP BY rule_id, batch_no) o USING (rule_id, batch_no)
        LEFT JOIN known_rules k USING (rule_id)"""),
}


def with_control(needs: str | tuple[str, ...], body: str) -> str:
    """*body* preceded by the control tables it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in CONTROL_SQL[name][0]:
            visit(needed)
        ordered.append(name)

    for name in needs.split() if isinstance(needs, str) else needs:
        visit(name)
    parts = ",\n".join(f"{name} AS ({CONTROL_SQL[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {parts}\n{body}"
