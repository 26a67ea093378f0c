"""From rule results to violation events, batches and alert context.

Replaying a history must give the same answer every time, so "now" is always the time of the
result at hand. Result tables are assumed to hold a hot rule: running totals and the walks of ``dedup`` and
``hold_batches`` split its rows, whatever its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import anchors, micros, running_total
from plumbline.session import settle

MINUTE_US = 60_000_000

# Policy defaults and the waiting time per severity, in minutes.
DEFAULT_DEDUP_MINUTES = 5
DEFAULT_BATCH_MINUTES = 60
DEFAULT_SEVERITY = "medium"
DEFAULT_CHANNELS = ("slack", "email")
SEVERITY_MINUTES = {"critical": 0, "high": 15, "medium": 60, "low": 360}
OTHER_SEVERITY_MINUTES = 60

# Fixed value: the trend sentence around its two numbers.
TREND = "This rule has triggered %s time(s) in this batch with a total of %s cumulative violations."


def failures(results: DataFrame) -> DataFrame:
    """FAIL and ERROR results of saved rules; ad-hoc runs have no rule_id."""
    return results.filter(F.col("status").isin("FAIL", "ERROR") & F.col("rule_id").isNotNull())


def with_severity(df: DataFrame, rules: DataFrame) -> DataFrame:
    known = rules.select("rule_id", F.col("severity").alias("_severity"))
    return (
        df.join(known, "rule_id", "left")
        .withColumn("severity", F.coalesce("_severity", F.lit(DEFAULT_SEVERITY)))
        .drop("_severity")
    )


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Add the rule's windows and switches; a rule without a policy gets the defaults."""
    defaults = {
        "deduplication_window_minutes": DEFAULT_DEDUP_MINUTES,
        "batch_window_minutes": DEFAULT_BATCH_MINUTES,
        "enable_llm_summary": False,
        "enable_fix_suggestions": False,
        "slack_enabled": True,
        "email_enabled": True,
    }
    given = [name for name in defaults if name in policies.columns]
    policy = policies.select("rule_id", *[F.col(name).alias(f"_p_{name}") for name in given])
    joined = df.join(policy, "rule_id", "left")
    for name, default in defaults.items():
        value = F.lit(default)
        if name in given:
            value = F.coalesce(F.col(f"_p_{name}"), value)
        joined = joined.withColumn(name, value)
    return joined.drop(*[f"_p_{name}" for name in given])


def canonical_rows(rows: Column) -> Column:
    """Sample rows (array of maps) as text with sorted keys; '' when there are none."""
    ordered = F.transform(
        rows, lambda row: F.map_from_entries(F.array_sort(F.map_entries(row)))
    )
    return F.when(F.size(rows) > 0, F.to_json(ordered)).otherwise("")


def fingerprint(rule_id: Column, status: Column, rows: Column | None = None) -> Column:
    text = F.lit("") if rows is None else F.coalesce(canonical_rows(rows), F.lit(""))
    return F.sha2(F.concat_ws(":", rule_id.cast("string"), status, text), 256)


def dedup(
    df: DataFrame,
    time: str = "executed_at",
    row_id: str = "result_id",
    window_minutes: str = "deduplication_window_minutes",
    **options,
) -> DataFrame:
    """Add ``is_new``: no recorded failure with the same rule and fingerprint in the window.

    Duplicates are not recorded, so the window is counted from the last *recorded* failure; a
    failure exactly one window later is still a duplicate. Only four narrow columns take part in
    the walk; its result comes back to the rows by their id.
    """
    recorded = anchors(
        df,
        F.concat_ws(":", F.col("rule_id").cast("string"), "fingerprint"),
        micros(F.col(time)),
        F.col(row_id),
        F.col(window_minutes).cast("long") * MINUTE_US,
        **options,
    )
    marked = recorded.select(F.col("_id").alias(row_id), F.lit(True).alias("_new"))
    return (
        df.join(marked, row_id, "left")
        .withColumn("is_new", F.coalesce("_new", F.lit(False)))
        .drop("_new")
    )


def severity_minutes(severity: Column) -> Column:
    minutes = F.lit(OTHER_SEVERITY_MINUTES)
    for name, value in SEVERITY_MINUTES.items():
        minutes = F.when(severity == name, value).otherwise(minutes)
    return minutes


def hold_batches(
    df: DataFrame, time: str = "executed_at", row_id: str = "result_id", **options
) -> DataFrame:
    """Add ``is_new`` for batches held open by severity: a failure joins its rule's open batch
    until the severity's minutes have passed since the batch's first failure."""
    opened = anchors(
        df,
        F.col("rule_id").cast("string"),
        micros(F.col(time)),
        F.col(row_id),
        severity_minutes(F.col("severity")).cast("long") * MINUTE_US,
        inclusive=True,
        **options,
    )
    marked = opened.select(F.col("_id").alias(row_id), F.lit(True).alias("_new"))
    return (
        df.join(marked, row_id, "left")
        .withColumn("is_new", F.coalesce("_new", F.lit(False)))
        .drop("_new")
    )


def assign_batches(
    df: DataFrame, time: str = "executed_at", row_id: str = "result_id"
) -> DataFrame:
    """Add ``batch_no``, counted per rule: a new failure opens a batch, a duplicate joins the
    rule's latest batch whatever its fingerprint."""
    ready = df.withColumn("_opens", F.col("is_new").cast("long")).withColumn(
        "_us", micros(F.col(time))
    )
    return running_total(
        ready, ["rule_id"], [F.col("_us"), F.col(row_id)], {"batch_no": "_opens"}
    ).drop("_opens", "_us")


def attach_to_batches(
    events: DataFrame,
    probes: DataFrame,
    probe_time: str,
    probe_id: str,
    event_time: str = "executed_at",
    row_id: str = "result_id",
) -> DataFrame:
    """Add ``batch_no`` to *probes* (deliveries, feedback, ...): the rule's latest batch opened
    at or before the probe's time. Probes before the first batch are dropped.

    An as-of join as a running count over openings and probes together, so that no probe meets
    more than its own position in time.
    """
    opens = events.filter("is_new").select(
        "rule_id", micros(F.col(event_time)).alias("_us"), F.lit(0).alias("_side"),
        F.col(row_id).cast("long").alias("_id"), F.lit(1).cast("long").alias("_opens"),
    )
    asks = probes.select(
        "rule_id", micros(F.col(probe_time)).alias("_us"), F.lit(1).alias("_side"),
        F.col(probe_id).cast("long").alias("_id"), F.lit(0).cast("long").alias("_opens"),
    )
    counted = running_total(
        opens.unionByName(asks),
        ["rule_id"],
        [F.col("_us"), F.col("_side"), F.col("_id")],
        {"batch_no": "_opens"},
    )
    found = counted.filter((F.col("_side") == 1) & (F.col("batch_no") > 0)).select(
        F.col("_id").alias(probe_id), "batch_no"
    )
    return probes.join(found, probe_id)


def number_rows(
    events: DataFrame,
    probes: dict[str, tuple[DataFrame, str, str]],
    event_time: str = "executed_at",
    row_id: str = "result_id",
) -> dict[str, DataFrame]:
    """``batch_no`` for the failures (as ``assign_batches``) and for any number of other tables (as ``attach_to_batches``)
    from one running total: all rows of a rule stand in one order of time, failures first, and each takes the
    number of batches opened so far. *probes* has for each name a table with a rule_id, its time column and its id column.
    Returned under the same names, the failures as "events"; written once, since several results are read off.
    """
    def rows(kind: str, df: DataFrame, time: str, key: str, side: int, opens: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("_kind"), F.col("rule_id").alias("_rule"), micros(F.col(time)).alias("_us"), F.lit(side).alias("_side"),
            F.col(key).cast("long").alias("_id"), opens.cast("long").alias("_opens"), F.struct("*").alias(kind))

    swept = rows("events", events, event_time, row_id, 0, F.col("is_new"))
    for place, (kind, (df, time, key)) in enumerate(probes.items(), start=1):
        swept = swept.unionByName(rows(kind, df, time, key, place, F.lit(0)), allowMissingColumns=True)
    counted = settle(running_total(
        swept, ["_rule"], [F.col("_us"), F.col("_side"), F.col("_id")], {"batch_no": "_opens"}), "numbered")
    return {kind: counted.filter((F.col("_kind") == kind) & (F.col("batch_no") > 0)).select(f"{kind}.*", "batch_no")
            for kind in ("events", *probes)}


def first_failures(events: DataFrame, event_time: str = "executed_at") -> DataFrame:
    """(rule_id, first_failure): a rule's first failure opens its first batch."""
    return events.groupBy("rule_id").agg(F.min(event_time).alias("first_failure"))


def in_some_batch(events: DataFrame, probes: DataFrame, probe_time: str, event_time: str = "executed_at") -> DataFrame:
    """The *probes* that have a batch at all: those at or after their rule's first failure. One aggregate of the failures, for
    callers that do not ask which batch it is."""
    opened = F.col(probe_time) >= F.col("first_failure")
    return probes.join(first_failures(events, event_time), "rule_id").filter(opened).drop("first_failure")


def batch_summary(
    df: DataFrame, time: str = "executed_at", value: str = "observed_value"
) -> DataFrame:
    """First and last time, occurrences and violation total per (rule_id, batch_no).

    The total of a batch of one is that failure's value, NULL included; from the second
    occurrence on a NULL counts as zero.
    """
    n = F.count(F.lit(1))
    total = F.when(n == 1, F.max(value)).otherwise(F.sum(F.coalesce(F.col(value), F.lit(0))))
    return df.groupBy("rule_id", "batch_no").agg(
        F.max("severity").alias("severity"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        n.alias("total_occurrences"),
        total.alias("total_violation_count"),
    )


def due_batches(batches: DataFrame, as_of: Column) -> DataFrame:
    """Open batches whose severity window has run out by *as_of*."""
    age = micros(as_of) - micros(F.col("first_seen"))
    limit = severity_minutes(F.col("severity")).cast("long") * MINUTE_US
    open_ones = batches.filter(F.col("status") == "open") if "status" in batches.columns else batches
    return open_ones.filter(age >= limit)


def missing_channels(
    batches: DataFrame, deliveries: DataFrame, channels: str | None = None
) -> DataFrame:
    """(rule_id, batch_no, channel): requested channels with no 'sent' delivery since the batch
    began. The latest sent time per (rule, channel) decides it, so deliveries never multiply."""
    requested = F.array(*[F.lit(c) for c in DEFAULT_CHANNELS])
    if channels is not None:
        listed = F.col(channels)
        requested = F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(requested)
    asked = batches.select(
        "rule_id", "batch_no", "first_seen", F.explode(requested).alias("channel")
    )
    sent = (
        deliveries.filter(F.col("status") == "sent")
        .groupBy("rule_id", "channel")
        .agg(F.max("sent_at").alias("_last_sent"))
    )
    return (
        asked.join(sent, ["rule_id", "channel"], "left")
        .filter(F.col("_last_sent").isNull() | (F.col("_last_sent") < F.col("first_seen")))
        .select("rule_id", "batch_no", "channel")
    )


def delivery_outcome(deliveries: DataFrame, keys=("rule_id", "batch_no")) -> DataFrame:
    """attempted, sent, failed and skipped per batch; skipped ones were not attempted."""
    status = F.col("status")
    return deliveries.groupBy(*keys).agg(
        F.count_if(status != "skipped").alias("attempted"),
        F.count_if(status == "sent").alias("sent"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    )


def batch_status(batches: DataFrame, deliveries: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``status``: resolved when the rule is gone, dispatched when anything was sent, failed
    when deliveries were tried in vain, else open. *deliveries* carry their batch_no."""
    outcome = delivery_outcome(deliveries).select(
        "rule_id", "batch_no", (F.col("sent") > 0).alias("_any_sent")
    )
    present = rules.select("rule_id", F.lit(True).alias("_present")).distinct()
    status = (
        F.when(F.col("_present").isNull(), "resolved")
        .when(F.col("_any_sent"), "dispatched")
        .when(F.col("_any_sent").isNotNull(), "failed")
        .otherwise("open")
    )
    return (
        batches.join(outcome, ["rule_id", "batch_no"], "left")
        .join(present, "rule_id", "left")
        .withColumn("status", status)
        .drop("_any_sent", "_present")
    )


def event_status(events: DataFrame, batches: DataFrame) -> DataFrame:
    """A rule's recorded events count as dispatched up to its latest dispatched batch."""
    reached = (
        batches.filter(F.col("status") == "dispatched")
        .groupBy("rule_id")
        .agg(F.max("batch_no").alias("_reached"))
    )
    done = F.coalesce(F.col("batch_no") <= F.col("_reached"), F.lit(False))
    return (
        events.join(reached, "rule_id", "left")
        .withColumn("event_status", F.when(done, "dispatched").otherwise("open"))
        .drop("_reached")
    )


def alert_context(
    df: DataFrame,
    window_minutes: str = "deduplication_window_minutes",
    time: str = "executed_at",
    row_id: str = "result_id",
    value: str = "observed_value",
) -> DataFrame:
    """(row id, recent_failure_count, recent_observed_total, window_started_at, window_ended_at): the rule's failures from
    W minutes before each failure up to it, both ends included.

    Each failure enters a running total twice: as itself, and as a question at the start of its
    window. The difference of the two totals is the window's content, so the cost does not grow
    with the number of rows in a window. Totals are exact decimals, so nothing cancels away.
    """
    amount = F.coalesce(F.col(value).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))
    at = micros(F.col(time))
    window = F.greatest(F.col(window_minutes).cast("long"), F.lit(0)) * MINUTE_US
    marks = F.array(
        F.struct(
            (at - window).alias("_us"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"),
            F.lit(0).cast("decimal(38,10)").alias("_v"),
        ),
        F.struct(
            at.alias("_us"), F.lit(1).alias("_side"), F.lit(1).cast("long").alias("_n"),
            amount.alias("_v"),
        ),
    )
    totals = running_total(
        df.select("rule_id", F.col(row_id), F.inline(marks)),
        ["rule_id"],
        [F.col("_us"), F.col("_side")],
        {"cum_n": "_n", "cum_v": "_v"},
        peers=True,
    )

    def at_side(side, column):
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    return totals.groupBy("rule_id", row_id).agg(
        (at_side(1, "cum_n") - at_side(0, "cum_n")).alias("recent_failure_count"),
        (at_side(1, "cum_v") - at_side(0, "cum_v")).alias("recent_observed_total"),
        F.timestamp_micros(F.min("_us")).alias("window_started_at"),
        F.timestamp_micros(F.max("_us")).alias("window_ended_at"),
    )


def with_batch_totals(context: DataFrame, events: DataFrame, row_id: str = "result_id") -> DataFrame:
    """Add batch_no, batch_occurrences, batch_violation_count, batch_first_seen and batch_last_seen of the batch that each
    failure is in; *events* are the failures with their batch_no."""
    totals = batch_summary(events).select(
        "rule_id", "batch_no", F.col("total_occurrences").alias("batch_occurrences"),
        F.col("total_violation_count").alias("batch_violation_count"), F.col("first_seen").alias("batch_first_seen"),
        F.col("last_seen").alias("batch_last_seen"))
    numbers = events.select("rule_id", row_id, "batch_no")
    return context.join(numbers, ["rule_id", row_id]).join(totals, ["rule_id", "batch_no"])


def latest_sample(events: DataFrame, time: str = "executed_at", row_id: str = "result_id") -> DataFrame:
    """The newest event's sample rows per rule."""
    newest = F.max_by("sample_rows", F.struct(F.col(time), F.col(row_id)))
    return events.groupBy("rule_id").agg(newest.alias("sample_rows"))


def batch_context(
    batches: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    time: str = "executed_at",
    row_id: str = "result_id",
) -> DataFrame:
    """Per batch of a known rule: up to five recent sample rows of the rule and a trend sentence.

    The five newest events of a rule give at most two rows each.
    """
    newest = Window.partitionBy("rule_id").orderBy(F.desc(time), F.desc(row_id))
    recent = (
        events.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= 5)
        .withColumn("_few", F.slice("sample_rows", 1, 2))
        .groupBy("rule_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("_r", "_few"))).alias("_recent"))
    )
    by_age = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda r: F.try_element_at("_recent", r))
    rows = F.slice(F.flatten(F.filter(by_age, lambda few: few.isNotNull())), 1, 5)
    total = F.coalesce(F.col("total_violation_count"), F.lit(0))
    shown = F.when(total == F.floor(total), total.cast("decimal(38,0)").cast("string")).otherwise(
        total.cast("double").cast("string")
    )
    trend = F.format_string(TREND, F.col("total_occurrences").cast("string"), shown)
    names = rules.select("rule_id", "rule_name")
    return (
        batches.join(names, "rule_id")
        .join(recent, "rule_id", "left")
        .select(
            "rule_id", "batch_no", "rule_name", "severity",
            F.col("total_violation_count").alias("violation_count"),
            F.coalesce(rows, F.array().cast("array<map<string,string>>")).alias("sample_rows"),
            trend.alias("trend_summary"),
        )
    )
