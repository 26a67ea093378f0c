"""Stateful violation streams: dedup, held batches, sliding alert context.

Rows go through two levels. In the first, without state, what a task of a micro-batch holds of one bucket of keys becomes one
row of arrays in order of time, so a hot key reaches its state as a few rows per task. In the second, arrays are merged
and each key is walked from anchor to anchor. Keys share state by bucket, because a call per key costs more than its rows. State
is a few numbers per key and ends with the event time: a window whose end the watermark has passed decides nothing any more. How much a micro-batch holds is limited at the source
(``sources.tables.stream_files``).

Rows that come later than the watermark are left out: the state that they would be compared with may be gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.ordering import _segments, micros
from plumbline.operators.violations import MINUTE_US, failures, severity_minutes


def packed(rows: DataFrame, keys: list[str], each: list[str], values: list[str]) -> DataFrame:
    """One row per key and Arrow batch: *keys*, the columns *each* that are the same for all rows of a key, and the
    columns *values* as arrays in order of ``us`` and ``row_id``. ``last_at`` is the newest time, for the watermark."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ordered = frame.sort_values([*keys, "us", "row_id"], kind="stable")
            bounds = list(_segments(ordered, keys))
            if not bounds:
                continue
            first, last = (np.array(x) for x in zip(*bounds))
            columns = {c: ordered[c].to_numpy() for c in [*keys, *each, *values]}
            yield pd.DataFrame(
                {c: columns[c][first] for c in [*keys, *each]}
                | {c: [columns[c][a:b] for a, b in bounds] for c in values}
                | {"last_at": pd.to_datetime(columns["us"][last - 1], unit="us")})

    fields = [f"{c} {kinds[c]}" for c in [*keys, *each]] + [f"{c} array<{kinds[c]}>" for c in values] + ["last_at timestamp"]
    return rows.mapInPandas(run, ", ".join(fields))


def _merged(frames: Iterator[pd.DataFrame], keys: list[str], values: list[str], since: int) -> pd.DataFrame:
    """The rows of all packs in order of *keys* and time, without what is older than *since*."""
    packs = list(frames)  # a row per Arrow batch of the first level
    rows = pd.DataFrame({c: np.concatenate([np.asarray(x) for frame in packs for x in frame[c]]) for c in [*keys, "us", "row_id", *values]})
    return rows[rows["us"] >= since].sort_values([*keys, "us", "row_id"], kind="stable", ignore_index=True)


def _since(state: GroupState) -> int:
    """Microseconds before which rows are late."""
    return state.getCurrentWatermarkMs() * 1000


#: Buckets of keys that share a row of state. The number is part of a stream's checkpoint.
BUCKETS = 1024


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _dedup_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # the last of the bucket's windows has ended
        state.remove()
        return
    rows = _merged(frames, ["rule_id", "fingerprint"], ["window_us"], _since(state))
    rules, prints, times, windows = (rows[c].to_numpy() for c in ("rule_id", "fingerprint", "us", "window_us"))
    until = {(rule, text): end for rule, text, end in zip(*state.get)} if state.exists else {}
    new = windows <= 0
    for start, end in _segments(rows, ["rule_id", "fingerprint"]):
        window = int(windows[start])
        if window <= 0:
            continue
        who = int(rules[start]), prints[start]
        at = start if who not in until else start + int(np.searchsorted(times[start:end], until[who], side="right"))
        while at < end:
            new[at] = True
            until[who] = int(times[at]) + window
            at += int(np.searchsorted(times[at:end], until[who], side="right"))
    watermark = state.getCurrentWatermarkMs()
    held = [(rule, text, end) for (rule, text), end in until.items() if end // 1000 + 1 > watermark]
    if held:
        state.update(tuple(list(column) for column in zip(*held)))
        state.setTimeoutTimestamp(max(end for _, _, end in held) // 1000 + 1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"row_id": rows["row_id"], "rule_id": rules, "fingerprint": prints, "us": times, "is_new": new})


def stream_dedup(
    stream: DataFrame,
    time: str = "executed_at",
    row_id: str = "result_id",
    window_minutes: str = "deduplication_window_minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Anchored dedup as a stream: (row_id, rule_id, fingerprint, us, is_new).

    State is the end of a key's current window, and is dropped once the watermark has passed it: with the bucket's next rows,
    or when the last window of the bucket has ended. Rows later than the
    watermark (*delay* behind the newest row) are left out; others from before the end of the window are duplicates.
    """
    rows = failures(stream).select(
        F.col(row_id).cast("long").alias("row_id"), "rule_id", "fingerprint",
        micros(F.col(time)).alias("us"),
        (F.col(window_minutes).cast("long") * MINUTE_US).alias("window_us"),
    )
    dealt = rows.withColumn("bucket", bucket_of("rule_id", "fingerprint"))
    packs = packed(dealt, ["bucket"], [], ["rule_id", "fingerprint", "us", "row_id", "window_us"]).withWatermark("last_at", delay)
    return packs.groupBy("bucket").applyInPandasWithState(
        _dedup_rows,
        "row_id long, rule_id long, fingerprint string, us long, is_new boolean",
        "rules array<long>, fingerprints array<string>, untils array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


_BATCH = ["rule_id", "severity", "first_us", "last_us", "occurrences", "violation_total"]


def _held_rows(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {rule: list(batch) for rule, *batch in zip(*state.get)} if state.exists else {}
    closed = []
    if not state.hasTimedOut:
        rows = _merged(frames, ["rule_id"], ["value", "severity", "window_us"], _since(state))
        rules, us, severities, windows = (rows[c].to_numpy() for c in ("rule_id", "us", "severity", "window_us"))
        amounts = np.nan_to_num(rows["value"].to_numpy().astype(float))
        for start, stop in _segments(rows, ["rule_id"]):
            rule, at = int(rules[start]), start
            batch = held.get(rule)
            while at < stop:
                if batch is None or us[at] >= batch[2] + batch[1]:
                    if batch is not None:
                        closed.append((rule, batch[0], *batch[2:]))
                    batch = [severities[at], int(windows[at]), int(us[at]), int(us[at]), 0, 0.0]
                    end = max(at + 1, at + int(np.searchsorted(us[at:stop], batch[2] + batch[1], side="left")))
                else:
                    end = at + int(np.searchsorted(us[at:stop], batch[2] + batch[1], side="left"))
                batch[3] = max(batch[3], int(us[end - 1]))
                batch[4] += end - at
                batch[5] += float(amounts[at:end].sum())
                at = end
            held[rule] = batch
    watermark = state.getCurrentWatermarkMs()
    due_ms = {rule: (batch[2] + batch[1]) // 1000 + 1 for rule, batch in held.items()}
    closed += [(rule, held[rule][0], *held[rule][2:]) for rule, due in due_ms.items() if due <= watermark]
    open_ = [rule for rule, due in due_ms.items() if due > watermark]
    if open_:
        state.update(tuple(list(column) for column in zip(*[(rule, *held[rule]) for rule in open_])))
        state.setTimeoutTimestamp(min(due_ms[rule] for rule in open_))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(closed, columns=_BATCH)


def stream_batches(
    stream: DataFrame,
    time: str = "executed_at",
    row_id: str = "result_id",
    value: str = "observed_value",
    delay: str = "10 minutes",
) -> DataFrame:
    """Held batches as a stream, emitted once when the severity's window has passed: by a later
    failure of the rule or by the watermark. Columns as in ``_BATCH``, times in microseconds. Rows later
    than the watermark are left out."""
    rows = failures(stream).select(
        F.col(row_id).cast("long").alias("row_id"), "rule_id", "severity",
        micros(F.col(time)).alias("us"),
        (severity_minutes(F.col("severity")).cast("long") * MINUTE_US).alias("window_us"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"),
    )
    dealt = rows.withColumn("bucket", bucket_of("rule_id"))
    packs = packed(dealt, ["bucket"], [], ["rule_id", "us", "row_id", "value", "severity", "window_us"]).withWatermark("last_at", delay)
    return packs.groupBy("bucket").applyInPandasWithState(
        _held_rows,
        "rule_id long, severity string, first_us long, last_us long, occurrences long, "
        "violation_total double",
        "rules array<long>, severities array<string>, windows array<long>, firsts array<long>, lasts array<long>, "
        "ns array<long>, totals array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_alert_context(
    stream: DataFrame,
    window: str,
    slide: str,
    time: str = "executed_at",
    value: str = "observed_value",
    delay: str = "1 hour",
) -> DataFrame:
    """Failures and their value total per rule and sliding window."""
    return (
        failures(stream)
        .withWatermark(time, delay)
        .groupBy("rule_id", F.window(time, window, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("failure_count"),
            F.sum(F.coalesce(F.col(value).cast("decimal(28,6)"), F.lit(0))).alias("observed_total"),
        )
        .select(
            "rule_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "failure_count", "observed_total",
        )
    )
