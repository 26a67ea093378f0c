"""Order-dependent building blocks that stay parallel when one key holds most of the rows.

* ``running_total``: a running sum per key, cut into ranges of rows so that no task sees a whole key.
* ``order_statistics``: exact values at given ranks, found by narrowing histograms.
* ``anchors``: the walk "keep a row only if it is more than W after the last kept row".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def deal_in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``_part``: the number of the range of *columns* that a row is in, ranges of about equal rows.

    Written to the shared folder, because range bounds come from a sample and must be the same for
    every reader.
    """
    return settle(rows.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "ranges")


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    amounts: dict[str, str],
    peers: bool = False,
) -> DataFrame:
    """Add ``{out: running sum of column}`` per key, rows ordered by *order*.

    Rows are dealt out in ranges of (keys, order) of about equal size, so a key is split by its rows
    however its order values are spread; each range adds the total of the key's earlier ranges. Without
    *peers* the order should be unique, as equal rows stay in one range. With *peers* equal rows
    share the value after the last of them: they are summed to one row before they are dealt out.
    Amounts are not NULL.
    """
    spots = [f"_o{i}" for i in range(len(order))]
    placed = df.select("*", *[column.alias(spot) for column, spot in zip(order, spots)])
    rows = placed
    if peers:
        rows = placed.groupBy(*keys, *spots).agg(*[F.sum(source).alias(source) for source in set(amounts.values())])
    # one struct as grouping key: it is never NULL itself, so the plain equality join below keeps
    # NULL keys and shares the window's partitioning (one shuffle of the rows)
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    grouped = deal_in_order(rows, [*keys, *spots]).withColumn("_group", F.struct(*named, F.col("_part").alias("part")))
    totals = grouped.groupBy("_group").agg(
        *[F.sum(source).alias(f"_total_{out}") for out, source in amounts.items()]
    )
    earlier = (
        Window.partitionBy(*[f"_group.k{i}" for i in range(len(keys))])
        .orderBy("_group.part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        "_group", *[F.sum(f"_total_{out}").over(earlier).alias(f"_before_{out}") for out in amounts]
    )
    inside = Window.partitionBy("_group").orderBy(*spots).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = [
        (F.sum(source).over(inside) + F.coalesce(F.col(f"_before_{out}"), F.col(source) * 0)).alias(out)
        for out, source in amounts.items()
    ]
    others = [F.col(name) for name in df.columns if name not in amounts]
    summed = grouped.join(offsets, "_group", "left")
    if not peers:
        return summed.select(*others, *sums)
    spot = F.struct(*named, *[F.col(s) for s in spots]).alias("_spot")
    return placed.select(*others, spot).join(summed.select(spot, *sums), "_spot").drop("_spot")


@dataclass(frozen=True)
class Rank:
    """The value wanted at a 0-based rank of a column, known to lie in [low, high].

    *below* rows are smaller than *low*; *inside* rows are in the range.
    """

    column: str
    stat: str
    rank: int
    low: Any
    high: Any
    inside: int
    below: int = 0


LAST_STEP_ROWS = 200_000
BUCKETS = 1024
_FINITE = 8e307  # bucket bounds stay finite and their difference does too


Range = tuple[str, Any, Any, int]  # column, low, high, below


def _ranges(wanted: list[Rank]) -> dict[Range, list[Rank]]:
    """Ranks that share a range are found together, so a row is never counted twice for them."""
    shared: dict[Range, list[Rank]] = {}
    for w in wanted:
        shared.setdefault((w.column, w.low, w.high, w.below), []).append(w)
    return shared


def _in_ranges(rows: DataFrame, ranges: list[Range]) -> DataFrame:
    kind = rows.schema["value"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(
        [(i, column, low, high) for i, (column, low, high, _) in enumerate(ranges)],
        f"range int, column_name string, low {kind}, high {kind}",
    )
    reach = F.col("value").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(table), "column_name").filter(reach)


def _at_ranks(counts: DataFrame, order: str, shared: dict[Range, list[Rank]]) -> list:
    """Of counts per (range, *order*), the ones that hold a wanted rank."""
    table = counts.sparkSession.createDataFrame(
        [
            (i, w.stat, w.rank - below)
            for i, ((_, _, _, below), ranks) in enumerate(shared.items())
            for w in ranks
        ],
        "range int, stat string, place long",
    )
    upto = F.sum("size").over(
        Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    place = F.col("place")
    return (
        counts.withColumn("upto", upto)
        .join(F.broadcast(table), "range")
        .filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("size")))
        .collect()
    )


def _narrow(rows: DataFrame, wanted: list[Rank]) -> list[Rank]:
    """Replace each range by the one of its equal-width buckets that holds the rank."""
    shared = _ranges(wanted)
    ranges = list(shared)
    bound = lambda name: F.greatest(
        F.lit(-_FINITE), F.least(F.lit(_FINITE), F.col(name).cast("double"))
    )
    bucket = F.coalesce(
        F.width_bucket(F.col("value").cast("double"), bound("low"), bound("high"), F.lit(BUCKETS)),
        F.lit(1).cast("long"),
    )
    counts = _in_ranges(rows, ranges).groupBy("range", bucket.alias("bucket")).agg(
        F.sum("n").alias("size"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    narrowed = []
    for r in _at_ranks(counts, "bucket", shared):
        column, _, _, below = ranges[r["range"]]
        narrowed.append(Rank(
            column, r["stat"], r["place"] + below, r["low"], r["high"], r["size"],
            below + r["upto"] - r["size"],
        ))
    return narrowed


def order_statistics(
    rows: DataFrame, wanted: list[Rank], last_step_rows: int = LAST_STEP_ROWS
) -> dict[tuple[str, str], Any]:
    """The exact value at each wanted rank, as {(column, stat): value}.

    *rows* has (column_name, value, n), n being how often the row counts. While a range holds more
    than *last_step_rows* rows, one pass counts it in equal-width buckets and keeps the bucket
    with the rank: tasks send at most BUCKETS counts per range, and values themselves are never
    shuffled. Only the last, small range is put in order. What reaches the driver is one row per
    wanted value.
    """
    found: dict[tuple[str, str], Any] = {}
    while True:
        for w in wanted:
            if w.low == w.high:
                found[w.column, w.stat] = w.low
        wanted = [w for w in wanted if w.low != w.high]
        wide = [w for w in wanted if w.inside > last_step_rows]
        if not wide:
            break
        narrowed = _narrow(rows, wide)
        before = {(w.column, w.stat): (w.low, w.high) for w in wide}
        stuck = all(before[w.column, w.stat] == (w.low, w.high) for w in narrowed)
        wanted = [w for w in wanted if w not in wide] + narrowed
        if stuck:
            break  # values too close together to be split further
    if wanted:
        shared = _ranges(wanted)
        ranges = list(shared)
        counts = _in_ranges(rows, ranges).groupBy("range", "value").agg(F.sum("n").alias("size"))
        for r in _at_ranks(counts, "value", shared):
            found[ranges[r["range"]][0], r["stat"]] = r["value"]
    return found


# --- anchored walk ---------------------------------------------------------------------------
#
# A row is an anchor when its time is more than W after the last anchor of its key; the first row is one. Every row has
# a successor, the first row more than W after it, and the anchors are what is reached from the first row by
# successors. A key of up to `limit` rows is walked in one task. A larger key is cut into ranges of rows:
#   1. inside a range, every row is followed by its successors to the last one; that one's time plus W is where the row
#      leaves the range,
#   2. an as-of merge finds the row at which each such value enters a later range,
#   3. pointer doubling over these jumps marks the entries that are reached from the key's first row: a jump ends in a
#      later range, so the rounds are the logarithm of the number of ranges,
#   4. each range is walked from its entry.

#: Rows of one key that a single task walks; ranges of larger keys have about as many.
WALK_ROWS = 200_000


def _segments(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys in a sorted frame."""
    if not len(frame):
        return
    change = np.zeros(len(frame), dtype=bool)
    for name in names:
        column = frame[name].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change)])
    ends = np.append(starts[1:], len(frame))
    yield from zip(starts.tolist(), ends.tolist())


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of the anchors in rows sorted by (_key, _t); what is kept between batches is one key and one time."""
    current, until = None, 0
    for frame in batches:
        keys, times, ids, windows = (frame[c].to_numpy() for c in ("_key", "_t", "_id", "_window"))
        picked = []
        for start, end in _segments(frame, ["_key"]):
            index, window = start, int(windows[start])
            if keys[start] != current:
                current, until = keys[start], int(times[start]) + window
                picked.append(start)
            while True:
                index += int(np.searchsorted(times[index:end], until, side="right"))
                if index >= end:
                    break
                picked.append(index)
                until = int(times[index]) + window
        yield pd.DataFrame({"_id": ids[picked]})


def last_successors(times: np.ndarray, window: int) -> np.ndarray:
    """For each of the sorted, distinct times the place of the last one reached by successors."""
    after = np.searchsorted(times, times + window, side="right")
    reached = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = reached[reached]
        if np.array_equal(further, reached):
            return reached
        reached = further


def _leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range, sorted by (_key, _t), with ``_until``: where the row's walk leaves the range."""
    parts = list(batches)  # one range, of about WALK_ROWS rows
    if not parts:
        return
    frame = pd.concat(parts, ignore_index=True)
    until = np.empty(len(frame), dtype=np.int64)
    times, windows = frame["_t"].to_numpy(), frame["_window"].to_numpy()
    for start, end in _segments(frame, ["_key"]):
        window = int(windows[start])
        until[start:end] = times[start:end][last_successors(times[start:end], window)] + window
    yield frame.assign(_until=until)


_WALK_KIND = "_id long"


def _walk_ranges(rows: DataFrame, limit: int) -> DataFrame:
    """Anchors of keys that are larger than a task, by the steps above."""
    ranges = max(1, -(-rows.count() // limit))
    placed = rows.repartitionByRange(ranges, "_key", "_t").sortWithinPartitions("_key", "_t").withColumn(
        "_part", F.spark_partition_id())
    left = settle(placed.mapInPandas(_leave, f"{_KIND}, _part int, _until long"), "ranges")

    # Rows and the values that leave a range, in one order: a value is followed by the row at which it enters.
    nothing = F.lit(0).cast("long")
    both = left.select("_key", F.col("_t").alias("_us"), nothing.alias("_side"), F.lit(1).cast("long").alias("_n")).unionByName(
        left.select("_key", F.col("_until").alias("_us"), (nothing + 1).alias("_side"), nothing.alias("_n")).distinct())
    counted = settle(running_total(both, ["_key"], [F.col("_us"), F.col("_side")], {"_rank": "_n"}), "ranks")
    ranked = counted.filter("_side = 0").select("_key", F.col("_us").alias("_t"), "_rank")
    entered = counted.filter("_side = 1").select("_key", F.col("_us").alias("_until"), (F.col("_rank") + 1).alias("_next"))
    nodes = settle(left.join(ranked, ["_key", "_t"]).select("_key", "_rank", "_part", "_t", "_until"), "nodes")
    targets = entered.select("_key", F.col("_next").alias("_rank")).union(
        nodes.filter("_rank = 1").select("_key", "_rank")).distinct()
    jumps = nodes.join(targets, ["_key", "_rank"]).join(entered, ["_key", "_until"]).select("_key", "_rank", "_next")
    ends = jumps.select("_key", F.col("_rank").alias("_next"))
    jumps = settle(jumps.join(ends, ["_key", "_next"], "left_semi").select("_key", "_rank", "_next"), "jumps")
    reached = nodes.filter("_rank = 1").select("_key", "_rank")
    for turn in range(max(1, ranges.bit_length())):
        ahead = reached.join(jumps, ["_key", "_rank"]).select("_key", F.col("_next").alias("_rank"))
        reached = settle(reached.unionByName(ahead).distinct(), "reached")
        far = jumps.select("_key", F.col("_rank").alias("_next"), F.col("_next").alias("_far"))
        jumps = settle(jumps.join(far, ["_key", "_next"]).select("_key", "_rank", F.col("_far").alias("_next")), "jumps")

    entry = nodes.join(reached, ["_key", "_rank"]).groupBy("_key", "_part").agg(F.min("_t").alias("_entry"))
    inside = left.join(entry, ["_key", "_part"]).filter("_t >= _entry").select(
        F.concat_ws(":", "_part", "_key").alias("_key"), "_t", "_id", "_window", "_part")
    return inside.repartition("_part").sortWithinPartitions("_part", "_key", "_t").drop("_part").mapInPandas(_walk, _WALK_KIND)


_KIND = "_key string, _t long, _id long, _window long"


def anchors(
    df: DataFrame,
    key: Column,
    time_us: Column,
    row_id: Column,
    window_us: Column,
    inclusive: bool = False,
    limit: int = WALK_ROWS,
) -> DataFrame:
    """Ids of the anchor rows, as one column ``_id``.

    *row_id* is a unique long; it also breaks ties in time. A row exactly *window_us* after its
    anchor is a duplicate, or with *inclusive* an anchor itself. A window of zero or less makes
    every row an anchor; otherwise it must be the same for all rows of a key. No task reads more than
    about *limit* rows of one key, whatever its window.
    """
    thin = df.select(
        key.cast("string").alias("_key"), time_us.alias("_t"), row_id.cast("long").alias("_id"),
        window_us.cast("long").alias("_window"),
    )
    free = thin.filter(F.col("_window") <= 0).select("_id")
    # rows of one instant can hold only one anchor: the first
    rows = (
        thin.filter(F.col("_window") > 0)
        .groupBy("_key", "_t")
        .agg(F.min("_id").alias("_id"), F.max("_window").alias("_window"))
    )
    if inclusive:
        rows = rows.withColumn("_window", F.col("_window") - 1)
    rows = settle(rows, "instants")
    large = settle(rows.groupBy("_key").count().filter(F.col("count") > limit).select("_key"), "large")  # at most rows / limit
    if large.isEmpty():
        return rows.repartition("_key").sortWithinPartitions("_key", "_t").mapInPandas(_walk, _WALK_KIND).unionByName(free)
    small = rows.join(large, "_key", "left_anti").repartition("_key").sortWithinPartitions("_key", "_t").mapInPandas(
        _walk, _WALK_KIND)
    return small.unionByName(_walk_ranges(rows.join(large, "_key", "left_semi"), limit)).unionByName(free)
