"""The order-dependent helpers against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering
from plumbline.operators.ordering import Rank, anchors, deal_in_order, last_successors, order_statistics, running_total
from plumbline.session import settle


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sequential_anchors(rows, inclusive):
    kept, last = set(), {}
    for row_id, key, time, window in sorted(rows, key=lambda r: (r[2], r[0])):
        anchor = last.get(key)
        if (
            window <= 0
            or anchor is None
            or (time >= anchor + window if inclusive else time > anchor + window)
        ):
            kept.add(row_id)
            last[key] = time
    return kept


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize(
    "size, span, window, limit",
    [(2000, 20_000, 100, 90), (2000, 3_000, 40, 10_000), (1500, 100_000, 7, 300), (500, 400, 0, 8), (900, 5_000, 1, 100),
     (900, 5_000, 4_000, 60), (900, 5_000, 9_000, 60)],
)
def test_anchors_match_the_sequential_walk(spark, size, span, window, limit, inclusive):
    rnd = random.Random(size + span)
    # half of all rows share one key
    rows = [(i, rnd.choice("aaabcd"), rnd.randrange(span), window) for i in range(size)]
    df = spark.createDataFrame(rows, "id long, k string, t long, w long")
    found = anchors(
        df, F.col("k"), F.col("t"), F.col("id"), F.col("w"), inclusive, limit=limit
    )
    assert {r[0] for r in found.collect()} == sequential_anchors(rows, inclusive)


def test_anchors_when_walks_never_meet(spark):
    # one row per tick: walks with different starts stay apart over many chunks
    rows = [(i, "k", i, 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, t long, w long")
    found = anchors(df, F.col("k"), F.col("t"), F.col("id"), F.col("w"), limit=200)
    assert {r[0] for r in found.collect()} == set(range(0, 3000, 11))


def test_anchors_with_windows_longer_than_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rnd = random.Random(3)
        rows = [(i, "hot", rnd.randrange(50_000), 700) for i in range(4000)]
        df = spark.createDataFrame(rows, "id long, k string, t long, w long")
        found = anchors(df, F.col("k"), F.col("t"), F.col("id"), F.col("w"), limit=500)
        assert {r[0] for r in found.collect()} == sequential_anchors(rows, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_task_reads_a_hot_key_whose_window_is_longer_than_its_history(many_ranges, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", rnd.randrange(10 ** 6), 10 ** 7 if i % 3 == 0 else 50) for i in range(3000)]
    df = many_ranges.createDataFrame(rows, "id long, k string, t long, w long")
    settled = {}
    monkeypatch.setattr(ordering, "settle", lambda frame, label="step": settled.setdefault(f"{label}-{len(settled)}", settle(frame, label)))
    found = anchors(df, F.col("k"), F.col("t"), F.col("id"), F.col("w"), limit=100)
    assert {r[0] for r in found.collect()} == sequential_anchors(rows, False)
    ranges = next(frame for name, frame in settled.items() if name.startswith("ranges") and "_until" in frame.columns)
    sizes = [r["count"] for r in ranges.groupBy("_part").count().collect()]
    assert sum(sizes) >= 990 and len(sizes) > 5 and max(sizes) <= 250


def test_last_successors():
    times = np.array([0, 1, 5, 6, 11, 12, 30])
    assert last_successors(times, 5).tolist() == [6, 6, 6, 6, 6, 6, 6]
    assert last_successors(times, 100).tolist() == list(range(7))
    assert last_successors(np.arange(10), 3).tolist() == [8, 9, 6, 7, 8, 9, 6, 7, 8, 9]


def test_running_total_over_chunks(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("aab"), rnd.randrange(1000), rnd.randrange(5)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, t long, n long")
    got = running_total(df, ["k"], [F.col("t"), F.col("id")], {"total": "n"})
    expected, sums = {}, {}
    for row_id, key, _, n in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[key] = sums.get(key, 0) + n
        expected[row_id] = sums[key]
    assert {r["id"]: r["total"] for r in got.collect()} == expected


@pytest.mark.parametrize("peers", [False, True])
def test_running_total_with_half_of_the_rows_at_one_time(many_ranges, peers):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "a", None]), 500 if i % 2 else rnd.randrange(1000), rnd.randrange(5)) for i in range(800)]
    df = many_ranges.createDataFrame(rows, "id long, k string, t long, n long")
    order = [F.col("t")] if peers else [F.col("t"), F.col("id")]
    got = running_total(df, ["k"], order, {"total": "n"}, peers=peers)
    place = (lambda r: r[2]) if peers else (lambda r: (r[2], r[0]))
    expected = {r[0]: sum(o[3] for o in rows if o[1] == r[1] and place(o) <= place(r)) for r in rows}
    assert got.columns == ["id", "k", "t", "n", "total"]
    assert {r["id"]: r["total"] for r in got.collect()} == expected


def test_ranges_split_a_key_whose_rows_have_one_time(many_ranges):
    rows = [(i, "hot" if i % 3 else f"k{i}", 7) for i in range(900)]
    df = many_ranges.createDataFrame(rows, "id long, k string, t long")
    parts = deal_in_order(df, ["k", "t", "id"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 300


def test_running_total_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(1, None, 0, 1), (2, None, 900, 1), (3, "a", 5, 1)], "id long, k string, t long, n long")
    got = running_total(df, ["k"], [F.col("t")], {"total": "n"})
    assert {r["id"]: r["total"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("last_step", [5, 200_000])
def test_order_statistics_are_exact(spark, last_step):
    rng = np.random.default_rng(1)
    columns = {
        "even": rng.uniform(0, 1, 999),
        "heavy": np.concatenate([rng.normal(0, 1, 900), [1e300, -1e300, 1e12]]),
        "flat": np.concatenate([np.full(600, 7.0), rng.normal(7, 1e-9, 200)]),
        "one": np.array([3.5]),
        "unbounded": np.array([float("-inf"), 1.0, 2.0, float("inf"), 3.0]),
    }
    rows = [(name, float(v), 1) for name, values in columns.items() for v in values]
    df = spark.createDataFrame(rows, "column_name string, value double, n int")
    wanted = [
        Rank(name, str(rank), rank, float(min(v)), float(max(v)), len(v))
        for name, v in columns.items()
        for rank in sorted({0, len(v) // 3, len(v) // 2, len(v) - 1})
    ]
    found = order_statistics(df, wanted, last_step_rows=last_step)
    for w in wanted:
        assert found[w.column, w.stat] == sorted(columns[w.column])[w.rank], (w.column, w.rank)
