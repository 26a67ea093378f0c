import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import violations as V
from plumbline.session import settle
from plumbline.streaming import violations as SV

START = datetime(2024, 1, 1)
SCHEMA = (
    "result_id long, rule_id long, status string, severity string, observed_value decimal(18,2), "
    "executed_at timestamp, fingerprint string, deduplication_window_minutes int"
)


def history(seed=1, size=400):
    rnd = random.Random(seed)
    severities = ["critical", "high", "medium", "low"]
    rows = []
    for i in range(size):
        rule = rnd.choice([1, 1, 1, 2, 3, 4])
        value = None if rnd.random() < 0.3 else Decimal(rnd.randrange(500)) / 4
        rows.append((
            i, rule, rnd.choice(["FAIL", "ERROR"]), severities[rule - 1], value,
            START + timedelta(seconds=rnd.randrange(200_000)), rnd.choice(["p", "q"]), [5, 30, 0, 600][rule - 1],
        ))
    return rows


@pytest.fixture(scope="module")
def rows():
    return history()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def replay(rows):
    """The reference semantics, one failure after the other."""
    recorded, number, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        window = timedelta(minutes=r[7])
        last = recorded.get((r[1], r[6]))
        new = r[7] <= 0 or last is None or last < r[5] - window
        if new:
            recorded[r[1], r[6]] = r[5]
            number[r[1]] = number.get(r[1], 0) + 1
        out[r[0]] = (new, number[r[1]])
    return out


@pytest.fixture(scope="module")
def events(df):
    return settle(V.assign_batches(settle(V.dedup(df))))


def test_dedup_and_batches(rows, events):
    got = {r["result_id"]: (r["is_new"], r["batch_no"]) for r in events.collect()}
    assert got == replay(rows)


def test_batch_totals(rows, events):
    expected = {}
    numbered = replay(rows)
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        key = (r[1], numbered[r[0]][1])
        if key not in expected:
            expected[key] = [r[5], r[5], 1, r[4]]
        else:
            entry = expected[key]
            entry[1], entry[2] = r[5], entry[2] + 1
            entry[3] = (entry[3] or 0) + (r[4] or 0)
    got = {
        (r["rule_id"], r["batch_no"]): [r["first_seen"], r["last_seen"], r["total_occurrences"], r["total_violation_count"]]
        for r in V.batch_summary(events).collect()
    }
    assert got == expected


def test_held_batches(rows, df):
    minutes = V.SEVERITY_MINUTES
    opened, expected = {}, set()
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if r[1] not in opened or r[5] - opened[r[1]] >= timedelta(minutes=minutes[r[3]]):
            opened[r[1]] = r[5]
            expected.add(r[0])
    assert {r["result_id"] for r in V.hold_batches(df).filter("is_new").collect()} == expected


def test_alert_context(rows, df):
    got = {r["result_id"]: (r["recent_failure_count"], r["recent_observed_total"]) for r in V.alert_context(df).collect()}
    for r in rows:
        window = [
            o for o in rows
            if o[1] == r[1] and r[5] - timedelta(minutes=max(0, r[7])) <= o[5] <= r[5]
        ]
        assert got[r[0]] == (len(window), sum((o[4] or 0) for o in window)), r


def test_attach_to_batches(spark, rows, events):
    rnd = random.Random(9)
    probes = [(i, rnd.choice([1, 2, 9]), START + timedelta(seconds=rnd.randrange(200_000))) for i in range(100)]
    numbered = replay(rows)
    expected = {}
    for i, rule, at in probes:
        opened = [numbered[r[0]][1] for r in rows if r[1] == rule and numbered[r[0]][0] and r[5] <= at]
        if opened:
            expected[i] = max(opened)
    asked = spark.createDataFrame(probes, "id long, rule_id long, at timestamp")
    got = {r["id"]: r["batch_no"] for r in V.attach_to_batches(events, asked, "at", "id").collect()}
    assert got == expected


def test_one_sweep_numbers_all_tables(spark, rows, df, events):
    recorded = settle(V.dedup(df))
    rnd = random.Random(12)
    schema = "id long, rule_id long, at timestamp"
    tables = {name: spark.createDataFrame(
        [(i, rnd.choice([1, 2, 3, 4, 77]), START + timedelta(seconds=rnd.randrange(-5000, 200_000))) for i in range(120)], schema)
        for name in ("sent", "notes")}
    numbered = V.number_rows(recorded, {name: (table, "at", "id") for name, table in tables.items()})
    assert numbered["events"].columns == events.columns
    assert {r["result_id"]: r["batch_no"] for r in numbered["events"].collect()} == {r["result_id"]: r["batch_no"] for r in events.collect()}
    for name, table in tables.items():
        expected = {r["id"]: r["batch_no"] for r in V.attach_to_batches(recorded, table, "at", "id").collect()}
        assert {r["id"]: r["batch_no"] for r in numbered[name].collect()} == expected
        some = V.in_some_batch(recorded, table, "at")
        assert some.columns and {r["id"] for r in some.collect()} == set(expected)


def test_context_has_the_totals_of_its_batch(events):
    full = V.with_batch_totals(V.alert_context(events), events)
    sums = {(r["rule_id"], r["batch_no"]): r for r in V.batch_summary(events).collect()}
    found = full.collect()
    assert len(found) == events.count()
    for r in found:
        batch = sums[r["rule_id"], r["batch_no"]]
        assert (r["batch_occurrences"], r["batch_violation_count"]) == (batch["total_occurrences"], batch["total_violation_count"])
        assert batch["first_seen"] <= r["window_ended_at"] <= batch["last_seen"] and r["window_started_at"] <= r["window_ended_at"]


def test_failures_policy_and_severity(spark):
    results = spark.createDataFrame(
        [(1, 1, "FAIL"), (2, None, "FAIL"), (3, 2, "ERROR"), (4, 1, "PASS")], "result_id long, rule_id long, status string")
    rules = spark.createDataFrame([(1, "low")], "rule_id long, severity string")
    policies = spark.createDataFrame([(1, 90, None)], "rule_id long, deduplication_window_minutes int, slack_enabled boolean")
    ready = V.with_policy(V.with_severity(V.failures(results), rules), policies)
    got = {r["result_id"]: (r["severity"], r["deduplication_window_minutes"], r["slack_enabled"]) for r in ready.collect()}
    assert got == {1: ("low", 90, True), 3: ("medium", 5, True)}


def test_fingerprint_ignores_key_order(spark):
    df = spark.sql(
        "SELECT array(map('a', '1', 'b', '2')) x, array(map('b', '2', 'a', '1')) y, array(map('a', '1')) z, "
        "CAST(array() AS array<map<string,string>>) e")
    prints = df.select(*[V.fingerprint(F.lit(1), F.lit("FAIL"), F.col(c)) for c in "xyze"]).first()
    assert prints[0] == prints[1] != prints[2]
    assert prints[3] == df.select(V.fingerprint(F.lit(1), F.lit("FAIL"))).first()[0]


def test_channels_status_and_outcome(spark):
    batches = spark.createDataFrame(
        [(1, 1, START, ["email", "email"]), (2, 1, START, None), (3, 1, START, ["slack"]), (4, 1, START, ["slack"])],
        "rule_id long, batch_no long, first_seen timestamp, channels array<string>")
    later, earlier = START + timedelta(hours=1), START - timedelta(hours=1)
    deliveries = spark.createDataFrame(
        [(1, 1, "email", "failed", later), (2, 1, "slack", "sent", later), (3, 1, "slack", "sent", earlier)],
        "rule_id long, batch_no long, channel string, status string, sent_at timestamp")
    missing = {(r["rule_id"], r["channel"]) for r in V.missing_channels(batches, deliveries, "channels").collect()}
    assert missing == {(1, "email"), (2, "email"), (3, "slack"), (4, "slack")}
    rules = spark.createDataFrame([(1,), (2,), (3,)], "rule_id long")
    status = {r["rule_id"]: r["status"] for r in V.batch_status(batches, deliveries.filter("rule_id < 3"), rules).collect()}
    assert status == {1: "failed", 2: "dispatched", 3: "open", 4: "resolved"}


def test_due_batches(spark):
    rows = [(1, "critical", 0), (2, "high", 14), (3, "high", 15), (4, "low", 359), (5, "odd", 60)]
    batches = spark.createDataFrame(
        [(i, s, START - timedelta(minutes=m)) for i, s, m in rows], "rule_id long, severity string, first_seen timestamp")
    due = V.due_batches(batches, F.lit(START).cast("timestamp"))
    assert sorted(r["rule_id"] for r in due.collect()) == [1, 3, 5]


def stream_of(spark, tmp_path, rows, files=4):
    """The rows in time order, a few per file and so per micro-batch."""
    ordered = sorted(rows, key=lambda r: (r[5], r[0]))
    size = -(-len(ordered) // files)
    for i in range(files):
        part = spark.createDataFrame(ordered[i * size:(i + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_stream_dedup_equals_batch(spark, rows, tmp_path):
    got = drain(spark, SV.stream_dedup(stream_of(spark, tmp_path, rows)), tmp_path)
    expected = {i: new for i, (new, _) in replay(rows).items()}
    assert {r["row_id"]: r["is_new"] for r in got.collect()} == expected


def test_dedup_state_ends_with_its_window(spark, rows, tmp_path):
    """A far later row moves the watermark past all windows: no key but its own keeps state, and late rows are left out."""
    far = [(9000 + i, 99, "FAIL", "critical", None, START + timedelta(days=30 + i), "p", 5) for i in range(3)]
    stream = SV.stream_dedup(stream_of(spark, tmp_path, rows + far[:1], files=5))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) > 3 and totals[-1] <= 1
    late = [(9500, 1, "FAIL", "critical", None, START, "p", 5)]
    spark.createDataFrame(late + far[1:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(spark, SV.stream_dedup(spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(tmp_path / "in"))), tmp_path)
    got = {r["row_id"]: r["is_new"] for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    expected = {i: new for i, (new, _) in replay(rows).items()}
    assert got == expected | {9000: True, 9001: True, 9002: True}


def test_a_hot_key_reaches_its_state_as_a_row_per_task(spark):
    hot = [(i, 1, "p", i * 1000, 5) for i in range(900)] + [(1000 + i, 2 + i % 3, "q", i, 5) for i in range(100)]
    df = spark.createDataFrame(hot, "row_id long, rule_id long, fingerprint string, us long, window_us long").repartition(3)
    packs = SV.packed(df, ["rule_id", "fingerprint"], ["window_us"], ["us", "row_id"]).collect()
    mine = [p for p in packs if p["rule_id"] == 1]
    assert len(mine) == 3 and sum(len(p["us"]) for p in mine) == 900
    assert all(p["us"] == sorted(p["us"]) and p["last_at"].timestamp() >= 0 for p in mine)


def test_stream_batches_equal_batch(spark, rows, df, tmp_path):
    held = settle(V.hold_batches(df))
    expected = {
        (r["rule_id"], r["first_seen"], r["total_occurrences"]) for r in V.batch_summary(V.assign_batches(held)).collect()
    }
    # a far later row pushes the watermark over the ends of all windows
    end = (9999, 99, "FAIL", "critical", None, START + timedelta(days=30), "p", 5)
    got = drain(spark, SV.stream_batches(stream_of(spark, tmp_path, rows + [end])), tmp_path)
    found = {
        (r["rule_id"], datetime(1970, 1, 1) + timedelta(microseconds=r["first_us"]), r["occurrences"])
        for r in got.collect() if r["rule_id"] != 99
    }
    assert found == expected


def test_streams_keep_state_by_buckets_of_keys(spark, tmp_path):
    """Many keys and a hot one: state has a row per bucket, results are those of single keys."""
    many = [(i, 100 + i % 2500, "FAIL", ("high", "low")[i % 2], Decimal(i % 7), START + timedelta(seconds=97 * (i // 2500)), "pq"[i % 2], 5) for i in range(10_000)]
    many += [(20_000 + i, 1, "FAIL", "high", Decimal(1), START + timedelta(seconds=i), "p", 2) for i in range(400)]
    stream = SV.stream_dedup(stream_of(spark, tmp_path, many, files=3))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 500 < max(totals) <= 1024
    got = {r["row_id"]: r["is_new"] for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {i: new for i, (new, _) in replay(many).items()}

    end = (99_999, 99, "FAIL", "critical", None, START + timedelta(days=30), "p", 5)
    (tmp_path / "held").mkdir()
    held = drain(spark, SV.stream_batches(stream_of(spark, tmp_path / "held", many + [end], files=3)), tmp_path / "held")
    batches = V.batch_summary(V.assign_batches(settle(V.hold_batches(spark.createDataFrame(many, SCHEMA)))))
    expected = sorted((r["rule_id"], r["total_occurrences"], float(r["total_violation_count"])) for r in batches.collect())
    assert sorted((r["rule_id"], r["occurrences"], r["violation_total"]) for r in held.collect() if r["rule_id"] != 99) == expected
