"""Anomalies in numeric columns.

Results are long: one row per flagged (row, column). Nothing is sorted globally: both methods
reduce to limits per column, and flagging is then a filter next to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import Rank, order_statistics
from plumbline.operators.profile import moments, numeric_columns, numeric_long, spans_of

MIN_VALUES = 10
SAMPLE = 50
DEFAULT_CONTAMINATION = 0.05

# Accepted method names; two of them are the same tail mask.
TAIL_NAMES = ("tail", "isolation_forest", "lof")


class AnomalyError(ValueError):
    pass


def eligibility(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n, status): EMPTY, INSUFFICIENT_DATA or OK."""
    columns = columns or numeric_columns(df)
    n = F.col("n")
    status = (
        F.when(n == 0, "EMPTY").when(n < MIN_VALUES, "INSUFFICIENT_DATA").otherwise("OK")
    )
    return moments(df, columns).select("column_name", "n", status.alias("status"))


def _zscore(df: DataFrame, key: str, columns: list[str], threshold: float) -> DataFrame:
    stats = moments(df, columns).filter(F.col("n") >= MIN_VALUES)
    score = F.abs((F.col("value") - F.col("mean")) / F.col("std_pop"))
    return (
        numeric_long(df, columns, [F.col(key).alias("row_key")])
        .join(F.broadcast(stats.select("column_name", "mean", "std_pop")), "column_name")
        .filter(F.col("std_pop") != 0)
        .withColumn("score", score)
        .filter(F.col("score") > threshold)
        .select("row_key", "column_name", "value", "score")
    )


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows per column, known on the driver, ready to be broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _tail(df: DataFrame, key: str, columns: list[str], contamination: float) -> DataFrame:
    share = min(max(float(contamination), 0.0), 0.5)
    rows = numeric_long(df, columns, [F.col(key).alias("row_key")])
    spans = {
        name: span for name, span in spans_of(moments(df, columns)).items() if span[0] >= MIN_VALUES
    }
    # round() takes halves to the even number
    sizes = {name: max(1, round(n * share)) for name, (n, _, _) in spans.items()} if share > 0 else {}
    values = rows.select("column_name", "value", F.lit(1).alias("n"))

    wanted = []
    for name in sizes:
        n, low, high = spans[name]
        wanted.append(Rank(name, "low", (n - 1) // 2, low, high, n))
        wanted.append(Rank(name, "high", n // 2, low, high, n))
    found = order_statistics(values, wanted)
    medians = {name: (found[name, "low"] + found[name, "high"]) / 2 for name in sizes}

    score = F.abs(F.col("value") - F.col("median"))
    middle = _local(df, list(medians.items()), "column_name string, median double")
    distances = rows.join(middle, "column_name").select(
        "column_name", score.alias("value"), F.lit(1).alias("n")
    )
    wanted = []
    for name, k in sizes.items():
        n, low, high = spans[name]
        farthest = max(abs(low - medians[name]), abs(high - medians[name]))
        wanted.append(Rank(name, "cut", n - k, 0.0, farthest, n))
    cuts = {name: cut for (name, _), cut in order_statistics(distances, wanted).items()}

    # rows beyond the cut are all in; of the rows at the cut only the first by key
    limits = [(name, medians[name], cuts[name]) for name in sizes]
    scored = rows.join(
        _local(df, limits, "column_name string, median double, cut double"), "column_name"
    ).withColumn("score", score)
    at_cut = F.col("score") == F.col("cut")
    counts = scored.filter(F.col("score") >= F.col("cut")).groupBy("column_name").agg(
        F.count_if(at_cut).alias("ties"),
        F.count_if(~at_cut).alias("beyond"),
        F.min(F.when(at_cut, F.col("row_key"))).alias("low"),
        F.max(F.when(at_cut, F.col("row_key"))).alias("high"),
    ).collect()
    crowded = [
        Rank(r["column_name"], "key", sizes[r["column_name"]] - r["beyond"] - 1, r["low"], r["high"], r["ties"])
        for r in counts
        if sizes[r["column_name"]] - r["beyond"] < r["ties"]
    ]
    keys = scored.filter(at_cut).select("column_name", F.col("row_key").alias("value"), F.lit(1).alias("n"))
    last = {name: value for (name, _), value in order_statistics(keys, crowded).items()}
    key_type = df.schema[key].dataType.simpleString()
    last_keys = _local(df, list(last.items()), f"column_name string, last_key {key_type}")
    within = F.col("last_key").isNull() | (F.col("row_key") <= F.col("last_key"))
    return (
        scored.join(last_keys, "column_name", "left")
        .filter((F.col("score") > F.col("cut")) | (at_cut & within))
        .select("row_key", "column_name", "value", "score")
    )


def anomalies(
    df: DataFrame,
    key: str,
    columns: list[str] | str | None = None,
    method: str = "tail",
    threshold: float = 3.0,
    contamination: float = DEFAULT_CONTAMINATION,
) -> DataFrame:
    """Flagged rows as (row_key, column_name, value, score).

    ``zscore``: more than *threshold* population deviations from the mean. ``tail`` (also under
    its two older names): the round-half-even(n * contamination) rows farthest from the median,
    at least one; equal distances are taken in order of *key*, a unique number. Columns with
    fewer than ten values are left out; see ``eligibility``.
    """
    columns = [columns] if isinstance(columns, str) else columns or numeric_columns(df)
    columns = [c for c in columns if c != key]
    if not columns:
        raise AnomalyError("no numeric column to examine")
    if method == "zscore":
        return _zscore(df, key, columns, threshold)
    if method in TAIL_NAMES:
        return _tail(df, key, columns, contamination)
    raise AnomalyError(f"unknown method: {method}")


def anomaly_summary(
    df: DataFrame, flagged: DataFrame, columns: list[str], method: str, n: int = SAMPLE
) -> DataFrame:
    """Per column: count, rows, percentage and the first *n* flagged values with their keys."""
    totals = eligibility(df, columns).filter(F.col("status") == "OK")
    by_key = Window.partitionBy("column_name").orderBy("row_key")
    sample = (
        flagged.withColumn("_r", F.row_number().over(by_key))
        .filter(F.col("_r") <= n)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("row_key", "value"))).alias("sample"))
    )
    counts = flagged.groupBy("column_name").agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0).cast("long"))
    return (
        totals.join(F.broadcast(counts), "column_name", "left")
        .join(F.broadcast(sample), "column_name", "left")
        .select(
            "column_name",
            F.lit(method).alias("method"),
            found.alias("anomaly_count"),
            F.col("n").alias("total_rows"),
            F.round(found / F.col("n") * 100, 4).alias("anomaly_pct"),
            F.coalesce(F.col("sample.value"), F.array().cast("array<double>")).alias("sample_values"),
            F.coalesce(F.col("sample.row_key"), F.array().cast("array<bigint>")).alias("sample_keys"),
        )
    )


def anomalies_all(
    df: DataFrame, key: str, columns: list[str] | None = None, method: str = "tail", **options
) -> DataFrame:
    """Summaries for all requested columns; names that are missing or not numeric are skipped,
    and it is an error only when none is left."""
    numeric = numeric_columns(df)
    chosen = [c for c in (columns or numeric) if c in numeric and c != key]
    if not chosen:
        raise AnomalyError("none of the requested columns can be examined")
    flagged = anomalies(df, key, chosen, method, **options)
    return anomaly_summary(df, flagged, chosen, method)
