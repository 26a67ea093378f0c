"""Continuous rule evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.rules import RuleSpec, _spec_row, graded, run_rules
from plumbline.sources.sinks import overwrite_batch


def stream_rules(
    stream: DataFrame,
    specs: list[RuleSpec],
    time: str = "ts",
    window: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Graded violation counts per rule and tumbling window.

    All rules share one aggregate per window; its state is one row per open window, whatever the
    input volume. Rows behind the watermark are dropped. Distinct counts need unbounded state and
    are left to micro-batches (``stream_rules_to_sink``).
    """
    if any(spec.rule_type == "uniqueness_check" for spec in specs):
        raise ValueError("uniqueness rules cannot be counted per window in bounded state")
    metrics = [
        (F.count(F.lit(1)) if s.observed_key == "observed_value" else F.count_if(s.violates())).alias(f"m{i}")
        for i, s in enumerate(specs)
    ]
    counted = (
        stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(*metrics)
    )
    rows = F.array(*[_spec_row(s, F.col(f"m{i}")) for i, s in enumerate(specs)])
    return graded(
        counted.select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.inline(rows)
        )
    )


def batch_rules(
    df: DataFrame, specs: list[RuleSpec], time: str = "ts", window: str = "1 hour"
) -> DataFrame:
    """The same result over a finished table."""
    metrics = [
        (F.count(F.lit(1)) if s.observed_key == "observed_value" else F.count_if(s.violates())).alias(f"m{i}")
        for i, s in enumerate(specs)
    ]
    counted = df.groupBy(F.window(time, window).alias("w")).agg(*metrics)
    rows = F.array(*[_spec_row(s, F.col(f"m{i}")) for i, s in enumerate(specs)])
    return graded(
        counted.select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.inline(rows)
        )
    )


def stream_rules_to_sink(
    stream: DataFrame,
    specs: Callable[[], list[RuleSpec]] | list[RuleSpec],
    path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Run all rules on every micro-batch and store the graded results per batch id."""
    chosen = specs() if callable(specs) else specs

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        overwrite_batch(run_rules(batch, chosen), path, batch_id)

    return stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
