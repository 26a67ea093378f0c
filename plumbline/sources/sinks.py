"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.redaction import export_redact
from plumbline.functions.values import json_safe


def append_results(df: DataFrame, path: str, time: str = "executed_at") -> None:
    """Append rule results, one folder per day, so that time-bounded reads skip the other days."""
    df.withColumn("exec_date", F.to_date(time)).write.mode("append").partitionBy(
        "exec_date"
    ).parquet(path)


def append_metrics(df: DataFrame, path: str, json_columns: list[str] | None = None) -> None:
    """Append profile, suggestion, anomaly or drift rows. Nested columns stay nested unless they
    are named in *json_columns*."""
    for name in json_columns or []:
        df = df.withColumn(name, F.to_json(name))
    df.write.mode("append").parquet(path)


def merged_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of differing columns under one header: the columns in first-seen order."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def write_violations_csv(df: DataFrame | list[DataFrame], path: str) -> None:
    rows = merged_rows(df) if isinstance(df, list) else df
    plain = json_safe(rows)
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        (F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
        for f in plain.schema.fields
    ]
    plain.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_lines(generations: DataFrame) -> DataFrame:
    """(id, created_at, value): one JSON line per approved generation, personal data redacted."""
    text = lambda name: export_redact(F.col(name)).alias(name)
    payload = F.struct(
        F.concat(F.lit("gen_"), F.col("id").cast("string")).alias("id"),
        text("prompt"),
        text("generated_sql"),
        text("reviewed_sql"),
        F.col("edited_after_generation"),
        F.struct("confidence", "model_name", "prompt_version", "parsing_failure").alias("metadata"),
    )
    return generations.filter("approved").select(
        "id", "created_at", F.to_json(payload, {"ignoreNullFields": "false"}).alias("value")
    )


def export_jsonl(generations: DataFrame, path: str) -> None:
    """Write the lines oldest first: files in name order hold ascending ranges of time."""
    export_lines(generations).orderBy("created_at", "id").select("value").write.mode(
        "overwrite"
    ).text(path)


def overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a replayed batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
