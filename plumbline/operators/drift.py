"""Mean-shift drift between a reference and a current table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIFT_LIMIT = 1.0
SHARE_LIMIT = 0.5


class DriftError(ValueError):
    pass


def common_columns(reference: DataFrame, current: DataFrame, columns: list[str]) -> list[str]:
    common = [c for c in columns if c in reference.columns and c in current.columns]
    if not common:
        raise DriftError(f"none of {columns} exists in both tables")
    return common


def _as_number(df: DataFrame, name: str):
    """Numbers as they are, booleans as 0/1, parseable text as its number, else NULL."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        value = F.trim(value).try_cast("double")
    else:
        value = value.try_cast("double")
    return F.when(~F.isnan(value), value)


def _side(df: DataFrame, columns: list[str], tag: str) -> DataFrame:
    aggregates = []
    for i, name in enumerate(columns):
        value = _as_number(df, name)
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"m{i}"),
            F.stddev_samp(value).alias(f"s{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias(f"{tag}_n"),
            F.col(f"m{i}").alias(f"{tag}_mean"),
            F.col(f"s{i}").alias(f"{tag}_std"),
        )
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggregates).select(F.inline(rows))


def drift(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str],
    names: tuple[str, str] = ("reference", "current"),
    require_rows: bool = False,
) -> DataFrame:
    """(column_name, stat_test, drift_score, is_drifted, ...), one row per common column.

    The score is the distance of the means in mean sample deviations; a deviation of zero counts
    as one. A side without numbers scores 0. A side with a single number has no deviation: the
    score is NULL and the column is not drifted.
    """
    common = common_columns(reference, current, columns)
    if require_rows:
        for df, name in ((reference, names[0]), (current, names[1])):
            if df.isEmpty():
                raise DriftError(f"{name} has no rows")
    left = _side(reference, common, "ref")
    right = _side(current, common, "cur").drop("position")
    return drift_scores(left.join(F.broadcast(right), "column_name"))


def drift_scores(sides: DataFrame) -> DataFrame:
    """Scores from the number, mean and sample deviation of both sides, one row per column."""
    pooled = (F.col("ref_std") + F.col("cur_std")) / 2
    pooled = F.when(pooled == 0, 1.0).otherwise(pooled)
    empty = (F.col("ref_n") == 0) | (F.col("cur_n") == 0)
    raw = F.when(empty, 0.0).otherwise(F.abs(F.col("cur_mean") - F.col("ref_mean")) / pooled)
    return sides.withColumn("_raw", raw).select(
        "position", "column_name",
        F.lit("mean_shift").alias("stat_test"),
        F.round("_raw", 6).alias("drift_score"),
        F.coalesce(F.col("_raw") > DRIFT_LIMIT, F.lit(False)).alias("is_drifted"),
        "ref_n", "cur_n", "ref_mean", "cur_mean",
    )


def dataset_drift(columns: DataFrame) -> DataFrame:
    """(columns, drifted, share_drifted, dataset_drift)."""
    drifted = F.count_if("is_drifted")
    share = F.coalesce(drifted / F.count(F.lit(1)), F.lit(0.0))
    return columns.agg(
        F.count(F.lit(1)).alias("columns"),
        drifted.alias("drifted"),
        F.round(share, 4).alias("share_drifted"),
        (share > SHARE_LIMIT).alias("dataset_drift"),
    )
