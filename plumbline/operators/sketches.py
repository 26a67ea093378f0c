"""Profiles from mergeable sketches, kept per part of a table.

``sketch`` reads a table once and keeps, for each column and each part (a day, a partition), exact counts and moments, a
HyperLogLog of the values, a KLL sketch of the numbers and a frequent-items sketch of the texts. ``merge`` adds parts up,
``profile_of_sketches`` and ``drift_of_sketches`` read off what is asked for, without another look at the table. A new day
costs a scan of that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.drift import drift_scores
from plumbline.operators.profile import TOP_VALUES, _clean, _pct, _text_key, numeric_columns, schema_info

#: HyperLogLog of 2^14 registers: a standard error of 0.8 %. KLL with k = 800: ranks within 0.4 %.
HLL_BITS, HLL_ERROR, KLL_K = 14, 0.0082, 800
#: Texts that a frequent-items sketch tracks, at least four times those that are ever listed.
TRACKED = 4096

_TOP = "array<struct<value:string,count:bigint>>"


def _column_sketches(df: DataFrame, name: str, numeric: bool) -> list[Column]:
    value = F.col(f"`{name}`")
    number = _clean(df, name) if numeric else F.lit(None).cast("double")
    n = F.count(number)
    text = F.lit(None).cast("string") if numeric else _text_key(value.cast("string"))
    made = {
        "null_count": F.count_if(value.isNull()), "n": n, "min": F.min(number), "max": F.max(number), "mean": F.avg(number),
        "m2": F.var_pop(number) * n,
        "distinct": F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(HLL_BITS)),
        "quantiles": F.kll_sketch_agg_double(number, KLL_K) if numeric else F.lit(None).cast("binary"),
    }
    made["top"] = F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED))
    return [column.alias(name) for name, column in made.items()]


def sketch(df: DataFrame, by: list[str] | None = None, include_decimal: bool = False) -> DataFrame:
    """One row per part and column: *by* (none: the whole table is one part), position, column_name, dtype, column_count,
    row_count and the sketches. One scan; what is shuffled is a sketch per task, part and column."""
    by = by or []
    labels = schema_info(df)
    columns = [c for c in df.columns if c not in by]
    numeric = set(numeric_columns(df, include_decimal))
    wide = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("_rows"), *[
        F.struct(*_column_sketches(df, c, c in numeric)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(labels[c]).alias("dtype"),
            F.lit(len(columns)).alias("column_count"), *[F.col(f"_{i}")[f].alias(f) for f in ("null_count", "n", "min", "max", "mean", "m2", "distinct", "quantiles", "top")],
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.col("_rows").alias("row_count"), F.inline(rows))


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts added up to those of larger parts *by*, or of the whole table."""
    keys = [*(by or []), "position", "column_name", "dtype", "column_count"]
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / F.when(total > 0, total)
    # m2 of all = sum of m2 + n * mean^2 of the parts, less that of the whole; taken about the first mean, so that little cancels.
    shifted = sketches.join(F.broadcast(sketches.groupBy(*keys).agg(F.max("mean").alias("_about"))), keys)
    away = F.col("mean") - F.col("_about")
    offset = F.sum(F.col("n") * away) / F.when(total > 0, total)
    m2 = F.sum(F.col("m2") + F.col("n") * away * away) - total * offset * offset
    top = F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED))
    return shifted.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), total.alias("n"), F.min("min").alias("min"),
        F.max("max").alias("max"), mean.alias("mean"), m2.alias("m2"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("quantiles"))).alias("quantiles"), top.alias("top"))


def profile_of_sketches(
    sketches: DataFrame, table_name: str, k: int = TOP_VALUES, profiled_at: Column | None = None
) -> DataFrame:
    """The profile of the parts together, in the shape of ``profile``.

    Counts, minimum, maximum, mean and deviation are exact. The distinct count is within 3 % (four standard errors of
    0.8 %), quartiles are values whose rank is within 1 % of the asked one, counts of top values are at most row_count / 2000 too
    large. ``is_unique`` tells whether the distinct count can be the row count. Long texts are shown by their digest.
    """
    whole = merge(sketches)
    numeric = F.col("dtype").isin("integer", "float", "decimal")
    listed = F.filter(F.call_function("approx_top_k_estimate", F.col("top"), F.lit(k + 1)), lambda x: x["item"].isNotNull())
    pairs = F.transform(F.slice(listed, 1, k), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count")))
    top = F.when(~numeric & (F.size(pairs) > 0), pairs).cast(_TOP)
    rows, distinct = F.col("row_count"), F.least(F.hll_sketch_estimate("distinct"), F.col("row_count") - F.col("null_count"))
    quantile = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))
    all_null = F.col("null_count") == rows
    when = F.current_timestamp() if profiled_at is None else profiled_at
    return whole.withColumn("unique_count", distinct).select(
        F.lit(table_name).alias("table_name"), "position", "column_name", "dtype", "row_count",
        "column_count", "null_count", _pct(F.col("null_count"), rows).alias("null_pct"), "unique_count",
        _pct(F.col("unique_count"), rows).alias("unique_pct"),
        ((F.col("null_count") == 0) & (F.col("unique_count") >= rows * (1 - 4 * HLL_ERROR))).alias("is_unique"),
        "min", "max", "mean", _std().alias("std"), quantile(0.5).alias("median"), quantile(0.25).alias("p25"),
        quantile(0.75).alias("p75"), top.alias("top_values"), F.when(all_null, "all_null").alias("note"), when.alias("profiled_at"))


def _std() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.col("m2")) / F.when(F.col("n") > 1, F.col("n") - 1))


def drift_of_sketches(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Mean shift of the numeric columns that both have, from the sketches of any number of parts on each side."""
    def side(sketches: DataFrame, mark: str) -> DataFrame:
        return merge(sketches.filter(F.col("dtype").isin("integer", "float", "decimal"))).select(
            "column_name", F.col("position").alias(f"{mark}position"), F.col("n").alias(f"{mark}n"),
            F.col("mean").alias(f"{mark}mean"), _std().alias(f"{mark}std"))

    both = side(reference, "ref_").join(side(current, "cur_"), "column_name")  # a row a column
    return drift_scores(both.withColumnRenamed("ref_position", "position"))
