"""Column profiles over whole tables.

One aggregate gives all scalar statistics, one count per value of each column gives distinct counts
and top values, and a few narrowing counts over the numeric columns give the exact quartiles. With
``approx=True`` one scan with mergeable sketches takes the place of the counts (see ``sketches``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ordering import Rank, order_statistics
from plumbline.operators.rule_table import first_per_group
from plumbline.session import settle

TOP_VALUES = 10

_LABELS = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
    ((T.FloatType, T.DoubleType), "float"),
    ((T.DecimalType,), "decimal"),
    ((T.BooleanType,), "boolean"),
    ((T.StringType, T.CharType, T.VarcharType), "string"),
    ((T.DateType,), "date"),
    ((T.TimestampType, T.TimestampNTZType), "datetime"),
    ((T.DayTimeIntervalType,), "duration"),
    ((T.ArrayType,), "list"),
    ((T.StructType,), "struct"),
    ((T.NullType,), "null"),
)


def dtype_label(kind: T.DataType) -> str:
    for types, label in _LABELS:
        if isinstance(kind, types):
            return label
    return kind.typeName()


def schema_info(df: DataFrame) -> dict[str, str]:
    return {field.name: dtype_label(field.dataType) for field in df.schema.fields}


def numeric_columns(df: DataFrame, include_decimal: bool = True) -> list[str]:
    labels = {"integer", "float", "decimal"} if include_decimal else {"integer", "float"}
    return [name for name, label in schema_info(df).items() if label in labels]


def _clean(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN as NULL."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 100, 4))


def null_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, null_count, row_count, null_pct); an empty table has 0 percent."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"k{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"k{i}").alias("null_count"),
            F.col("n").alias("row_count"),
            _pct(F.col(f"k{i}"), F.col("n")).alias("null_pct"),
        )
        for i, c in enumerate(columns)
    ])
    return counts.select(F.inline(rows))


def numeric_long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unpivot numeric columns to (column_name, value), without NULL and NaN."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), _clean(df, c).alias("value")) for c in columns
    ])
    return df.select(*(keep or []), F.inline(rows)).filter(F.col("value").isNotNull())


#: Texts longer than this are counted by their sha256; only the few that are shown are fetched whole.
SHORT = 48
#: Stands before a digest, in place of a text.
_LONG = "\u0001sha256:"


def _value_key(df: DataFrame, name: str) -> Column:
    """What the values of a column are counted by: numbers, dates and booleans by themselves, texts by themselves or, when
    long, by their digest, so that what is shuffled does not grow with the texts."""
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value
    return _text_key(value.cast("string"))


def _text_key(text: Column) -> Column:
    long = (F.length(text) > SHORT) | text.startswith(_LONG)
    return F.when(long, F.concat(F.lit(_LONG), F.sha2(text, 256))).otherwise(text)


def _is_long(key: Column) -> Column:
    return key.startswith(_LONG)


def _digest(key: Column) -> Column:
    """The sha256 of the text that a key stands for."""
    return F.unhex(F.when(_is_long(key), F.substr(key, F.lit(len(_LONG) + 1))).otherwise(F.sha2(key, 256)))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(key, n) of the non-null values of a column, from a scan of that column alone.

    Partial counts are merged before the shuffle and values hash over all tasks, so a frequent value makes no hot task.
    """
    return df.select(_value_key(df, name).alias("key")).filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"))


def _distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, unique_count)."""
    counts = [value_counts(df, c).agg(F.count("n").alias("unique_count")).select(F.lit(c).alias("column_name"), "unique_count")
              for c in columns]
    return reduce(DataFrame.unionByName, counts)


def _ranked(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column_name, key, n, rank) of the *k* most frequent values, ties by the sha256 of their text. Tasks keep their
    first *k* before the counts meet."""
    counts = [value_counts(df, c).select(F.lit(c).alias("column_name"), F.col("key").cast("string").alias("key"), "n") for c in columns]
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), _digest(F.col("key")))
    return reduce(DataFrame.unionByName, counts).withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)


def with_texts(df: DataFrame, top: DataFrame) -> DataFrame:
    """(column_name, value, n, rank) for the keys in *top*, a few rows per column. Long texts are fetched in one pass over
    the columns that have any; without one there is no such pass."""
    rows = top.collect()  # k rows a column
    columns = sorted({r["column_name"] for r in rows if r["key"].startswith(_LONG)})
    top = df.sparkSession.createDataFrame(rows, top.schema)
    if not columns:
        return top.withColumnRenamed("key", "value").select("column_name", "value", "n", "rank")
    texts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns])
    long = df.select(F.inline(texts)).filter(F.length("text") > SHORT).withColumn("key", _text_key(F.col("text")))
    found = long.join(F.broadcast(top.select("column_name", "key")), ["column_name", "key"]).groupBy("column_name", "key").agg(
        F.max("text").alias("text"))
    return top.join(F.broadcast(found), ["column_name", "key"], "left").select(
        "column_name", F.coalesce("text", "key").alias("value"), "n", "rank")


def _all_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its position, label and the table's row count."""
    labels = schema_info(df)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(labels[c]).alias("dtype")
        )
        for i, c in enumerate(columns)
    ])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.inline(rows))


def _with_uniqueness(df: DataFrame) -> DataFrame:
    rows, distinct = F.col("row_count"), F.coalesce(F.col("unique_count"), F.lit(0))
    return (
        df.withColumn("unique_count", distinct)
        .withColumn("unique_pct", _pct(F.col("unique_count"), rows))
        .withColumn("is_unique", F.col("unique_count") == rows)
    )


def uniqueness(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column_name, row_count, unique_count, unique_pct, is_unique).

    A NULL makes a column not unique; an empty table is unique. *approx* trades exact distinct
    counts for a single scan without a shuffle of values.
    """
    columns = columns or df.columns
    if approx:
        counts = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)],
        )
        rows = F.array(*[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("n").alias("row_count"),
                F.col(f"d{i}").alias("unique_count"),
            )
            for i, c in enumerate(columns)
        ])
        return _with_uniqueness(counts.select(F.inline(rows)))
    distinct = _distinct_counts(df, columns)  # a row a column
    return _with_uniqueness(
        _all_columns(df, columns).join(F.broadcast(distinct), "column_name", "left")
    ).select("column_name", "row_count", "unique_count", "unique_pct", "is_unique")


_MOMENTS = ("n", "min", "max", "mean", "std", "std_pop")


def _moment_aggregates(df: DataFrame, columns: list[str]) -> list[Column]:
    aggregates = []
    for i, name in enumerate(columns):
        value = _clean(df, name)
        made = (
            F.count(value), F.min(value), F.max(value), F.avg(value),
            F.stddev_samp(value), F.stddev_pop(value),
        )
        aggregates += [a.alias(f"{label}{i}") for label, a in zip(_MOMENTS, made)]
    return aggregates


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, min, max, mean, std, std_pop), one aggregate over one scan."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}{i}").alias(m) for m in _MOMENTS])
        for i, c in enumerate(columns)
    ])
    return df.agg(*_moment_aggregates(df, columns)).select(F.inline(rows))


def _scalars(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Row count, null counts and moments of all columns from a single aggregate."""
    labels = schema_info(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"k{i}") for i, c in enumerate(df.columns)],
        *_moment_aggregates(df, numeric),
    )
    shown = ("min", "max", "mean", "std")

    def stats(name):
        if name in numeric:
            i = numeric.index(name)
            return [F.col(f"n{i}").alias("value_count"), *[F.col(f"{m}{i}").alias(m) for m in shown]]
        absent = F.lit(None).cast("double")
        return [F.lit(None).cast("long").alias("value_count"), *[absent.alias(m) for m in shown]]

    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(labels[c]).alias("dtype"),
            F.col("rows").alias("row_count"),
            F.col(f"k{i}").alias("null_count"),
            *stats(c),
        )
        for i, c in enumerate(df.columns)
    ])
    return counts.select(F.inline(rows)).withColumn(
        "null_pct", _pct(F.col("null_count"), F.col("row_count"))
    )


def quartiles(rows: DataFrame, spans: dict[str, tuple[int, float, float]]) -> dict[str, dict]:
    """{column: {median, p25, p75}} from (column_name, value); *spans* gives n, min and max.

    The median is interpolated; p25 and p75 are the nearest ranked value.
    """
    wanted = []
    for name, (n, low, high) in spans.items():
        if not n:
            continue
        last = n - 1
        for stat, rank in (
            ("median_low", last // 2),
            ("median_high", (last + 1) // 2),
            ("p25", int(last * 0.25 + 0.5)),
            ("p75", int(last * 0.75 + 0.5)),
        ):
            wanted.append(Rank(name, stat, rank, low, high, n))
    found = order_statistics(rows.select("column_name", "value", F.lit(1).alias("n")), wanted)
    return {
        name: {
            "median": (found[name, "median_low"] + found[name, "median_high"]) / 2,
            "p25": found[name, "p25"],
            "p75": found[name, "p75"],
        }
        for name in {w.column for w in wanted}
    }


def spans_of(stats: DataFrame) -> dict[str, tuple[int, float, float]]:
    """n, min and max per column, on the driver: one short row per column."""
    return {r["column_name"]: (r["n"], r["min"], r["max"]) for r in stats.collect()}


_QUARTILES = "column_name string, median double, p25 double, p75 double"


def _quartile_rows(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    cuts = quartiles(numeric_long(df, columns), spans_of(stats))
    return df.sparkSession.createDataFrame(
        [(name, c["median"], c["p25"], c["p75"]) for name, c in cuts.items()], _QUARTILES
    )


def numeric_stats(
    df: DataFrame, columns: list[str] | None = None, include_decimal: bool = False
) -> DataFrame:
    """(column_name, n, min, max, mean, std, median, p25, p75)."""
    columns = columns or numeric_columns(df, include_decimal)
    stats = settle(moments(df, columns).drop("std_pop"))
    return stats.join(F.broadcast(_quartile_rows(df, columns, stats)), "column_name", "left")


#: Counters that a task keeps of a column's values, and values a wanted one that are counted in the second pass.
COUNTERS, SPARE = 4096, 4


def _frequent(df: DataFrame, name: str) -> DataFrame:
    """(key, low, missed) from one pass: *low* counts of every task's most frequent keys, which are too small by *missed*, given
    in a row without a key, at most (Misra and Gries). A task keeps COUNTERS keys whatever the column holds."""
    schema = pa.schema([("key", pa.string()), ("low", pa.int64()), ("missed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        missed = 0
        for batch in batches:
            for pair in batch.column("key").drop_null().value_counts().to_pylist():
                kept[pair["values"]] = kept.get(pair["values"], 0) + pair["counts"]
            if len(kept) > COUNTERS:
                cut = sorted(kept.values(), reverse=True)[COUNTERS]
                kept = {key: n - cut for key, n in kept.items() if n > cut}
                missed += cut
        columns = [None, *kept], [None, *kept.values()], [missed, *[None] * len(kept)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keys = df.select(_value_key(df, name).cast("string").alias("key"))
    return keys.mapInArrow(run, "key string, low long, missed long").groupBy("key").agg(
        F.sum("low").alias("low"), F.sum("missed").alias("missed"))


def heavy_values(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame | None:
    """(column_name, key, n, rank) of the *k* most frequent values in two passes without a shuffle of all values, or None if
    those do not decide. The first pass finds candidates and how often any other value can occur at most, the second
    counts the candidates. Their order is certain if the k-th of them occurs oftener than that."""
    chosen = SPARE * k
    best = _frequent(df, name).orderBy(F.col("key").isNull().desc(), F.desc("low"), "key").limit(chosen + 2).collect()
    missed, found = (best[0]["missed"] or 0, best[1:]) if best else (0, [])  # no task, no row
    most_of_others = missed + (found[chosen]["low"] if len(found) > chosen else 0)
    keys = [r["key"] for r in found[:chosen]]
    counts = value_counts(df.filter(_value_key(df, name).cast("string").isin(keys)), name)
    rows = counts.select(F.col("key").cast("string").alias("key"), "n", _digest(F.col("key").cast("string")).alias("d")).collect()
    ranked = sorted(rows, key=lambda r: (-r["n"], bytes(r["d"])))[:k]
    if most_of_others and (len(ranked) < k or ranked[-1]["n"] <= most_of_others):
        return None
    return df.sparkSession.createDataFrame(
        [(name, r["key"], r["n"], i) for i, r in enumerate(ranked, 1)], "column_name string, key string, n long, rank int")


def top_values_long(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """(column_name, value, n, rank): the *k* most frequent values, ties by the sha256 of the value. Only columns whose
    candidates do not decide (``heavy_values``) are counted whole."""
    found = {c: heavy_values(df, c, k) for c in columns}
    parts = [part for part in found.values() if part is not None]
    open_ = [c for c, part in found.items() if part is None]
    if open_:
        parts.append(_ranked(df, open_, k))
    return with_texts(df, reduce(DataFrame.unionByName, parts))


def _distinct_and_top(df: DataFrame, columns: list[str], listed: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(column_name, unique_count) and (column_name, top_values of the *listed* columns), from one job: both read the same
    counts, which are shuffled once and written nowhere. A row a column and k rows a listed column reach the driver."""
    nothing = F.lit(None)
    distinct = _distinct_counts(df, columns).select(
        "column_name", nothing.cast("string").alias("key"), F.col("unique_count").alias("n"), nothing.cast("int").alias("rank"))
    both = distinct.unionByName(_ranked(df, listed, k)) if listed else distinct
    rows = both.collect()
    spark = df.sparkSession
    unique = spark.createDataFrame([(r["column_name"], r["n"]) for r in rows if r["rank"] is None], "column_name string, unique_count long")
    top = with_texts(df, spark.createDataFrame([r for r in rows if r["rank"] is not None], both.schema))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "value", F.col("n").alias("count"))))
    trimmed = F.transform(ordered, lambda row: F.struct(row["value"].alias("value"), row["count"].alias("count")))
    return unique, top.groupBy("column_name").agg(trimmed.alias("top_values"))


class EmptyTable(ValueError):
    """Profiling needs at least one row."""


def profile(
    df: DataFrame,
    table_name: str,
    k: int = TOP_VALUES,
    include_decimal: bool = False,
    profiled_at: Column | None = None,
    require_rows: bool = False,
    approx: bool = False,
) -> DataFrame:
    """The full profile, one row per column. With *approx* distinct counts, quartiles and top values are estimates
    from one scan without a shuffle of values; all else is exact."""
    if require_rows and df.isEmpty():
        raise EmptyTable(f"{table_name} has no rows to profile")
    if approx:
        from plumbline.operators.sketches import profile_of_sketches, sketch

        return profile_of_sketches(sketch(df, include_decimal=include_decimal), table_name, k, profiled_at)
    columns = df.columns
    numeric = numeric_columns(df, include_decimal)
    other = [c for c in columns if c not in numeric]
    distinct, top = _distinct_and_top(df, columns, other, k)
    scalars = settle(_scalars(df, numeric))
    result = _with_uniqueness(scalars.join(F.broadcast(distinct), "column_name", "left"))
    if numeric:
        stats = scalars.filter(F.col("column_name").isin(*numeric)).withColumn(
            "n", F.col("value_count")
        )
        cuts = _quartile_rows(df, numeric, stats)
        result = result.join(F.broadcast(cuts), "column_name", "left")
    else:
        result = result.withColumns(
            {c: F.lit(None).cast("double") for c in ("median", "p25", "p75")}
        )
    if other:
        result = result.join(F.broadcast(top), "column_name", "left")
    else:
        result = result.withColumn(
            "top_values", F.lit(None).cast("array<struct<value:string,count:bigint>>")
        )
    all_null = F.col("null_count") == F.col("row_count")
    when = F.current_timestamp() if profiled_at is None else profiled_at
    return result.select(
        F.lit(table_name).alias("table_name"),
        "position", "column_name", "dtype", "row_count",
        F.lit(len(columns)).alias("column_count"),
        "null_count", "null_pct", "unique_count", "unique_pct", "is_unique",
        "min", "max", "mean", "std", "median", "p25", "p75", "top_values",
        F.when(all_null, "all_null").alias("note"),
        when.alias("profiled_at"),
    )


def latest_profile(profiles: DataFrame, table_name: str | None = None) -> DataFrame:
    """All rows of the newest profile of each table (or of one table)."""
    if table_name is not None:
        profiles = profiles.filter(F.col("table_name") == table_name)
    return first_per_group(
        profiles, ["table_name", "column_name"], [F.desc("profiled_at")]
    )
