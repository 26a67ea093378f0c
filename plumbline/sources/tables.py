"""Readers and table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, name: str) -> DataFrame:
    """A whole table, from a parquet path or the catalog."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def load_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns; the parquet reader then skips the others."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A database table. With a partition column and its bounds, *partitions* tasks read ranges
    of it side by side; Spark pushes filters, columns and aggregates into the database."""
    options = {
        "url": url,
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "pushDownAggregate": "true",
        **(properties or {}),
    }
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def probe_table(spark: SparkSession, name: str) -> dict:
    """exists, columns as (name, type, nullable) and row count."""
    if not spark.catalog.tableExists(name):
        return {"exists": False, "columns": [], "row_count": None}
    df = spark.table(name)
    columns = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return {"exists": True, "columns": columns, "row_count": df.count()}


def footer_probe(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """(table_name, columns, row_count, column_name, low, high) of a parquet table, a row for each of the number *columns*.

    The aggregate is pushed down to the files' footers, so no column is read. This needs Spark's second parquet reader, which a
    session of its own is set to; one row comes back from it.
    """
    side = spark.newSession()
    side.conf.set("spark.sql.sources.useV1SourceList", "")
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = side.read.parquet(path)
    limits = [x for i, c in enumerate(columns) for x in (F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"))]
    row = table.agg(F.count(F.lit(1)).alias("n"), *limits).first()
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame(
        [(name, len(table.columns), row["n"], c, number(row[f"low{i}"]), number(row[f"high{i}"])) for i, c in enumerate(columns)],
        "table_name string, columns long, row_count long, column_name string, low double, high double")


def schema_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns array<struct<name,type,nullable>>), in column order."""
    rows = [
        (name, [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields])
        for name, df in sorted(tables.items())
    ]
    return spark.createDataFrame(
        rows, "table_name string, columns array<struct<name:string,type:string,nullable:boolean>>"
    )


def catalog_tables(spark: SparkSession, excluded: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table of the session catalog outside the *excluded* schemas."""
    found = {}
    for database in spark.catalog.listDatabases():
        if database.name in excluded:
            continue
        for table in spark.catalog.listTables(database.name):
            name = f"{database.name}.{table.name}"
            found[name] = spark.table(name)
    return found


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns, row_count), one count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).cast("long").alias("columns"),
            "row_count",
        )
        for name, df in sorted(tables.items())
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def stream_files(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; a micro-batch takes about *max_bytes* at most, and one file at least."""
    reader = spark.readStream.schema(schema)
    return (reader if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)).parquet(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Make a table visible to SQL rules under *name*."""
    df.createOrReplaceTempView(name)
    return df
