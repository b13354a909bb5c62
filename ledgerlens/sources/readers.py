"""Reading and writing tables: declared casts over text scans, Parquet first, findings as JSON."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.columns import period_bounds, serial_to_date


@dataclass(frozen=True)
class Source:
    """A text table: its columns in order, and the casts of those that are no text."""

    name: str
    columns: tuple[str, ...]
    casts: dict[str, str] = field(default_factory=dict)
    primary_key: str | None = None
    expected_rows: int | None = None


def cast_text(c: str, kind: str) -> Column:
    """Casts of the declared logical types; a malformed value becomes null."""
    col = F.col(c)
    if kind == "timestamp":
        # the wall time in UTC, zone dropped
        return F.to_utc_timestamp(col.try_cast("timestamp"), "UTC")
    spark_kind = {"float": "double", "int": "bigint", "bool": "boolean", "date": "date"}[kind]
    if kind == "int":
        return col.try_cast("double").cast("bigint")
    return col.try_cast(spark_kind)


def typed_csv(spark: SparkSession, path: str, source: Source) -> DataFrame:
    """All columns read as text with the declared names, then the listed casts; the rest stays text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in source.columns])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)
    return raw.select(*[
        cast_text(c, source.casts[c]).alias(c) if c in source.casts else F.col(c) for c in source.columns
    ])


def failed_casts(spark: SparkSession, path: str, source: Source) -> DataFrame:
    """Values present in the text that their cast could not read, per cast column."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in source.columns])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    counts = raw.agg(*[
        F.count_if(F.col(c).isNotNull() & cast_text(c, kind).isNull()).alias(c) for c, kind in source.casts.items()
    ])
    return counts.unpivot([], list(source.casts), "column", "failed")


def utc_naive(c) -> Column:
    """A timestamp with zone as UTC wall time without zone."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def parquet_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet scan that reads only the named columns."""
    return spark.read.parquet(path).select(*columns)


def load_table(spark: SparkSession, folder: str, name: str, view: str | None = None) -> DataFrame:
    """The table's Parquet file where there is one, else its CSV file; registered as a temp view."""
    hadoop = spark._jsc.hadoopConfiguration()
    for suffix in ("parquet", "csv"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{suffix}")
        if path.getFileSystem(hadoop).exists(path):
            reader = spark.read
            df = reader.parquet(str(path)) if suffix == "parquet" else reader.option("header", True).csv(str(path))
            df.createOrReplaceTempView(view or name)
            return df
    raise FileNotFoundError(f"no {name}.parquet or {name}.csv in {folder}")


def write_view(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """Write one analytical view as Parquet and return a scan of it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


Recipe = str | Callable[[SparkSession], DataFrame]


def build_pack(spark: SparkSession, staging: dict[str, Recipe], views: dict[str, Recipe], folder: str) -> dict[str, DataFrame]:
    """Register the staging views, then write each analytical view in name order."""
    def frame(recipe: Recipe) -> DataFrame:
        return spark.sql(recipe) if isinstance(recipe, str) else recipe(spark)

    for name, recipe in staging.items():
        frame(recipe).createOrReplaceTempView(name)
    out = {}
    for name in sorted(views):
        out[name] = write_view(frame(views[name]), f"{folder}/{name}")
        out[name].createOrReplaceTempView(name)
    return out


def write_findings(found: DataFrame, path: str) -> None:
    """Findings with their nested sets as JSON, best first; range-partitioned, so files follow the order."""
    found.orderBy(F.desc("score"), "finding_id").write.mode("overwrite").json(path)


def read_findings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """Dated events (event, start_month, end_month, note); template rows and unreadable periods are skipped."""
    rows = spark.read.schema("event string, start_month string, end_month string, note string").option("header", True).csv(path)
    return usable_events(rows)


def usable_events(rows: DataFrame) -> DataFrame:
    clean = rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("event", "start_month", "end_month", "note")])
    bounded = clean.withColumns({"s": period_bounds("start_month"), "e": period_bounds("end_month")})
    return bounded.filter(
        (F.col("event") != "") & ~F.col("event").startswith("TODO") & F.col("s").isNotNull() & F.col("e").isNotNull()
    ).select("event", "start_month", "end_month", "note",
             F.col("s.first").alias("event_first"), F.col("e.last").alias("event_last"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def materialise_dashboard(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Run parameter-free queries and keep each result as JSON rows with its status and row count.

    Every job appends its own rows, so nothing passes through the driver; a failed job leaves an
    ERROR row with the message and the others still run.
    """
    schema = "id string, row_no long, row_json string, status string, error string, seconds double"
    for name, job in jobs.items():
        start = time.time()
        try:
            df = job()
            rows = df.select(
                F.lit(name).alias("id"), F.monotonically_increasing_id().alias("row_no"),
                F.to_json(F.struct(*df.columns)).alias("row_json"), F.lit("FRESH").alias("status"),
                F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("seconds"))
            rows.write.mode("append").parquet(path)
            note = (name, None, None, "FRESH", None, time.time() - start)
        except Exception as exc:
            note = (name, None, None, "ERROR", str(exc), time.time() - start)
        spark.createDataFrame([note], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def dashboard_status(table: DataFrame) -> DataFrame:
    return table.groupBy("id").agg(
        F.count("row_no").alias("row_count"),
        F.max(F.when(F.col("seconds").isNotNull(), F.col("status"))).alias("status"))


def with_serial_dates(df: DataFrame, columns: list[str], low: int = 20000, high: int = 60000) -> DataFrame:
    """Turn day serials into dates in the named columns whose every value is a plausible serial."""
    spans = df.agg(*[
        F.coalesce(F.bool_and(F.col(c).try_cast("int").between(low, high)), F.lit(False)).alias(c) for c in columns
    ]).first()
    return df.withColumns({c: serial_to_date(c, low, high) for c in columns if spans[c]})
