"""Session helper and the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; on a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or a fresh one in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so later jobs start from files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-known table as a local relation, so joining it starts no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def plain(value, dtype):
        if isinstance(value, list) and pa.types.is_list(dtype):
            fields = [dtype.value_type.field(i).name for i in range(dtype.value_type.num_fields)] \
                if pa.types.is_struct(dtype.value_type) else None
            return [dict(zip(fields, v)) for v in value] if fields else value
        return value

    columns = [
        pa.array([plain(r[i], arrow.field(i).type) for r in rows], type=arrow.field(i).type)
        for i in range(len(arrow))
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)
