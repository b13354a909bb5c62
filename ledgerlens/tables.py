"""Access to the parquet tables of one data folder, column-pruned by the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_SCHEMAS: dict[tuple, StructType] = {}


def stamp(spark: SparkSession, folder: str) -> tuple:
    """What tells one state of a folder's tables from a later one: names, times and sizes of its entries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))


class Tables:
    """`Tables(spark, folder).orders` is a lazy scan of `folder/orders.parquet`.

    A table's schema is read from its footer once per session and state of the folder, and declared on later scans.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        #: session, folder and its state: the key for whatever is kept about its tables
        self.state = (spark.sparkContext.applicationId, self.folder, stamp(spark, self.folder))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        key = (*self.state, name)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def register(self, names: Iterable[str] = TABLES) -> None:
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
