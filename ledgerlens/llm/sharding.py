"""Sharding over fixed virtual slots (native).

A record's hash picks one of VIRTUAL_SLOTS slots for good. Bytes are summed per slot, and a stored, versioned table maps
slots to shards. `first_map` deals the slots largest first, each to the shard with the fewest bytes so far; `rebalance`
edits a stored map for new byte counts or another number of shards and moves only the slots that must move.

Defined cases: a null text counts as empty and its record has size 1; a null id is hashed like any other value, together
with the text's checksum; repeated rows are records of their own; an empty table gives an empty result and a map whose
slots are dealt in order. Only `id_col` and `text_col` are read, so extra columns cannot clash.
Everything but the slot table (VIRTUAL_SLOTS rows, whatever the input) stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage, scratch_path

VIRTUAL_SLOTS = 4096


def record_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every record."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(records: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """vslot, bytes, n of every slot, empty slots included."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def _deal(rows: Column, loads: Column) -> Column:
    """Shard of each entry of `rows` (largest first): the least loaded so far, the lowest number among equals."""
    picks = F.array().cast("array<int>")

    def step(acc, row):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: v + F.when(i == at, row["bytes"]).otherwise(F.lit(0))).alias("loads"),
            F.concat(acc["picks"], F.array(at)).alias("picks"),
        )

    return F.aggregate(rows, F.struct(loads.alias("loads"), picks.alias("picks")), step)["picks"]


def _dealt(slots: DataFrame, loads: Column) -> DataFrame:
    """vslot, shard for the slots of a frame of at most VIRTUAL_SLOTS rows with columns vslot and bytes."""
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes"))).alias("rows"))
    return (
        ordered.select("rows", _deal(F.col("rows"), loads).alias("shards"))
        .select(F.explode(F.arrays_zip("rows", "shards")).alias("x"))
        .select(F.col("x.rows.vslot").alias("vslot"), F.col("x.shards").alias("shard"))
    )


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, vslot, shard."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return _dealt(sizes, loads).select(F.lit(1).alias("version"), "vslot", "shard")


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map. A shard keeps its slots, largest first, while they fit under the mean; the slots beyond
    it, and those of shards that no longer exist, are dealt anew to the least loaded shards."""
    with_size = current.join(sizes, "vslot")
    mean = sizes.agg((F.sum("bytes") / shards).alias("mean"))
    running = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)
    judged = with_size.withColumn("upto", F.sum("bytes").over(running)).crossJoin(F.broadcast(mean)).withColumn(
        "stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < shards))
    stay, move = judged.where("stays"), judged.where("not stays")
    held = stay.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("held"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.col("held")[s], F.lit(0).cast("long")))
    ordered = move.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes"))).alias("rows"))
    again = (
        ordered.crossJoin(held)
        .select("rows", _deal(F.col("rows"), loads).alias("shards"))
        .select(F.explode(F.arrays_zip("rows", "shards")).alias("x"))
        .select(F.col("x.rows.vslot").alias("vslot"), F.col("x.shards").alias("shard"))
    )
    version = current.agg((F.max("version") + 1).alias("version"))
    return stay.select("vslot", "shard").union(again).crossJoin(F.broadcast(version)).select("version", "vslot", "shard")


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Store one version of the map and return it as stored; a version that is there already is refused."""
    slot_map = cut_lineage(slot_map, "shard-map")
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return latest_map(slot_map.sparkSession, folder)


def latest_map(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    newest = stored.agg(F.max("version").alias("newest"))
    return stored.join(F.broadcast(newest), F.col("version") == F.col("newest")).select("version", "vslot", "shard")


def stored_versions(spark: SparkSession, folder: str) -> bool:
    """Whether the folder holds a map."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def current_map(sizes: DataFrame, shards: int, folder: str, tolerance: float = 0.01) -> DataFrame:
    """The map to use for these slot sizes: the stored one, edited if that is needed, or a first one.

    An edit is a new version. It is made when the number of shards is another one, or when it makes the largest shard smaller by
    more than `tolerance` of the mean; otherwise slots stay where they are.
    """
    spark = sizes.sparkSession
    if not stored_versions(spark, folder):
        return store_map(first_map(sizes, shards), folder)
    current = cut_lineage(latest_map(spark, folder), "shard-current")
    edited = cut_lineage(rebalance(current, sizes, shards), "shard-edited")

    def load(slot_map: DataFrame):
        by_shard = slot_map.join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
        return by_shard.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("all"), (F.max("shard") + 1).alias("shards")).first()

    old, new = load(current), load(edited)
    if old["shards"] == shards and old["most"] - new["most"] <= tolerance * old["all"] / shards:
        return current
    return store_map(edited, folder)


def assign(docs: DataFrame, shards: int = 16, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, map_version, shard and the record's place in its shard, gapless from 0.

    `folder` holds the versioned map (a fresh one below the shared folder by default); a map that is there is used and, where
    the new sizes ask for it, edited.
    """
    spark = docs.sparkSession
    records = cut_lineage(record_sizes(docs, id_col, text_col), "shard-sizes")
    sizes = cut_lineage(slot_bytes(records), "shard-slots")
    slot_map = current_map(sizes, shards, folder or scratch_path(spark, "shard-map"))
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    placed = slot_map.join(sizes, "vslot").select(
        "vslot", "version", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(placed), "vslot")  # VIRTUAL_SLOTS rows
        .select("doc_id", "size", "text_crc32", "vslot", F.col("version").alias("map_version"), "shard",
                (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
    )
