"""Sharding by fixed virtual slots.

Every record is hashed into one of `n_slots` virtual slots, which never change. Bytes are summed
per slot, and a versioned table maps slots to shards. A record's shard follows from that table, so
rebalancing edits at most `n_slots` small rows and moves whole slots, never single records.

Everything here is built of DataFrame and SQL functions. The map has `n_slots` rows at any input
size; only it is ever gathered in one row (to deal slots out largest first) and broadcast.

Law: `bytes`. Shards get near-equal bytes, as near as the largest slot allows. Slots come from ids, so
a group of equal texts goes to many shards: kept together, a group that holds a third of all bytes
would break the law. Readers find groups by text_crc32 and size.

store_map() keeps the versions of a map in a folder, current_map() reads the latest, and rebalance()
edits it; a record's slot never changes.

Defined results: a null text weighs the overhead only; an empty table gives an empty map and no
rows; rows with a null id go to the slots of their texts; equal rows share a slot and take different
places in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import docs_of, new_path, write_table

N_SLOTS = 4096
N_SHARDS = 24
ROW_OVERHEAD = 8


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def manifest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32 and virtual slot of each record; the text is read once and left behind."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        slot_of(F.when(F.col(id_col).isNull(), F.xxhash64(data)).otherwise(F.col(id_col).cast("long")), n_slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """One row for each slot in use: its records and bytes."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def _deal(slots: DataFrame, loads: DataFrame | None, n_shards: int) -> DataFrame:
    """Deal slots (virtual_slot, slot_bytes) out, the largest first, each to the shard with the least bytes."""
    empty = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.lit(0).cast("long").alias("load"), s.alias("shard")))
    listed = slots.agg(F.sort_array(F.collect_list(F.struct("slot_bytes", (-F.col("virtual_slot")).alias("neg"))), asc=False).alias("todo"))
    if loads is None:
        listed = listed.withColumn("loads", empty)
    else:
        listed = listed.crossJoin(loads)  # one row each
    out_type = "array<struct<virtual_slot:int,shard:int>>"

    def step(acc: Column, x: Column) -> Column:
        least = F.array_min(acc["loads"])
        grown = F.transform(
            acc["loads"],
            lambda s: F.struct(F.when(s["shard"] == least["shard"], s["load"] + x["slot_bytes"]).otherwise(s["load"]).alias("load"), s["shard"].alias("shard")),
        )
        put = F.concat(acc["put"], F.array(F.struct((-x["neg"]).cast("int").alias("virtual_slot"), least["shard"].cast("int").alias("shard"))))
        return F.struct(grown.alias("loads"), put.alias("put"))

    start = F.struct(F.col("loads"), F.array().cast(out_type).alias("put"))
    dealt = listed.select(F.aggregate("todo", start, step)["put"].alias("put"))
    return dealt.select(F.explode("put").alias("p")).select("p.virtual_slot", "p.shard")


def initial_map(sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the slot-to-shard map, for the slots in use."""
    return _deal(sizes, None, n_shards).withColumn("version", F.lit(1))


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int, tolerance: float = 0.01) -> DataFrame:
    """The next version of the map for new sizes or another number of shards.

    Slots stay where they are as long as their shard keeps within (1 + tolerance) of the mean; the
    others, and those of shards that go, are dealt out anew, largest first. Slots without a record
    stay too. Returns (version, virtual_slot, shard, moved).
    """
    now = slot_map.join(sizes, "virtual_slot", "full").select(
        "virtual_slot", F.col("shard").alias("old"), F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"), F.col("version").alias("old_version")
    )
    # slots are at most n_slots rows, so windows over all of them stay small
    running = F.sum("slot_bytes").over(Window.partitionBy("old").orderBy(F.desc("slot_bytes"), "virtual_slot"))
    total = now.agg(F.coalesce(F.sum("slot_bytes"), F.lit(0)).alias("total"), F.coalesce(F.max("old_version"), F.lit(0)).alias("last"))
    marked = now.withColumn("running", running).crossJoin(F.broadcast(total)).withColumn(
        "stays", F.col("old").isNotNull() & (F.col("old") < n_shards) & (F.col("running") <= F.col("total") / n_shards * (1 + tolerance))
    )
    kept = marked.filter("stays")
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = (
        shards.join(kept.groupBy(F.col("old").alias("shard")).agg(F.sum("slot_bytes").alias("load")), "shard", "left")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).cast("long").alias("load"), F.col("shard")))).alias("loads"))
    )
    moved = _deal(marked.filter(~F.col("stays")).select("virtual_slot", "slot_bytes"), loads, n_shards)
    new = kept.select("virtual_slot", F.col("old").alias("shard"), F.lit(False).alias("moved")).unionByName(moved.withColumn("moved", F.lit(True)))
    return new.crossJoin(F.broadcast(total.select((F.col("last") + 1).alias("version"))))


def assign(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shard and gapless place in it for each record.

    The place is the number of records in the shard's earlier slots plus the rank in the own slot,
    so that no shard, only a slot, is ever sorted in one task.
    """
    slots = slot_map.select("virtual_slot", "shard").join(sizes, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("rank", rank).join(F.broadcast(slots), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank") - 1)


def store_map(slot_map: DataFrame, folder: str) -> int:
    """Write a map as its version's file in a folder; returns the version. A version that is there already stays as it is."""
    version = slot_map.agg(F.max("version")).first()[0] or 1
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("ignore").parquet(f"{folder}/version={version}")
    return version


def current_map(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of the map in a folder."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    return versions.join(F.broadcast(versions.agg(F.max("version").alias("latest"))), F.col("version") == F.col("latest")).drop("latest")


def shard(df: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with shard and place, the map stored in the folder); the records are kept in the shared folder without their texts.

    A folder that has a map already gives it: slots that it lacks, or another number of shards, make it rebalance.
    """
    spark = df.sparkSession
    rows = write_table(manifest(df, id_col, text_col, n_slots), "manifest")
    sizes = write_table(slot_sizes(rows).coalesce(1), "slot-sizes")
    path = folder or new_path(spark, "slot-map")
    old = None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = current_map(spark, path)
        lacking = sizes.join(old, "virtual_slot", "left_anti").isEmpty()
        if lacking and old.agg(F.max("shard")).first()[0] == n_shards - 1:
            return assign(rows, old, sizes), old
    store_map(initial_map(sizes, n_shards) if old is None else rebalance(old, sizes, n_shards), path)
    slot_map = current_map(spark, path)
    return assign(rows, slot_map, sizes), slot_map


def query(spark, sf_dir: str) -> DataFrame:
    placed, _ = shard(docs_of(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
