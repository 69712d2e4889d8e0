"""The change ledger as a stream: edits since the last check, kept up to date as events arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.functions.lineage import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can write."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of a folder, or one file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # a stream reads folders: the one around the file, and of it only the file
        name = hadoop.getName()
        for special in "\\{}[]*?":
            name = name.replace(special, "\\" + special)
        return reader.option("pathGlobFilter", name).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def last_checks(events: DataFrame, check: str = "purchase", edit: str = "click") -> DataFrame:
    """user_id, last_check, last_edit, edits of each user, of a batch or a stream; state is one row a user."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.max(F.when(kind == check, F.col("ts"))).alias("last_check"), F.max(F.when(kind == edit, F.col("ts"))).alias("last_edit"), F.count_if(kind == edit).alias("edits")
    )


def kept_current(spark: SparkSession, path: str) -> DataFrame:
    """The ledger after all files of path have been read as a stream.

    Each micro-batch replaces the rows of the users it touches: it is written under its own number,
    so that one that runs again after a loss overwrites itself, and the last number of a user counts.
    """
    schema = spark.read.parquet(path).schema
    out, checkpoint = new_folder(spark, "ledger"), new_folder(spark, "ledger-state")
    stream = as_stream(spark, path, schema)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changes = last_checks(stream)
    empty = last_checks(spark.read.schema(schema).parquet(path).limit(0))
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # one row a user is kept on disk, not in memory
    try:
        changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, old)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return empty
    written = spark.read.option("basePath", out).schema(empty.schema.add("batch", "long")).parquet(out)
    row = F.struct("last_check", "last_edit", "edits")
    return written.groupBy("user_id").agg(F.max_by(row, "batch").alias("row")).select("user_id", "row.*")
