"""Exact dedup by a stateful stream.

Records arrive as a stream of (digest, id, locator). A streaming aggregation keyed by digest keeps
for every digest seen the stable identifier of the row that stays, the number of rows and the
locator of its content. The state lies in RocksDB on disk, has no watermark and so never expires;
a later stream that starts from the same checkpoint carries on with it. Rows of a hot digest are
summed before they are shuffled.

A digest that more than one row has is a hit. Identifier and locator find the contents of hits, and
each row of a hit is compared with the full bytes of the row that stays; rows whose bytes differ (a collision) are grouped by their bytes instead.

Texts are equal when identical after lower-casing A-Z only. Defined results: null counts as the
empty text, and all empty texts are one group; the largest id stays, a null id only where no other
is; an empty table gives no rows; repeated rows with one id each get a row, all count, and all are
marked alike; rows that repeat an id with other texts belong each to the group of its own text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import docs_of, keep, new_path, scratch, setting, write_table

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of staged digests that one micro-batch takes in at most.
BYTES_PER_BATCH = 16 << 30


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; bytes.lower leaves all other bytes alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(digest_bytes: int):
    def apply(batches):
        for batch in batches:
            texts = [normalised(x) for x in batch.column(1).to_pylist()]
            shas = [hashlib.sha256(x).hexdigest() for x in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "digest": [x[: 2 * digest_bytes] for x in shas], "text_sha256": shas,
                "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "locator": batch.column(2),
            })

    return apply


def _bytes(batches):
    """digest, doc_id, data of rows (digest, doc_id, text); a row that has the id, but another text, goes."""
    for batch in batches:
        digests, data = batch.column(0).to_pylist(), [normalised(x) for x in batch.column(2).to_pylist()]
        right = pa.array([hashlib.sha256(x).hexdigest().startswith(d) for d, x in zip(digests, data)], pa.bool_())
        found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["digest", "doc_id", "data"])
        yield found.filter(right)


def locator(df: DataFrame):
    """File of the row's content where df reads files, else null (the id then finds the content)."""
    try:
        df.select("_metadata.file_path")
        return F.col("_metadata.file_path")
    except Exception as error:
        if "UNRESOLVED" not in str(error):
            raise
        return F.lit(None).cast("string")


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, digest, text_sha256, n_bytes, locator. digest_bytes under 32 weakens the digest, for tests of collisions."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), locator(df).alias("locator"))
    return rows.mapInArrow(_digests(digest_bytes), "doc_id long, digest string, text_sha256 string, n_bytes long, locator string")


def run_state(spark: SparkSession, stream: DataFrame, registry: str, checkpoint: str) -> None:
    """Take in all that the stream has now; the registry gets the digests that this run touched, batch by batch.

    Each row of the registry holds a digest's state after a batch; current() keeps the last one.
    """
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator", "n_bytes")).alias("stays"), F.count("*").alias("n"))

    def sink(batch: DataFrame, number: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        batch.select("digest", F.col("stays.doc_id").alias("stays_id"), F.col("stays.locator").alias("locator"), F.col("stays.n_bytes").alias("n_bytes"), "n").write.mode("overwrite").parquet(f"{registry}/batch={number}")

    store = "spark.sql.streaming.stateStore."
    # with its logs, each of the many small stores would set megabytes aside beforehand
    with setting(spark, store + "providerClass", PROVIDER), setting(spark, store + "rocksdb.allowFAllocate", "false"):
        stream_writer(state, sink, checkpoint).awaitTermination()


def stream_writer(state: DataFrame, sink, checkpoint: str):
    return state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, registry: str) -> DataFrame:
    """digest, stays_id, locator, n_bytes, n after the last batch that touched each digest."""
    schema = "digest string, stays_id long, locator string, n_bytes long, n long, batch int"
    return spark.read.schema(schema).parquet(registry).groupBy("digest").agg(F.max_by(F.struct("stays_id", "locator", "n_bytes", "n"), "batch").alias("s")).select("digest", "s.*")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of df."""
    spark = df.sparkSession
    with scratch():
        rows = keep(write_table(digest_rows(df, id_col, text_col, digest_bytes), "digests"))
        if rows.isEmpty():
            return _empty(spark)
        stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(rows.shared_path)
        registry = new_path(spark, "registry")
        run_state(spark, stream.select("digest", "doc_id", "locator", "n_bytes"), registry, new_path(spark, "stream"))
        state = keep(write_table(current(spark, registry), "state"))

        hits = state.filter("n > 1").select("digest", "stays_id", F.col("n_bytes").alias("stays_bytes"))
        # the texts of hits only, found by id and locator
        wanted = rows.join(hits.select("digest"), "digest").select(F.col("doc_id").alias("id"), F.col("locator").alias("w_locator"), "digest").distinct()
        texts = df.select(F.col(id_col).cast("long").alias("t_id"), F.col(text_col).alias("text"), locator(df).alias("t_locator"))
        texts = texts.join(wanted, F.col("t_id").eqNullSafe(F.col("id")) & F.col("t_locator").eqNullSafe(F.col("w_locator"))).select("digest", F.col("t_id").alias("doc_id"), "text")
        # else the distinct stays where a join has dealt rows by digest, a hot one's in one task
        with setting(spark, "spark.sql.requireAllClusterKeysForDistribution", "true"):
            differing = _differing(texts.mapInArrow(_bytes, "digest string, doc_id long, data binary"), hits)
        if differing is not None:
            keep(differing)
    plain = rows.join(state.select("digest", "stays_id", "n"), "digest").select(
        "doc_id", F.col("stays_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("stays_id")).alias("kept"), "text_sha256"
    )
    return plain if differing is None else _regrouped(rows, state, differing)


def _differing(found: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Rows of hits whose bytes are not those of the row that stays: digest, doc_id, data; None where there are none."""
    found = write_table(found, "hits")
    f, h = found.alias("f"), hits.alias("h")
    stays = f.join(h, (F.col("f.digest") == F.col("h.digest")) & F.col("f.doc_id").eqNullSafe(F.col("h.stays_id"))).select("f.digest", "f.data")
    # written, so that the next join is of two plain shuffles, which Spark can split at a hot digest
    stays = write_table(stays.groupBy("digest").agg(F.max("data").alias("stays_data")), "stays")
    differing = found.join(stays, "digest").filter(F.col("data") != F.col("stays_data")).select("digest", "doc_id", "data")
    differing = write_table(differing, "differing")
    return None if differing.isEmpty() else differing


def _regrouped(rows: DataFrame, state: DataFrame, differing: DataFrame) -> DataFrame:
    """The result where digests collide: rows of such digests are grouped by their bytes."""
    bad = differing.select("digest").distinct()
    variant = differing.select("digest", F.col("doc_id").alias("v_id"), F.col("data").alias("variant")).distinct()
    joined = rows.join(variant, (rows["digest"] == variant["digest"]) & rows["doc_id"].eqNullSafe(variant["v_id"]) & (rows["n_bytes"] == F.octet_length("variant")), "left").select(rows["*"], "variant")
    hit = joined.join(bad, "digest")
    groups = hit.groupBy("digest", "variant").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.withColumnsRenamed({"digest": "g_digest", "variant": "g_variant"})
    fixed = hit.join(groups, (F.col("digest") == F.col("g_digest")) & F.col("variant").eqNullSafe(F.col("g_variant")))
    plain = rows.join(bad, "digest", "left_anti").join(state.select("digest", F.col("stays_id").alias("keep_id"), F.col("n").alias("group_size")), "digest")
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return plain.select(*out).unionByName(fixed.select(*out))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(docs_of(spark, sf_dir))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
