"""A store of versions in a folder: a version is written beside the others, checked, then named."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class StoreCorrupt(Exception):
    """What was written is not what was asked for."""


def _mark(df: DataFrame) -> tuple:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, store: str, version: str) -> DataFrame:
    """Write df as a version of the store, and read it back.

    The rows go to a folder of their own; counts and checksums of what was read again must equal
    those of df, which must give the same rows each time it runs. One rename names the version, so
    readers see all of it or nothing. A version that is there already stays as it is.
    """
    spark = df.sparkSession
    target = f"{store}/version={version}"
    fs, final = _fs(spark, target)
    if not fs.exists(final):
        staged = f"{store}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        if _mark(spark.read.schema(df.schema).parquet(staged)) != _mark(df):
            fs.delete(_fs(spark, staged)[1], True)
            raise StoreCorrupt(version)
        if not fs.rename(_fs(spark, staged)[1], final) and not fs.exists(final):
            raise StoreCorrupt(version)
    return spark.read.schema(df.schema).parquet(target)


def versions(spark: SparkSession, store: str) -> list[str]:
    """Names of the versions of a store, in order; staged ones have none yet."""
    fs, path = _fs(spark, store)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))


def retain(spark: SparkSession, store: str, keep: set[str]) -> list[str]:
    """Delete the versions that keep does not name; returns their names."""
    gone = [v for v in versions(spark, store) if v not in keep]
    for v in gone:
        fs, path = _fs(spark, f"{store}/version={v}")
        fs.delete(path, True)
    return gone
