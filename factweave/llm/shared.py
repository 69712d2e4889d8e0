"""Helpers of the training-data operators: tables in the shared folder, and runs of rows."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of an Arrow batch that goes to a Python worker, which holds a few copies of it.
ARROW_BATCH = "8m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_scopes: list[dict[str, SparkSession]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="factweave-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1][path] = spark
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting that holds within the block only."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


@contextlib.contextmanager
def scratch():
    """Tables written within the block are removed at its end, but for those that are given to keep()."""
    mine: dict[str, SparkSession] = {}
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path, spark in mine.items():
            _delete(spark, path)


def keep(table: DataFrame) -> DataFrame:
    """Hand a table of the innermost scratch() to the one around it."""
    path = table.shared_path
    spark = _scopes[-1].pop(path, None)
    if spark is not None and len(_scopes) > 1:
        _scopes[-2][path] = spark
    return table


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _BATCH_SETTING, ARROW_BATCH):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def delete_table(table: DataFrame) -> None:
    """Remove a table that write_table made and that nothing reads any more."""
    for scope in _scopes:
        scope.pop(table.shared_path, None)
    _delete(table.sparkSession, table.shared_path)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; what a query returns is run by its caller, so the batch size stays set in the session."""
    spark.conf.set(_BATCH_SETTING, ARROW_BATCH)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def runs(batches, keys: list[str]):
    """Runs of equal keys over Arrow batches that are sorted by them; yields (key, list of Arrow slices)."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for key, group in itertools.groupby(zip(*columns)):
            n = sum(1 for _ in group)
            if current is not None and key != current:
                yield current, held
                held = []
            current = key
            held.append(batch.slice(start, n))
            start += n
    if held:
        yield current, held
