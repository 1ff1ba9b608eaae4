"""Session helpers: shared folders and the settings the jobs expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. In local mode without one, a temporary one that ends with the process."""
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lurelens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder that is already set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder name for one written table or one stream's progress log."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` for costly work on each of them. A table of short rows is a small file, however many rows it
    has, and one task would read it and do all that follows. The number of parts is fixed: Spark would join parts by size."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A step that several others read, written to the shared folder and read back."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
