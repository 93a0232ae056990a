"""Session set-up for local work, and the folders a job may write to."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench use; on a cluster spark-submit sets its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docaudit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; one is made only where none is set and all runs on this machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docaudit-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of whatever file system its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a DataFrame as a table in the shared folder and reads it again; all go at the end.

    For loops of joins: a checkpoint keeps the size that the optimizer expects, and where each round multiplies that
    by itself, planning comes to a standstill after some ten rounds. A table has the size of its files.
    """
    folder, nth = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", itertools.count()

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(nth)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield kept
    finally:
        delete_folder(spark, folder)
