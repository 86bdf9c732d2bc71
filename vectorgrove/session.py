"""Session helpers shared by operators outside the optional subpackages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder named by the session.

    A private folder is chosen only where ``spark.checkpoint.dir`` is unset,
    as in tests on one machine.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def checkpoint_dealt(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """A checkpoint dealt by keys that later joins and groups by these know about, so that the rows stay where they are."""
    return checkpoint_in_place(df.repartition(partitions, *keys))


def checkpoint_in_place(df: DataFrame) -> DataFrame:
    """A checkpoint that is known to be dealt as the rows are.

    An adaptive plan doesn't tell how its rows are dealt, so this one isn't.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, on whichever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
