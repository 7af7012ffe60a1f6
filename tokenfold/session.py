"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tokenfold")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("TOKENFOLD_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    ``spark.checkpoint.dir`` is honoured when set. Without it only a local
    master may fall back to a folder of its own; a cluster must name one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tokenfold-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write out a small learnt table (counts, weights, selections) once.

    Later steps plan against the stored rows, so plans do not nest and a lost
    executor does not replay the scan behind them.
    """
    return cut_lineage(df)


def keep(df: DataFrame) -> DataFrame:
    """Cache a table that one operator reads several times."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: Rows of a learnt table up to which joins send it to the rows it is met with.
SENT_ROWS = 1 << 15


def sent(learnt: DataFrame, most: int | None = None) -> DataFrame:
    """A settled table for a join; a small one goes to the other side's rows, which then need no shuffle."""
    most = SENT_ROWS if most is None else most
    return F.broadcast(learnt) if learnt.limit(most + 1).count() <= most else learnt


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one that a local session falls back to."""
    settle(spark.range(1))  # a session without the setting gets its folder here
    return spark.conf.get("spark.checkpoint.dir", None) or str(spark.sparkContext.getCheckpointDir()).rsplit("/", 1)[0]


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
