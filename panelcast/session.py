"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelcast", master: str | None = None, shuffle_partitions: int | None = None):
    """Session with adaptive execution and skew-join splitting on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Windows and per-series fits are heavy per byte: keep small stages spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Driver and executors share one JVM here; a cluster sets its own sizes
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="panelcast-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: Rows of one task of a sort or window, and rows that are worth a task of their own
ROWS_OF_TASK = 200_000
ROWS_WORTH_A_TASK = 10_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows of a key together, in as many tasks as the number of rows asks for.

    Adaptive execution sizes tasks by compressed bytes, of which a weekly row has ten; sorts and windows hold it in
    hundreds. Windows, aggregates and joins that have the keys among theirs need no other exchange.
    """
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_WORTH_A_TASK))
    return df.repartition(max(1, few, -(-rows // ROWS_OF_TASK)), *keys)
