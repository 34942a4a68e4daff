"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: which store holds the state of streams; Spark's own choice keeps it on the heap, one table for each operator
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "memberlens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; ``settings`` override single options.

    Shuffle partitions are left to the cluster: adaptive execution coalesces small ones and splits
    skewed ones. Tests and the bench pass a small number for local runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # state of streams lies on disk, not on the heap
        STATE_STORE: ON_DISK,
        # call sites of column expressions cost more than building the reports themselves
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **settings,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_state_on_disk(spark: SparkSession) -> None:
    """Streams that ``spark`` starts from now on keep their state on disk, unless a store of another kind is set.

    A stream that goes on from a checkpoint stays with the store noted there.
    """
    if spark.conf.get(STATE_STORE) == ON_HEAP:
        spark.conf.set(STATE_STORE, ON_DISK)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (a laptop or a test) is a temporary one set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running this job")
    folder = named or tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)
    return folder


def stage(frame: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``frame`` once to the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimiser the true size, so a
    small result is broadcast and a large one is not.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = frame.write
    if partition_by:
        # few files per folder, while a hot folder is still split over several writers
        writer = frame.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
