"""Session helpers: a tuned builder and durable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "boardpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes; ``conf`` overrides any of them.

    On a cluster leave ``master`` unset and let the submit command name it. Shuffles
    there start wide and AQE coalesces them to the advisory size; a local session keeps
    to ``spark.sql.shuffle.partitions``.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Session windows of one busy user merge inside each task before they are shuffled.
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master is None or not master.startswith("local"):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "8000"
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "128m"
        # Window state of large streams belongs on disk, not on the heap.
        settings["spark.sql.streaming.stateStore.providerClass"] = (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        )
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a purely local session may fall back to a temporary folder: on a cluster a
    machine-local path would lose the data together with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # "local-cluster" has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="boardpulse-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_runs: dict[str, list[str]] = {}


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one run; :func:`clear_runs` removes it."""
    folder = os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")
    _runs.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_runs(spark: SparkSession) -> int:
    """Remove the folders of all runs of this application, once their readers are done."""
    folders = _runs.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def pin(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once, keep it in the shared folder and cut its lineage.

    Used where one compact result feeds several branches of a plan. The copy survives
    the loss of executors, unlike a cache held in their memory.
    """
    spark = frame.sparkSession
    shared = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return frame.checkpoint(eager=True)
