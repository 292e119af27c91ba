"""Spark session and shared-storage helpers.

Cluster settings (shuffle partitions, memory, checkpoint dir) belong to the
deployment; :func:`get_session` only fills in what is unset, so the same code
runs on ``local[8]`` in tests and on a large cluster unchanged.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults applied only where the session (or spark-submit) has not set a value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture costs several JVM round trips per Column call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, app_name: str = "loanscope",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local sessions without a checkpoint folder, by application.
_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it to shared storage. Only a local
    session (tests, a laptop) gets a private scratch folder where it is unset.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or _SCRATCH.get(context.applicationId) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {context.master})")
        path = _SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="loanscope-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not
    from the raw scans) and lets several downstream operators share one scan.
    """
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tables of up to so many rows are taken as they lie; more may be dealt anew.
DEALT_FROM = 1 << 18
#: Most rows that a part of dealt rows has on average.
PART_ROWS = 1 << 20


def many_rows(df: DataFrame) -> bool:
    return df.count() > DEALT_FROM


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` in even parts, two a core or more: files of few row groups are read as few parts."""
    if parts is None:
        parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, *rows.columns)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
