"""Session defaults and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every casekit job relies on. Timestamps in the case tables are
# TIMESTAMP_NTZ, so results do not depend on the zone; UTC keeps printed
# values stable.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows of a task that trains or predicts, tasks up to which that holds, and rows that a task never exceeds by much.
TASK_ROWS, TASKS, MOST_TASK_ROWS = 1 << 15, 128, 1 << 18


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "casekit",
                extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster pass the cluster master and keep the
    cluster's own ``spark.checkpoint.dir``; we only set one when it is unset."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A folder the caller set on the context stays; else ``spark.checkpoint.dir`` (the
    cluster names a shared folder there) is registered. With neither, a scratch
    folder is made on a ``local[...]`` master only, where driver and executors
    share their disk; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return d or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="casekit-ckpt-", dir=os.environ.get("CASEKIT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``cut_lineage``, and the rows dealt anew where one partition has too many for a task.

    Adaptive shuffles size partitions by bytes, which says nothing about the work a learner has with a narrow row. A task
    gets about ``TASK_ROWS`` rows, beyond ``TASKS`` tasks more, and never over ``MOST_TASK_ROWS``; the number depends on the rows alone.
    """
    df = cut_lineage(df)
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    rows = min(max(TASK_ROWS, (n or 0) // TASKS), MOST_TASK_ROWS)
    return df if (largest or 0) <= 2 * rows else cut_lineage(df.repartition(-(-n // rows)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
