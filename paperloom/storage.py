"""Where intermediate tables go.

A cluster names a shared folder in ``spark.checkpoint.dir``. It is read from the session;
only where it is unset (single-machine tests) is a local one chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Texts or their words in one batch between Spark and Python: a few MB, where 10,000 take tens of MB on both sides of every task.
TEXT_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def runs_on_one_machine(master: str) -> bool:
    """Whether driver and tasks share a disk: ``local`` or ``local[...]``."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only on one machine a local one stands in for it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not runs_on_one_machine(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="paperloom-"))
    return configured or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for one run's table or stream sink."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The lineage ends at reliable storage, so losing an executor repeats no earlier step.
    Readers of the table prune columns, and its known size lets Spark choose join types.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside takes at most ``TEXT_ROWS`` rows to Python at a time; a smaller setting of the session stays."""
    before = spark.conf.get(BATCH_CONF)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(BATCH_CONF, TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def spread_rows(df: DataFrame) -> DataFrame:
    """Give heavy per-row work at least one partition per core.

    Only a table of fewer partitions than cores is redistributed, as one with a few large
    row groups is; a large table already has more and is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
