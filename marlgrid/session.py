"""Session settings, table access and the one place that cuts lineage.

Everything here works on any cluster manager: the shared folder for
checkpoints is the session's ``spark.checkpoint.dir``; a local one is set only
where the session names none (tests, a laptop).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What a session of this engine needs; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stored results go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "marlgrid", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table of the data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage; sets a local one only if none is named."""
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named:
        return named
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = os.path.join(tempfile.gettempdir(), f"marlgrid-checkpoints-{os.getpid()}")
    context.setCheckpointDir(wanted)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on.

    Used where a result is read more than once or feeds driver-side planning;
    the stored copy survives the loss of any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
