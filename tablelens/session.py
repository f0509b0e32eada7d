"""Session helpers: a local session for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(master: str | None = None, app: str = "tablelens") -> SparkSession:
    """A local session with the settings the tests and bench rely on.

    On a cluster, build the session with the cluster's own settings instead;
    nothing in the library depends on this function.
    """
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def conf_override(spark: SparkSession, key: str, value: str):
    """Set one SQL setting for the duration of a block (the actions inside
    it are planned with it), then restore the previous value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (tests) gets a scratch folder of
    its own; on a cluster the setting is needed.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tablelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Keep a frame that several later jobs reuse.

    ``reliable=True`` cuts lineage with ``checkpoint()`` into the shared
    ``spark.checkpoint.dir`` (only if the session names one); otherwise the
    frame is cached, and a lost executor just recomputes its partitions from
    lineage.  Never a machine-local checkpoint.
    """
    if reliable:
        sc = df.sparkSession.sparkContext
        has_dir = bool(sc.getCheckpointDir()) if hasattr(sc, "getCheckpointDir") else False
        if not has_dir:
            conf_dir = df.sparkSession.conf.get("spark.checkpoint.dir", None)
            if conf_dir:
                sc.setCheckpointDir(conf_dir)
                has_dir = True
        if has_dir:
            return df.checkpoint(eager=True)
    return df.cache()
