"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "clipsight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; cluster settings win elsewhere.

    The number of shuffle partitions is left to the cluster's own configuration
    (adaptive execution coalesces small ones and splits skewed ones).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master may fall back to /tmp."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clipsight-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def work_folder(spark: SparkSession) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``; whoever owns that folder clears it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        ensure_checkpoint_dir(spark)
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/clipsight-{uuid.uuid4().hex}"
