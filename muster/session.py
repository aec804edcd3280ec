"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(name: str = "muster", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session for scripts. On a cluster the submit command names the master and sizes."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where that costs one more shuffle behind the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **(conf or {}),
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a temporary folder of its
    own machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="muster-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """New folder below the shared one."""
    return os.path.join(shared_base(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder and read from there from now on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()
