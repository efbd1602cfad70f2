"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here have thousands of column expressions; recording a Python call site for each takes seconds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_local_scratch: str | None = None


def build_session(master: str | None = None, app: str = "palisade", **conf: str) -> SparkSession:
    """A session with the defaults above; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate tables and stream checkpoints.

    Lies in the shared folder named by ``spark.checkpoint.dir``.  Where that is unset, a local session gets a temporary folder that is removed at
    exit; a cluster has no folder of its own that all executors see, so there it is an error.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return f"{base.rstrip('/')}/palisade/{name}-{uuid.uuid4().hex}"
