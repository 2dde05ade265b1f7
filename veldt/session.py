"""The Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "veldt", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder's path that driver and executors share: below ``spark.checkpoint.dir``.

    Where that is unset, and driver and executors are one process (a local master), a temporary folder serves.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="veldt-")
    return f"{top.rstrip('/')}/veldt-{uuid.uuid4().hex}"
