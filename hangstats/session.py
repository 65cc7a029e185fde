"""Session settings and the scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Directory values such as 20141106 or 36.0 stay text.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key costs its earlier values, not the whole VARIANT (parse_pings sets this by itself).
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Bounds what a Python worker gets at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app: str = "hangstats", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; keyword ``a__b`` sets option ``a.b``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: the one the cluster names, else the session's warehouse.

    A warehouse on the driver's own disk is no such folder unless everything
    runs on that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    if not named and not alone and base.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path below the shared folder."""
    return f"{shared_folder(spark)}/hangstats-{label}-{uuid.uuid4().hex}"
