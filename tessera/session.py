"""Sessions with the settings that the engine's plans rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names, by application; in the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def scratch_table(rows: DataFrame, name: str) -> DataFrame:
    """Write rows in a new scratch folder and read them again."""
    path = f"{scratch(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
