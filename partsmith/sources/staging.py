"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "spark.partsmith.staging.dir"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, one temporary folder of a local session, else a folder under the warehouse."""
    for key in ("spark.checkpoint.dir", OWN):
        found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
        if found:
            return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set(OWN, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read again: what several later steps read is computed once, and lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
