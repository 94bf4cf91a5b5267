"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType

#: White space that separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other session a folder
    under the warehouse; the choice is written back to the session so that later calls agree.
    """
    for key in ("spark.checkpoint.dir", "spark.partsmith.scratch.dir"):
        found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
        if found:
            return found.rstrip("/")
    if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.partsmith.scratch.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Lineage ends there, so a lost executor costs nothing, rows that were made once stay the same
    for all later readers, and the planner knows the table's true size: it broadcasts it in a join
    only under ``spark.sql.autoBroadcastJoinThreshold``, and else shuffles.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that no later plan reads, and let Spark drop the shuffles of plans that are done."""
    for df in tables:
        for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()} if df is not None else ():
            remove(df.sparkSession, folder)
    live = next((df for df in tables if df is not None), None)
    if live is not None:
        gc.collect()
        live.sparkSession._jvm.System.gc()  # the context's cleaner follows the driver's garbage collection


def replace(old: DataFrame | None, new: DataFrame, name: str) -> DataFrame:
    """materialize() for loops: the table of the round before goes when the new one is there."""
    out = materialize(new, name)
    if old is not None:
        for f in {p.rsplit("/", 1)[0] for p in old.inputFiles()}:
            remove(new.sparkSession, f)
    return out


def free(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> F.Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def integer_key(df: DataFrame, name: str) -> F.Column:
    """The key as a 64-bit integer; keys of other types raise."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}")
    return column(name).cast("bigint")


def as_string(c) -> F.Column:
    """Text of a key with a fixed stand-in for null."""
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null"))


def bucket(key: str, n: int) -> F.Column:
    """CRC-32 of the key's text modulo n (null: the text ``null``)."""
    return F.crc32(as_string(key)) % F.lit(n)
