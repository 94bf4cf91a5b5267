"""Incremental intake: new files are merged by path once, and metrics keep a bounded history as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import merge_catalogue
from ..operators.metrics import HISTORY
from ..sources.store import Store


def new_files(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream over the Parquet files that land in a folder; each revision of a document is a file of its own."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def latest_by_path(batch: DataFrame, version: str = "mtime") -> DataFrame:
    w = Window.partitionBy("relative_path").orderBy(F.col(version).desc())
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_into(target: str, buckets: int = 64):
    """A foreachBatch sink that replaces documents by path in the store ``target``, the latest of each path in a batch."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_catalogue(Store(batch.sparkSession, target, buckets), {"documents": latest_by_path(batch)}, batch_id)

    return merge


STATS = "metric string, count bigint, sum double, avg double, min double, max double, p99 double"


def history_stats(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """Per metric the numbers of its last n values, as state; rows of a batch count in order of ts, event_id."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        values = (values + rows["value"].tolist())[-n:]
        state.update((values,))
        s = sorted(values)
        yield pd.DataFrame([(key[0], len(s), sum(values), sum(values) / len(s), s[0], s[-1], s[min(int(0.99 * len(s)), len(s) - 1)])], columns=["metric", "count", "sum", "avg", "min", "max", "p99"])

    return log.groupBy("metric").applyInPandasWithState(update, STATS, "values array<double>", "update", GroupStateTimeout.NoTimeout)
