"""Bucketed tables with versions: a commit writes only the buckets that it touches, and becomes visible at once.

Layout of a store's folder (any file system that Spark knows):

    data/<table>/version=<n>/bucket=<b>/*.parquet     rows of one bucket that commit n wrote
    manifest/<n>.json                                 which versions make up each bucket after commit n

A commit writes its files first and its manifest last, by a rename; what fails before leaves the store as it
was. A commit that carries a batch number is done once: a repeated batch changes nothing. Readers use the
newest manifest, and files that it names stay while ``keep`` later ones are written.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def bucket(self, key) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that occur in column bucket: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select("bucket").distinct().collect())

    # manifests

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "batch": -1, "tables": {}, "schemas": {}}
        stream = self._fs().open(self._path("manifest", f"{version or known[-1]}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        draft, final = self._path("manifest", f"_{manifest['version']}"), self._path("manifest", f"{manifest['version']}.json")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs().rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} was committed by another job")

    # tables

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows with their bucket; of those buckets alone if they are named. Other files are not listed."""
        found = self.manifest()
        if table not in found["schemas"]:
            raise KeyError(table)
        schema = StructType.fromJson(json.loads(found["schemas"][table]))
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.folder}/data/{table}/version={v}/bucket={b}" for b, vs in found["tables"][table].items() if wanted is None or int(b) in wanted for v in vs]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(None).cast("int"))
        rows = self.spark.read.schema(StructType([*schema.fields]).add("version", LongType()).add("bucket", IntegerType())).option("basePath", f"{self.folder}/data/{table}")
        return rows.parquet(*paths).drop("version")

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]], append: tuple[str, ...] = (), sort: dict[str, list[str]] | None = None, batch: int | None = None, keep: int = 1) -> int:
        """Write tables as (rows with column bucket, the buckets that they replace; None: all buckets).

        Rows of the tables of ``append`` come to what their buckets hold. Returns the version, that of before if the batch was done already.
        """
        before = self.manifest()
        if batch is not None and batch <= before["batch"]:
            return before["version"]
        now = {**json.loads(json.dumps(before)), "version": before["version"] + 1}
        if batch is not None:
            now["batch"] = batch
        for table, (rows, replaced) in changes.items():
            out = rows.repartition("bucket").sortWithinPartitions("bucket", *(sort or {}).get(table, []))
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{table}/version={now['version']}")
            held = {} if replaced is None and table not in append else now["tables"].get(table, {})
            written = [n.removeprefix("bucket=") for n in self._names("data", table, f"version={now['version']}") if n.startswith("bucket=")]
            if table not in append:
                held = {b: vs for b, vs in held.items() if int(b) not in set(replaced or ())}
            now["tables"][table] = held | {b: [*(held.get(b, []) if table in append else []), now["version"]] for b in written}
            now["schemas"][table] = rows.drop("bucket").schema.json()
        self._publish(now)
        self.vacuum(keep)
        return now["version"]

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the newest and ``keep`` before it, and the files that none of those name."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-1 - keep :]]
        named = {(t, v, b) for m in kept for t, bs in m["tables"].items() for b, vs in bs.items() for v in vs}
        for table in self._names("data"):
            for version in self._names("data", table):
                v = int(version.removeprefix("version="))
                if v > known[-1]:
                    continue  # of a commit under way
                there = [n.removeprefix("bucket=") for n in self._names("data", table, version) if n.startswith("bucket=")]
                left = [b for b in there if (table, v, b) in named]
                if not left:
                    self._fs().delete(self._path("data", table, version), True)
                for b in set(there) - set(left) if left else ():
                    self._fs().delete(self._path("data", table, version, f"bucket={b}"), True)
        for v in known[: -1 - keep]:
            self._fs().delete(self._path("manifest", f"{v}.json"), False)
