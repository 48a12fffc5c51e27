"""A table of the last record of each key, laid out by a hash of the key, so that an upsert rewrites the buckets it touches.

root/data/version=n/bucket=b holds bucket b as version n wrote it. root/manifest-n.json names, for each bucket, the version that is
current; it appears by a rename, after all of its data. Readers take the newest manifest; buckets that were replaced go
after the next manifest is there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.operators.clean import last_wins

BUCKETS = 64


class Bucketed:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = ("item_id",), buckets: int = BUCKETS):
        """schema has `ord`, the place of a record in the log. A table that is there keeps the number of buckets that it was made with."""
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self.manifest() or {"buckets": buckets})["buckets"]

    def _manifests(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(x.getPath().getName()[9:-5]) for x in found)

    def manifest(self) -> dict | None:
        """version, batch, buckets, of (bucket: version); at most `buckets` entries."""
        known = self._manifests()
        if not known:
            return None
        held = self._files.open(self._path(f"{self.root}/manifest-{known[-1]}.json"))
        try:
            return json.loads(bytes(held.readAllBytes()).decode())
        finally:
            held.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(F.to_json(F.struct(*self.keys))), F.lit(self.buckets)).cast("int")

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        return self._rows((self.manifest() or {"of": {}})["of"])

    def upsert(self, new: DataFrame, batch: int | None = None) -> int:
        """The last record of each key by ord, new ones after old ones; returns how many buckets were rewritten.

        A batch whose number the table has seen already changes nothing.
        """
        before = self.manifest() or {"version": 0, "batch": -1, "buckets": self.buckets, "of": {}, "top": -1}
        if batch is not None and batch <= before["batch"]:
            return 0
        new = new.select(*self.schema.names).withColumn("_bucket", self._bucket())
        sizes = new.groupBy("_bucket").agg(F.max("ord").alias("top")).collect()  # a row a bucket
        touched = {str(r._bucket) for r in sizes}
        version = before["version"] + 1
        if touched:
            old = self._rows({b: v for b, v in before["of"].items() if b in touched}).withColumn("_bucket", self._bucket())
            both = old.unionByName(new.withColumn("ord", F.col("ord") + before["top"] + 1))
            last = last_wins(both.withColumn("_key", F.to_json(F.struct(*self.keys))), "_key").select(*self.schema.names, F.col("_bucket").alias("bucket"))
            last.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/version={version}")
        top = max([before["top"], *[before["top"] + 1 + r.top for r in sizes]])
        after = {"version": version, "batch": before["batch"] if batch is None else batch, "buckets": self.buckets, "of": before["of"] | dict.fromkeys(touched, version), "top": top}
        self._commit(after)
        self._clean(before, after)
        return len(touched)

    def _commit(self, manifest: dict) -> None:
        under_way = self._path(f"{self.root}/_manifest-{manifest['version']}")
        out = self._files.create(under_way, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._files.rename(under_way, self._path(f"{self.root}/manifest-{manifest['version']}.json")):
            raise RuntimeError(f"version {manifest['version']} of {self.root} is there already: another writer was first")

    def _clean(self, before: dict, after: dict) -> None:
        for b, v in before["of"].items():
            if after["of"][b] != v:
                self._files.delete(self._path(f"{self.root}/data/version={v}/bucket={b}"), True)
        for v in set(before["of"].values()) - set(after["of"].values()):
            self._files.delete(self._path(f"{self.root}/data/version={v}"), True)
        for n in self._manifests()[:-1]:
            self._files.delete(self._path(f"{self.root}/manifest-{n}.json"), False)
