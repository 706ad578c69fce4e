"""A keyed table in buckets for streams: each batch rewrites only the buckets that it touches, once, whatever is retried."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import read_text, remove, write_text

ROWS = "bucket int, kind string, key string, ord long, value string"


class KeyedStore:
    """(kind, key) -> the value with the greatest ord. path: a folder that all executors share; buckets: fixed for its life.

    A version of a bucket is a folder; the manifest names the version of each bucket, the last batch, and the mark. A batch
    that dies before its manifest leaves everything as it was; one that is sent again after it does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        saved = json.loads(read_text(spark, f"{path}/manifest") or "{}")
        self.at = {int(b): v for b, v in saved.get("at", {}).items()}
        self.batch, self.mark, self.jobs = saved.get("batch", -1), saved.get("mark"), saved.get("jobs", [])

    def _read(self, buckets: set[int]) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for b, v in sorted(self.at.items()):
            if b in buckets:
                by_version.setdefault(v, []).append(b)
        parts = [self.spark.read.schema(ROWS).option("basePath", f"{self.path}/v{v}").parquet(*(f"{self.path}/v{v}/bucket={b}" for b in bs)).select("bucket", "kind", "key", "ord", "value") for v, bs in by_version.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ROWS)

    def _bucket(self):
        return F.pmod(F.xxhash64("kind", "key"), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """(kind, key, ord, value) of the whole table."""
        return self._read(set(self.at)).drop("bucket")

    def upsert(self, rows: DataFrame, batch: int, mark: str | None = None, job: dict | None = None) -> None:
        """rows(kind, key, ord, value), null keys left out. Then, with the manifest, the mark moves on (never back)."""
        if batch <= self.batch:
            return
        last = lambda df: df.groupBy("bucket", "kind", "key").agg(F.max(F.struct("ord", "value")).alias("r")).select("bucket", "kind", "key", "r.*")
        new = last(rows.filter("kind is not null and key is not null").withColumn("bucket", self._bucket())).persist()
        touched = {r[0] for r in new.select("bucket").distinct().collect()}
        version, old = batch, dict(self.at)
        if touched:
            merged = last(new.unionByName(self._read(touched)))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        new.unpersist()
        self.at |= {b: version for b in touched}
        self.batch, self.mark = batch, max(filter(None, (self.mark, mark)), default=None)
        self.jobs = [*self.jobs, job or {}]
        write_text(self.spark, f"{self.path}/manifest", json.dumps({"at": self.at, "batch": batch, "mark": self.mark, "jobs": self.jobs}))
        for b in touched & set(old):
            remove(self.spark, f"{self.path}/v{old[b]}/bucket={b}")
