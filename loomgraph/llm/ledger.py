"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger holds one row per canonical key: its number of copies and its earliest representative. It is kept in buckets by
the key's hash. A new batch is aggregated by key first (map-side, so a key with a third of the rows costs one row per task),
then full-outer-joined with just the buckets it touches; counts add up, the earliest representative stays. Untouched buckets
are not read or written. Each update writes a new version of the touched buckets and then the manifest that names, per
bucket, its latest version; an update that died before its manifest leaves the ledger as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import is_blank, pair_key
from loomgraph.operators.orphans import sql_key, sql_not_blank
from loomgraph.runtime import HOT_FLOOR, HOT_SHARE, cut, read, remove, skew_join, workspace

ROWS = "bucket int, key string, copies long, keep_id long"


class CanonicalLedger:
    """path: a folder all executors share. buckets: fixed for the ledger's life (its manifest has so many rows)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.version, self.at = 0, {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 64) -> CanonicalLedger:
        """The ledger as of its last complete manifest."""
        ledger = cls(spark, path, buckets)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[1:]) for n in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS"))]
        if done:
            ledger.version = max(done)
            ledger.at = {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/v{ledger.version}").collect()}
        return ledger

    def _read(self, buckets: set[int] | None = None) -> DataFrame:
        want = [(b, v) for b, v in sorted(self.at.items()) if buckets is None or b in buckets]
        if not want:
            return self.spark.createDataFrame([], ROWS)
        by_version: dict[int, list[int]] = {}
        for b, v in want:
            by_version.setdefault(v, []).append(b)
        parts = [self.spark.read.schema(ROWS).option("basePath", f"{self.path}/v{v}").parquet(f"{self.path}/v{v}").filter(F.col("bucket").isin(bs)) for v, bs in by_version.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("bucket", "key", "copies", "keep_id")

    def rows(self) -> DataFrame:
        """(key, copies, keep_id) of all keys."""
        return self._read().drop("bucket")

    def update(self, batch: DataFrame) -> None:
        """batch(key, id): adds each key's copies and lowers its representative to the smallest id. Null keys are left out."""
        new = batch.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        new = new.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        version = self.version + 1
        if self.at:
            staged = f"{self.path}/batch{version}"
            new.write.mode("overwrite").parquet(staged)
            new = self.spark.read.parquet(staged)
            touched = {r[0] for r in new.select("bucket").distinct().collect()}
            old = self._read(touched)
            merged = old.join(new, ["bucket", "key"], "full_outer").select("bucket", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("keep_id", "first").alias("keep_id"))
        else:
            merged = new.select("bucket", "key", F.col("n").alias("copies"), F.col("first").alias("keep_id"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        written = {r[0] for r in self.spark.read.schema(ROWS).parquet(f"{self.path}/v{version}").select("bucket").distinct().collect()}
        self.at = self.at | {b: version for b in written}
        self.version = version
        self.spark.createDataFrame(sorted(self.at.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        remove(self.spark, f"{self.path}/batch{version}")

    def vacuum(self) -> None:
        """Deletes the versions that no bucket of the last manifest is in, and the manifests before it. Not while a frame of an
        earlier state is still to be read."""
        live = set(self.at.values())
        for v in range(1, self.version + 1):
            if v not in live:
                remove(self.spark, f"{self.path}/v{v}")
            if v < self.version:
                remove(self.spark, f"{self.path}/manifest/v{v}")


def entity_keys(entities: DataFrame) -> DataFrame:
    """(id, key) of the rows with a non-blank name; a null type is a blank one."""
    return entities.filter(~is_blank(F.col("name"))).select(F.col("entity_id").alias("id"), pair_key(F.col("name"), F.col("type")).alias("key"))


def in_batches(rows: DataFrame, ledger: CanonicalLedger, batches: int) -> CanonicalLedger:
    """Feeds rows(id, key) to the ledger in `batches` ranges of id, as if they had arrived one after another."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ledger
    step = (high - low) // batches + 1
    for i in range(batches):
        ledger.update(rows.filter(F.col("id").between(low + i * step, low + (i + 1) * step - 1)))
    ledger.vacuum()
    return ledger


def duplicates(rows: DataFrame, ledger: CanonicalLedger, share: int = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """(keep_id, dup_id) of rows(id, key): every row whose key has an earlier representative in the ledger.

    Keys with at least max(floor, rows / share) copies are at most `share` many; they meet their rows by broadcast, all others
    by a shuffle in which no key holds more than that.
    """
    several = ledger.rows().filter("copies > 1")
    total = several.agg(F.sum("copies")).first()[0] or 0
    least = max(floor, total / share)
    hot = [r.key for r in several.filter(F.col("copies") >= least).select("key").collect()]
    return skew_join(rows, several.select("key", "keep_id"), "key", hot).filter("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))


def p1_ledger(spark: SparkSession, d: str) -> tuple[DataFrame, CanonicalLedger]:
    """The keyed rows, derived once, and the ledger filled with them in three batches, in buckets of some two million keys at most."""
    rows = cut(entity_keys(read(spark, d, "entities")))
    return rows, in_batches(rows, CanonicalLedger(spark, workspace(spark, "ledger"), max(12, rows.count() // 2_000_000)), 3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(keep_id, dup_id) through the ledger, filled in three batches.

    Names of white space and invisible characters only are blank and take no part; names of punctuation only are equal to each
    other. Equal rows are copies. An empty table gives an empty result.
    """
    return duplicates(*p1_ledger(spark, d))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct entity: its representative and its number of copies."""
    return p1_ledger(spark, d)[1].rows().select("keep_id", "copies")


_KEYED = f"WITH k AS (SELECT entity_id, {sql_key('name', 'type')} AS k FROM entities WHERE {sql_not_blank('name')}), m AS (SELECT k, min(entity_id) AS keep_id, count(*) AS copies FROM k GROUP BY k) "
QUERIES = {"p1_found": p1_found, "p1_copies": p1_copies}
SQL = {
    "p1_found": _KEYED + "SELECT keep_id, entity_id AS dup_id FROM k JOIN m USING (k) WHERE entity_id <> keep_id",
    "p1_copies": _KEYED + "SELECT keep_id, copies FROM m",
}
