"""Session helpers shared by every operator: checkpoints, hot keys, distributed ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Below so many rows a key is never hot, whatever its share.
HOT_FLOOR = 20_000


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one, but only in a single process
    (tests): executors elsewhere would not see it, so a cluster without the setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


_WRITTEN: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _forget() -> None:
    """What this process wrote into the checkpoint folder goes with it, if the session still lives."""
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, for tables that an operator writes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into a written table of the shared checkpoint folder and reads it from there.

    This cuts the lineage, survives the loss of executors, and unlike a checkpointed plan carries no inferred constraints,
    which pile up exponentially over the rounds of iterative operators.
    """
    path = workspace(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Tables written in buckets by the hash of a key, so that joins and sums by that key do not shuffle them again.

    There are as many buckets as shuffle partitions. The tables are gone when the block ends; what shall stay must be cut.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets, self.tables = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def __enter__(self) -> Buckets:
        return self

    def write(self, df: DataFrame, key: str) -> DataFrame:
        name, path = f"buckets_{uuid.uuid4().hex}", workspace(self.spark, "buckets")
        df.repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    def __exit__(self, *_) -> None:
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written under another name, then renamed."""
    jvm = spark.sparkContext._jvm
    draft, final = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.draft", path))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(draft, final)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What write_text wrote; null if there is nothing."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, floor: int = HOT_FLOOR) -> list:
    """Keys of at least max(floor, rows / share) rows: at most `share` of them, so the list is bounded whatever the data."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    big = counts.filter(F.col("count") >= floor).orderBy(F.desc("count"), key).limit(share).collect()
    if not big:
        return []
    least = max(floor, df.count() / share)
    return [r[0] for r in big if r[1] >= least]


def skew_join(big: DataFrame, unique: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """big join unique on `key`, where `unique` holds each key once.

    The hot keys (see hot_keys: at most HOT_SHARE) take their one row each by broadcast; all others shuffle, and none of
    those holds more than 1/HOT_SHARE of the rows. how: inner or left.
    """
    if not hot:
        return big.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = big.filter(~is_hot).join(unique.filter(~is_hot), key, how)
    warm = big.filter(is_hot).join(F.broadcast(unique.filter(is_hot)), key, how)
    return cold.unionByName(warm)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Adds `rank` (1, 2, ...) in the order given, by range partitions and their offsets: no partition holds everything.

    `order` must be total, or the rank among equals is arbitrary. The offsets table has one row per partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy("_part").agg(F.count("*"), F.min("_in")).collect())
    rows, total = [], 0
    for part, n, first in sizes:
        rows.append((part, total - first + 1))
        total += n
    if not rows:
        return placed.drop("_part", "_in").withColumn(rank, F.lit(None).cast("long"))
    offsets = spark.createDataFrame(rows, "_part int, _off long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")
