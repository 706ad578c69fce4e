"""Structured Streaming: incremental ingestion with upserts per micro-batch, event-time windows, sessions, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.runtime import read, workspace
from loomgraph.streaming.store import KeyedStore


def caught_up(query) -> None:
    """Waits for a stream that ends once it has caught up; its error is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest(source: DataFrame, path: str, key: str, columns: list[str], order: str | None = None) -> KeyedStore:
    """Upserts a stream of rows into a keyed store: the last by the time `order` wins, then by the columns' values; without an
    order, the micro-batch that came last. A micro-batch rewrites the buckets that it touches and no other, and counts once
    however often it is tried."""
    spark = source.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**62))) if order else F.lit(batch_id).cast("long")
        rows = batch.select(F.lit("row").alias("kind"), F.col(key).alias("key"), at.alias("ord"), F.to_json(F.struct(*columns)).alias("value"))
        KeyedStore(spark, f"{path}/store").upsert(rows, batch_id)

    caught_up(source.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return KeyedStore(spark, f"{path}/store")


def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Papers streamed file by file as they are, with all repeats and updates, into a table of one row per title."""
    path = workspace(spark, "ingest")
    p = read(spark, d, "papers").select("title", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), "ingested_at")
    p.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    rows = ingest(stream, path, "title", ["arxiv_id"], "ingested_at").rows()
    at = F.timestamp_micros("ord").cast("timestamp_ntz")
    return rows.select(F.col("key").alias("title"), F.get_json_object("value", "$.arxiv_id").alias("arxiv_id"), F.when(F.col("ord") > -(2**62), at).alias("ingested_at"))


def live_events(spark: SparkSession, d: str, path: str, columns: list[str]) -> DataFrame:
    """The events as a stream of one file, with instants as times."""
    e = read(spark, d, "events").select(*columns).withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{path}/in")
    return spark.readStream.schema(e.schema).parquet(f"{path}/in")


def stored(rows: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream into a folder and reads it; in complete mode each batch replaces the last one."""
    spark = rows.sparkSession
    if mode == "append":
        out = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    else:
        out = rows.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/out"))
    caught_up(out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, as a stream in complete mode."""
    path = workspace(spark, "windows")
    agg = live_events(spark, d, path, ["ts", "event_type"]).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return stored(agg.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), path, "complete")


def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events per two hours, every hour, as a stream in complete mode."""
    path = workspace(spark, "sliding")
    agg = live_events(spark, d, path, ["ts"]).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return stored(agg.select(F.col("window.start").cast("timestamp_ntz").alias("since"), "n"), path, "complete")


def q_session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each user with their first event and number of events: a visit ends six hours after its last event."""
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    agg = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("since"), "n")


def rate_limit(hits: DataFrame, most: int = 10, window_s: float = 60.0) -> DataFrame:
    """hits(key, ts, id) -> (key, id, allowed): a hit is allowed if fewer than `most` allowed ones lie within the window before
    it. Rejected hits do not count, so each key is a fold; it is streamed in order, holding at most `most` times."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, log = None, []
        for f in frames:
            ok = []
            for k, t in zip(f["key"], f["t"]):
                if k != at:
                    at, log = k, []
                log = [x for x in log if x >= t - window_s]
                ok.append(len(log) < most)
                if ok[-1]:
                    log.append(t)
            yield pd.DataFrame({"key": f["key"], "id": f["id"], "allowed": ok})

    timed = hits.select("key", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return timed.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(fold, "key long, id long, allowed boolean")


def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return rate_limit(e, most=3, window_s=86400.0).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("hits"))


def rate_limit_live(hits: DataFrame, most: int, window_s: float) -> DataFrame:
    """The same on a stream of hits(key, ts, id): the state of a key is the times of its allowed hits within the window."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        hits_ = pd.concat(list(frames)).sort_values(["t", "id"])
        ok = []
        for t in hits_["t"]:
            log = [x for x in log if x >= t - window_s]
            ok.append(len(log) < most)
            if ok[-1]:
                log.append(t)
        state.update((log,))
        yield pd.DataFrame({"key": key[0], "id": hits_["id"], "allowed": ok})

    timed = hits.select("key", "id", (F.unix_micros("ts") / F.lit(1e6)).alias("t"))
    return timed.groupBy("key").applyInPandasWithState(fold, "key long, id long, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def q_rate_limit_live(spark: SparkSession, d: str) -> DataFrame:
    path = workspace(spark, "limits")
    live = live_events(spark, d, path, ["user_id", "ts", "event_id"]).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return stored(rate_limit_live(live, 3, 86400.0), path, "append").groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("hits"))


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each user: events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = read(spark, d, "events").withColumn("new", F.when(gap.isNull() | (gap > 6 * 3600 * 1_000_000), 1).otherwise(0))
    return e.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("events"))


QUERIES = {"incremental_ingest": q_ingest, "event_windows": q_windows, "event_windows_sliding": q_sliding, "event_session_windows": q_session_windows, "rate_limit_sliding_window": q_rate_limit, "rate_limit_stream": q_rate_limit_live, "event_sessions": q_sessions}
SQL = {
    "incremental_ingest": "SELECT title, arxiv_id, ingested_at FROM (SELECT title, coalesce(arxiv_id, '') AS arxiv_id, ingested_at, row_number() OVER (PARTITION BY title ORDER BY ingested_at DESC, coalesce(arxiv_id, '') DESC) AS rn FROM papers WHERE title IS NOT NULL) WHERE rn = 1",
    "event_windows_sliding": "SELECT since, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS since FROM events) GROUP BY 1",
    "event_session_windows": "SELECT user_id, min(ts) AS since, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": "SELECT user_id, sum(n)::bigint AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1",
}
