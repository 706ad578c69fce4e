"""Ranking and feedback: Elo, pages of hypotheses and votes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import global_rank, read, read_text, workspace, write_text

START, K = 1500.0, 32.0


def elo_expected(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (b - a) / F.lit(400.0)))


def elo_update(a: Column, b: Column, score_a: Column, k: float = K) -> Column:
    return a + F.lit(k) * (score_a - elo_expected(a, b))


def elo_tournament(matches: DataFrame, k: float = K, start: float = START) -> DataFrame:
    """matches(tournament, ord, a, b, score_a) -> (tournament, item, rating, wins, losses, draws).

    Ratings depend on the order of matches, so each tournament is a fold: it is streamed in order through one task per
    tournament, holding only its items' ratings, never its matches.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ratings = None, {}

        def done() -> pd.DataFrame:
            return pd.DataFrame([(at, i, *r) for i, r in ratings.items()], columns=["tournament", "item", "rating", "wins", "losses", "draws"])

        for f in frames:
            for t, a, b, s in zip(f["tournament"], f["a"], f["b"], f["score_a"]):
                if t != at:
                    if ratings:
                        yield done()
                    at, ratings = t, {}
                x, y = ratings.setdefault(a, [start, 0, 0, 0]), ratings.setdefault(b, [start, 0, 0, 0])
                gain = k * (s - 1.0 / (1.0 + 10.0 ** ((y[0] - x[0]) / 400.0)))
                x[0], y[0] = x[0] + gain, y[0] - gain
                for r, won in ((x, s), (y, 1.0 - s)):
                    r[1 if won == 1.0 else 2 if won == 0.0 else 3] += 1
        if ratings:
            yield done()

    ordered = matches.select("tournament", "ord", "a", "b", "score_a").repartition("tournament").sortWithinPartitions("tournament", "ord")
    return ordered.mapInPandas(fold, "tournament int, item string, rating double, wins long, losses long, draws long")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Judgments by round, each comparison once, in order of their time; a failed judgment is a draw."""
    o = read(spark, d, "pairwise_outcomes").filter("hyp_a is not null and hyp_b is not null and hyp_a <> hyp_b")
    once = o.groupBy("comparison_id").agg(F.min(F.struct("judged_at", "round_no", "hyp_a", "hyp_b", "winner")).alias("r")).select("comparison_id", "r.*")
    score = F.when(F.col("winner") == "A", 1.0).when(F.col("winner") == "B", 0.0).otherwise(0.5)
    return once.select(F.coalesce("round_no", F.lit(0)).alias("tournament"), F.struct("judged_at", "comparison_id").alias("ord"), F.col("hyp_a").alias("a"), F.col("hyp_b").alias("b"), score.alias("score_a"))


def q_elo(spark: SparkSession, d: str) -> DataFrame:
    return elo_tournament(_matches(spark, d))


def q_elo_top(spark: SparkSession, d: str) -> DataFrame:
    return q_elo(spark, d).orderBy(F.desc("rating"), "tournament", "item").limit(20)


def q_elo_expected(spark: SparkSession, d: str) -> DataFrame:
    """Expected score and update of hypotheses against the start rating, with votes as rating points."""
    a = F.lit(START) + F.coalesce("feedback_up", F.lit(0)) - F.coalesce("feedback_down", F.lit(0))
    return read(spark, d, "hypotheses").select("hypothesis_id", F.round(elo_expected(a, F.lit(START)), 6).alias("expected"), F.round(elo_update(a, F.lit(START), F.lit(1.0)), 5).alias("after_win"))


def q_wins(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d)
    sides = m.select(F.inline(F.array(F.struct(F.col("a").alias("item"), F.col("score_a").alias("s")), F.struct(F.col("b").alias("item"), (1.0 - F.col("score_a")).alias("s")))))
    return sides.groupBy("item").agg(F.count("*").alias("played"), F.sum("s").alias("points"))


def q_page(spark: SparkSession, d: str, page: int = 2, size: int = 20) -> DataFrame:
    """A page of hypotheses by votes up less down (unknown counts as 0), then by id."""
    net = F.coalesce("feedback_up", F.lit(0)) - F.coalesce("feedback_down", F.lit(0))
    return read(spark, d, "hypotheses").select("hypothesis_id", "title", net.alias("net")).orderBy(F.desc("net"), "hypothesis_id").offset(size * (page - 1)).limit(size)


def q_recent(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hypotheses").select("hypothesis_id", "created_at").orderBy(F.col("created_at").desc_nulls_last(), "hypothesis_id").limit(20)


def q_feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback: purchases up, errors down, everything else skipped."""
    e = read(spark, d, "events")
    up, down = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return e.agg(F.count("*").alias("total"), up.alias("up"), down.alias("down"), (F.count("*") - up - down).alias("skip"), F.count_distinct("user_id").alias("subjects"), F.round(up / F.greatest(F.lit(1), up + down), 6).alias("approval"))


def q_feedback_vote(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))


def q_feedback_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), "event_id").offset(10).limit(50)


def append_feedback(spark: SparkSession, path: str, rows: DataFrame, order: list) -> None:
    """Adds rows to the feedback at path with the next ids, in the order given (which must be total)."""
    held = read_text(spark, f"{path}/last")
    ranked = global_rank(rows, order, "id").withColumn("id", F.col("id") + F.lit(int(held or 0)))
    ranked.write.mode("append").parquet(f"{path}/rows")
    write_text(spark, f"{path}/last", str(int(held or 0) + rows.count()))


def q_feedback_append(spark: SparkSession, d: str) -> DataFrame:
    """Votes (purchases up, errors down) appended in two batches: (id, event_id, rating)."""
    path = workspace(spark, "feedback")
    e = read(spark, d, "events").filter("event_type in ('purchase', 'error')").select("event_id", "ts", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("rating"))
    for odd in (0, 1):
        append_feedback(spark, path, e.filter(F.col("event_id") % 2 == odd), [F.col("ts").asc(), F.col("event_id").asc()])
    return spark.read.parquet(f"{path}/rows").select("id", "event_id", "rating")


_M = """WITH o AS (SELECT comparison_id, min((judged_at, round_no, hyp_a, hyp_b, winner)) AS r FROM pairwise_outcomes WHERE hyp_a IS NOT NULL AND hyp_b IS NOT NULL AND hyp_a <> hyp_b GROUP BY 1),
x AS (SELECT r[3] AS a, r[4] AS b, CASE r[5] WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::double AS s FROM o)"""
QUERIES = {"elo_tournament": q_elo, "elo_ranked": q_elo_top, "elo_expected": q_elo_expected, "elo_points": q_wins, "hypotheses_page": q_page, "hypotheses_recent": q_recent, "feedback_stats": q_feedback_stats, "feedback_vote": q_feedback_vote, "feedback_page": q_feedback_page, "feedback_append": q_feedback_append}
SQL = {
    "elo_expected": "SELECT hypothesis_id, round(1.0 / (1.0 + pow(10.0, (1500.0 - a) / 400.0)), 6) AS expected, round(a + 32.0 * (1.0 - 1.0 / (1.0 + pow(10.0, (1500.0 - a) / 400.0))), 5) AS after_win FROM (SELECT hypothesis_id, (1500.0 + coalesce(feedback_up, 0) - coalesce(feedback_down, 0))::double AS a FROM hypotheses)",
    "elo_points": _M + " SELECT item, count(*) AS played, sum(s) AS points FROM (SELECT a AS item, s FROM x UNION ALL SELECT b, 1.0 - s FROM x) GROUP BY 1",
    "hypotheses_page": "SELECT hypothesis_id, title, coalesce(feedback_up, 0) - coalesce(feedback_down, 0) AS net FROM hypotheses ORDER BY net DESC, hypothesis_id LIMIT 20 OFFSET 20",
    "hypotheses_recent": "SELECT hypothesis_id, created_at FROM hypotheses ORDER BY created_at DESC NULLS LAST, hypothesis_id LIMIT 20",
    "feedback_stats": "SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS skip, count(DISTINCT user_id) AS subjects, round(count(*) FILTER (event_type = 'purchase') / greatest(1, count(*) FILTER (event_type IN ('purchase', 'error'))), 6) AS approval FROM events",
    "feedback_append": "SELECT row_number() OVER (ORDER BY event_id % 2, ts, event_id) AS id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS rating FROM events WHERE event_type IN ('purchase', 'error')",
    "feedback_vote": "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1",
    "feedback_page": "SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10",
}
