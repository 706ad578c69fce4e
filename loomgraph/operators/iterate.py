"""Iterative graph algorithms: activation waves, best paths, personalised PageRank, two-hop proxy, sampled walks.

State is narrow (node, score, depth), cut every round, and never on the driver; the adjacency is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.graph import G, NULL_CONFIDENCE, NULL_SIGNIFICANCE, edge_type_dim, linked_edges, nodes, undirected
from loomgraph.runtime import Buckets, cut

DECAY, WAVE_STEPS, WAVE_MOST_STEPS, WAVE_FAN, WAVE_LEAST = 0.7, 5, 10, 50, 0.01
WALK_DEPTH, WALK_LEAST, BONUS, LOW_DEGREE = 4, 0.05, 1.5, 5
ALPHA, PPR_ROUNDS = 0.15, 50
#: Rounds of PageRank between two cuts of lineage.
PPR_CUT = 5


def _or_half(c: str, half: float):
    return F.when(F.col(c).isNull() | (F.col(c) == 0), half).otherwise(F.col(c))


def wave_adjacency(e: DataFrame, n: DataFrame, fan: int = WAVE_FAN) -> DataFrame:
    """(node_id, other_id, factor): the first `fan` edges of each node, unknown confidence first, with what they pass on."""
    w = Window.partitionBy("node_id").orderBy(F.col("confidence").desc_nulls_first(), "edge_type", "other_id")
    top = undirected(e).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= fan)
    sig = n.select(F.col("node_id").alias("other_id"), "significance")
    j = top.join(sig, "other_id").join(F.broadcast(edge_type_dim(e.sparkSession)), "edge_type")
    return j.select("node_id", "other_id", (F.col("wave_weight") * _or_half("confidence", NULL_CONFIDENCE) * _or_half("significance", NULL_SIGNIFICANCE)).alias("factor"))


def activation_wave(adjacency: DataFrame, seed: DataFrame, steps: int = WAVE_STEPS, decay: float = DECAY) -> DataFrame:
    """(step, node_id, score) of what each step newly activates or raises; every node is expanded once, with the score it
    then has. seed(node_id); at most WAVE_MOST_STEPS steps."""
    if steps > WAVE_MOST_STEPS:
        raise ValueError(f"at most {WAVE_MOST_STEPS} steps")
    adjacency = cut(adjacency)
    state = seed.select("node_id", F.lit(1.0).alias("score"), F.lit(False).alias("spent"))
    out = seed.select(F.lit(0).alias("step"), "node_id", F.lit(1.0).alias("score"))
    for step in range(1, steps + 1):
        front = state.filter("not spent").select("node_id", "score")
        sent = front.join(adjacency, "node_id").groupBy(F.col("other_id").alias("node_id")).agg(F.max(F.col("score") * decay * F.col("factor")).alias("got"))
        merged = cut(state.join(sent, "node_id", "full_outer").select("node_id", "score", "got", F.coalesce("spent", F.lit(False)).alias("spent")))
        new = merged.filter("got is not null and (score is null or got > score)")
        out = out.unionByName(new.select(F.lit(step).alias("step"), "node_id", F.col("got").alias("score")))
        state = merged.select("node_id", F.greatest("score", "got").alias("score"), (F.col("score").isNotNull()).alias("spent"))
    return out


def walk_adjacency(e: DataFrame, n: DataFrame) -> DataFrame:
    """(node_id, other_id, step, weight): out-edges; step is what the score is multiplied by, weight what walks choose by."""
    deg = e.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    to = n.select(F.col("node_id").alias("dst_id"), "significance").join(deg.withColumnRenamed("node_id", "dst_id"), "dst_id")
    j = e.join(to, "dst_id").join(F.broadcast(edge_type_dim(e.sparkSession)), "edge_type")
    step = F.coalesce("confidence", F.lit(NULL_CONFIDENCE)) * F.col("significance")
    return j.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id"), "edge_type", step.alias("step"), (F.col("walk_weight") * step * F.when(F.col("degree") <= LOW_DEGREE, BONUS).otherwise(1.0)).alias("weight")).filter("weight > 0")


def best_path_activation(adjacency: DataFrame, seed: DataFrame, depth: int = WALK_DEPTH, least: float = WALK_LEAST) -> DataFrame:
    """(node_id, score, depth): the best product of step factors over paths of up to `depth` edges, and the fewest edges;
    paths go on only while they score `least`. Exact, since all factors are at most one. The seed may be passed through but
    is not in the result."""
    adjacency = cut(adjacency.groupBy("node_id", "other_id").agg(F.max("step").alias("step")))
    layer = seed.select("node_id", F.lit(1.0).alias("score"))
    layers = []
    for k in range(1, depth + 1):
        layer = cut(layer.filter(F.col("score") >= least).join(adjacency, "node_id").groupBy(F.col("other_id").alias("node_id")).agg(F.max(F.col("score") * F.col("step")).alias("score")))
        layers.append(layer.withColumn("depth", F.lit(k)))
    every = layers[0]
    for x in layers[1:]:
        every = every.unionByName(x)
    return every.join(F.broadcast(seed), "node_id", "left_anti").groupBy("node_id").agg(F.max("score").alias("score"), F.min("depth").alias("depth"))


def ppr(arcs: DataFrame, n: DataFrame, seed: DataFrame, alpha: float = ALPHA, rounds: int = PPR_ROUNDS) -> DataFrame:
    """Personalised PageRank (node_id, score): arcs(node_id, other_id) may repeat; mass without out-edges returns to the seed.

    Nodes without out-edges get arcs to the seeds, so a round is one join and one sum, without a look at the rest; only reached
    nodes are in the state, n gives the others their 0. The shares are in buckets by node: a round shuffles what is passed on."""
    seeds = cut(seed.select("node_id").distinct())
    k = max(1, seeds.count())
    out = arcs.groupBy("node_id").agg(F.count("*").alias("deg"))
    share = arcs.groupBy("node_id", "other_id").agg(F.count("*").alias("m")).join(out, "node_id").select("node_id", "other_id", (F.col("m") / F.col("deg")).alias("share"))
    ends = arcs.select(F.col("other_id").alias("node_id")).unionByName(seeds).distinct().join(out, "node_id", "left_anti")
    one = F.lit(1).alias("one")
    back = ends.select("node_id", one).join(F.broadcast(seeds.select(F.col("node_id").alias("other_id"), one)), "one").select("node_id", "other_id", F.lit(1.0 / k).alias("share"))
    with Buckets(arcs.sparkSession) as buckets:
        share = buckets.write(share.unionByName(back), "node_id")
        state = seeds.withColumn("score", F.lit(1.0 / k))
        jump = seeds.withColumn("score", F.lit(alpha / k))
        for i in range(1, rounds + 1):
            passed = state.join(share, "node_id").select(F.col("other_id").alias("node_id"), (F.lit(1 - alpha) * F.col("score") * F.col("share")).alias("score"))
            state = passed.unionByName(jump).groupBy("node_id").agg(F.sum("score").alias("score"))
            state = cut(state) if i % PPR_CUT == 0 or i == rounds else state
    return n.select("node_id").join(state, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def two_hop_proxy(arcs: DataFrame, seed: DataFrame) -> DataFrame:
    """0.8 for out-neighbours of the seed, 0.5 for their out-neighbours that are not, the seed left out of the second hop."""
    first = arcs.join(F.broadcast(seed), "node_id", "left_semi").select(F.col("other_id").alias("node_id")).distinct()
    second = arcs.join(first, "node_id", "left_semi").select(F.col("other_id").alias("node_id")).distinct().join(F.broadcast(seed), "node_id", "left_anti")
    return first.withColumn("score", F.lit(0.8)).unionByName(second.withColumn("score", F.lit(0.5))).groupBy("node_id").agg(F.max("score").alias("score"))


def random_walks(adjacency: DataFrame, seed: DataFrame, walks: int = 100, depth: int = WALK_DEPTH, least: float = WALK_LEAST, salt: int = 0) -> DataFrame:
    """(node_id, score, visits, depth) over sampled walks: each step draws one edge with chance proportional to weight, by the
    least exponential key; keys come from a hash of (walk, step, edge, salt), so results do not depend on partitions."""
    adjacency = cut(adjacency)
    at = seed.select(F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), "node_id", F.lit(1.0).alias("score"))
    seen = []
    for k in range(1, depth + 1):
        u = (F.pmod(F.xxhash64(F.lit(salt), "walk", F.lit(k), "node_id", "other_id", "edge_type"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
        drawn = at.filter(F.col("score") >= least).join(adjacency, "node_id").withColumn("key", -F.log(u) / F.col("weight"))
        at = cut(drawn.groupBy("walk").agg(F.min_by(F.struct(F.col("other_id").alias("node_id"), (F.col("score") * F.col("step")).alias("score")), F.struct("key", "other_id", "edge_type")).alias("r")).select("walk", "r.node_id", "r.score"))
        seen.append(at.withColumn("depth", F.lit(k)))
    every = seen[0]
    for x in seen[1:]:
        every = every.unionByName(x)
    return every.join(F.broadcast(seed), "node_id", "left_anti").groupBy("node_id").agg(F.max("score").alias("score"), F.count("*").alias("visits"), F.min("depth").alias("depth"))


def both_directions(e: DataFrame) -> DataFrame:
    """Directed edges with their reverses, as the walks need them."""
    r = e.select(F.col("dst_id").alias("src_id"), "edge_type", F.col("src_id").alias("dst_id"), "confidence")
    return e.select("src_id", "edge_type", "dst_id", "confidence").unionByName(r)


def _input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = cut(linked_edges(spark, d).select("src_id", "edge_type", "dst_id", "confidence"))
    u = undirected(e).groupBy("node_id").count().orderBy(F.desc("count"), "node_id").limit(1).select("node_id")
    return e, cut(nodes(spark, d)), cut(u)


def _wave(spark: SparkSession, d: str, steps: int) -> DataFrame:
    e, n, s = _input(spark, d)
    return activation_wave(wave_adjacency(e, n), s, steps).select("step", "node_id", F.round("score", 6).alias("score"))


def _wave_top(wave: DataFrame) -> DataFrame:
    """At most 50 activations per step above the display threshold."""
    w = Window.partitionBy("step").orderBy(F.desc("score"), "node_id")
    return wave.filter(F.col("score") > WAVE_LEAST).withColumn("rank", F.row_number().over(w)).filter("rank <= 50").select("step", "node_id", "score")


def q_wave(spark: SparkSession, d: str) -> DataFrame:
    return _wave(spark, d, WAVE_STEPS)


def q_wave_top(spark: SparkSession, d: str) -> DataFrame:
    return _wave_top(q_wave(spark, d))


def q_best_path(spark: SparkSession, d: str) -> DataFrame:
    e, n, s = _input(spark, d)
    return best_path_activation(walk_adjacency(both_directions(e), n), s).select("node_id", F.round("score", 6).alias("score"), "depth")


def q_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return q_best_path(spark, d).groupBy("depth").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def _ppr(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    e, n, s = _input(spark, d)
    arcs = both_directions(e).select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id"))
    return ppr(arcs, n, s, rounds=rounds).filter("score > 0")


def q_ppr(spark: SparkSession, d: str) -> DataFrame:
    """All PPR_ROUNDS rounds."""
    return _ppr(spark, d, PPR_ROUNDS).select("node_id", F.round("score", 6).alias("score"))


def q_ppr_full(spark: SparkSession, d: str) -> DataFrame:
    """Unrounded, since far nodes have small scores."""
    return _ppr(spark, d, PPR_ROUNDS)


def q_ppr_top(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k best but for the seed."""
    e, n, s = _input(spark, d)
    arcs = both_directions(e).select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id"))
    best = ppr(arcs, n, s).join(F.broadcast(s), "node_id", "left_anti").filter("score > 0").select("node_id", F.round("score", 6).alias("score"))
    return best.orderBy(F.desc("score"), "node_id").limit(k)


def q_top_activated(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """The k nodes of the best path scores, with the path's fewest edges."""
    return q_best_path(spark, d).orderBy(F.desc("score"), "node_id").limit(k)


def q_two_hop(spark: SparkSession, d: str) -> DataFrame:
    e, _, s = _input(spark, d)
    return two_hop_proxy(e.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id")), s)


def q_walks(spark: SparkSession, d: str) -> DataFrame:
    e, n, s = _input(spark, d)
    return random_walks(walk_adjacency(both_directions(e), n), s)


_IN = G + """, du AS (SELECT node_id, count(*) AS n FROM (SELECT src_id AS node_id FROM gl UNION ALL SELECT dst_id FROM gl) GROUP BY 1), seed AS (SELECT node_id FROM du ORDER BY n DESC, node_id LIMIT 1),
bi AS (SELECT src_id AS node_id, dst_id AS other_id, edge_type, confidence FROM gl UNION ALL SELECT dst_id, src_id, edge_type, confidence FROM gl)"""
_WAVE = _IN + """, tp AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC NULLS FIRST, edge_type, other_id) AS rank FROM bi),
ad AS MATERIALIZED (SELECT tp.node_id, other_id, wave_weight::double * (CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END) * (CASE WHEN significance = 0 THEN 0.5 ELSE significance END) AS factor FROM tp JOIN et USING (edge_type) JOIN gn ON gn.node_id = other_id WHERE rank <= 50),
s0 AS (SELECT node_id, 1.0::double AS score, false AS spent FROM seed)""" + "".join(
    f""", g{k} AS MATERIALIZED (SELECT other_id AS node_id, max(score * 0.7::double * factor) AS got FROM s{k - 1} JOIN ad USING (node_id) WHERE NOT spent GROUP BY 1),
m{k} AS MATERIALIZED (SELECT coalesce(s.node_id, g.node_id) AS node_id, s.score, g.got FROM s{k - 1} s FULL JOIN g{k} g ON s.node_id = g.node_id),
s{k} AS (SELECT node_id, greatest(score, got) AS score, score IS NOT NULL AS spent FROM m{k})"""
    for k in range(1, WAVE_STEPS + 1)
) + ", wv AS (SELECT 0 AS step, node_id, 1.0::double AS score FROM seed" + "".join(f" UNION ALL SELECT {k}, node_id, round(got, 6) FROM m{k} WHERE got IS NOT NULL AND (score IS NULL OR got > score)" for k in range(1, WAVE_STEPS + 1)) + ")"
_BEST = _IN + """, sg AS MATERIALIZED (SELECT bi.node_id, other_id, max(coalesce(confidence, 0.5) * significance) AS step FROM bi JOIN gn ON gn.node_id = other_id WHERE coalesce(confidence, 0.5) * significance > 0 GROUP BY 1, 2),
l0 AS (SELECT node_id, 1.0::double AS score FROM seed)""" + "".join(f", l{k} AS MATERIALIZED (SELECT other_id AS node_id, max(score * step) AS score FROM l{k - 1} JOIN sg USING (node_id) WHERE score >= 0.05 GROUP BY 1)" for k in (1, 2, 3, 4)) + ", al AS (" + " UNION ALL ".join(f"SELECT node_id, score, {k} AS depth FROM l{k}" for k in (1, 2, 3, 4)) + "), bp AS (SELECT node_id, round(max(score), 6) AS score, min(depth) AS depth FROM al WHERE node_id NOT IN (SELECT node_id FROM seed) GROUP BY 1)"
_PPR = _IN + """, dg AS (SELECT node_id, count(*) AS deg FROM bi GROUP BY 1), sh AS MATERIALIZED (SELECT node_id, other_id, count(*)::double / any_value(deg) AS share FROM bi JOIN dg USING (node_id) GROUP BY 1, 2),
p0 AS (SELECT gn.node_id, deg IS NULL AS dangling, (gn.node_id IN (SELECT node_id FROM seed))::int::double AS s, (gn.node_id IN (SELECT node_id FROM seed))::int::double AS score FROM gn LEFT JOIN dg USING (node_id))""" + "".join(
    f""", q{k} AS MATERIALIZED (SELECT other_id AS node_id, sum(score * share) AS got FROM p{k - 1} JOIN sh USING (node_id) GROUP BY 1),
p{k} AS MATERIALIZED (SELECT p.node_id, dangling, s, 0.85::double * (coalesce(got, 0.0) + (SELECT coalesce(sum(score), 0.0) FROM p{k - 1} WHERE dangling) * s) + 0.15::double * s AS score FROM p{k - 1} p LEFT JOIN q{k} USING (node_id))"""
    for k in range(1, PPR_ROUNDS + 1)
)
QUERIES = {"activation_wave": q_wave, "wave_step_topk": q_wave_top, "best_path_activation": q_best_path, "activation_by_depth": q_by_depth, "ppr": q_ppr, "ppr_full": q_ppr_full, "ppr_top_k": q_ppr_top, "top_activated": q_top_activated, "two_hop_proxy_similarity": q_two_hop, "typed_random_walk": q_walks}
SQL = {
    "activation_wave": _WAVE + " SELECT * FROM wv",
    "wave_step_topk": _WAVE + " SELECT step, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, node_id) AS rn FROM wv WHERE score > 0.01) WHERE rn <= 50",
    "best_path_activation": _BEST + " SELECT * FROM bp",
    "activation_by_depth": _BEST + " SELECT depth, count(*) AS n, max(score) AS best FROM bp GROUP BY 1",
    "ppr": _PPR + f" SELECT node_id, round(score, 6) AS score FROM p{PPR_ROUNDS} WHERE score > 0",
    "ppr_top_k": _PPR + f" SELECT node_id, round(score, 6) AS score FROM p{PPR_ROUNDS} WHERE score > 0 AND s = 0 ORDER BY 2 DESC, node_id LIMIT 50",
    "top_activated": _BEST + " SELECT * FROM bp ORDER BY score DESC, node_id LIMIT 20",
    "two_hop_proxy_similarity": _IN + ", f1 AS (SELECT DISTINCT dst_id AS node_id FROM gl WHERE src_id IN (SELECT node_id FROM seed)), f2 AS (SELECT DISTINCT dst_id AS node_id FROM gl WHERE src_id IN (SELECT node_id FROM f1) AND dst_id NOT IN (SELECT node_id FROM seed)) SELECT node_id, max(score)::double AS score FROM (SELECT node_id, 0.8 AS score FROM f1 UNION ALL SELECT node_id, 0.5 FROM f2) GROUP BY 1",
}
