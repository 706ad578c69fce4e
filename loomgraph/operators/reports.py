"""Reports and projections: paper properties, layout normalisation, baselines, holdout matching, fill rates, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import with_venue
from loomgraph.operators.iterate import _IN, _input, best_path_activation, both_directions, two_hop_proxy, walk_adjacency
from loomgraph.operators.search import vector_top
from loomgraph.plans.graph import G, TIER_WEIGHTS, VENUES, edges, latest_papers, nodes, sql_values
from loomgraph.runtime import read, workspace


def scan_nodes_all(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 nodes by id, as the overview shows them."""
    return nodes(spark, d).select("node_id", "node_type", "significance").orderBy("node_id").limit(100)


def paper_props(spark: SparkSession, d: str) -> DataFrame:
    p = with_venue(latest_papers(read(spark, d, "papers")))
    return p.select("title", "arxiv_id", "year", F.coalesce("venue", F.lit("arXiv")).alias("venue"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce("significance", F.lit(0.5)).alias("significance"), "venue_tier", "venue_weight")


def normalise_layout(points: DataFrame, span: float = 10.0) -> DataFrame:
    """points(id, x, y) centred on their mean, the wider side scaled to `span`; all points equal: all at the origin."""
    s = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"))
    k = F.when(F.col("w") > 0, F.lit(span) / F.col("w")).otherwise(F.lit(0.0))
    return points.withColumn("one", F.lit(1)).join(F.broadcast(s.withColumn("one", F.lit(1))), "one").select("id", ((F.col("x") - F.col("mx")) * k).alias("x"), ((F.col("y") - F.col("my")) * k).alias("y"))


def q_layout(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return normalise_layout(v).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def unordered_lookup(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """pairs(a, b) with the score of the pair in either order; scores(a, b, score), the best of repeats."""
    def key(df):
        return df.withColumn("k1", F.least("a", "b")).withColumn("k2", F.greatest("a", "b"))

    best = key(scores).groupBy("k1", "k2").agg(F.max("score").alias("score"))
    return key(pairs).join(best, ["k1", "k2"], "left").select("a", "b", "score")


def q_embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "entity_pairs").filter("name_a is not null and name_b is not null")
    mirrored = p.select(F.col("name_b").alias("a"), F.col("name_a").alias("b")).distinct()
    return unordered_lookup(mirrored, p.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.col("confidence").alias("score")))


def q_embedding_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest vectors of one seed."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return vector_top(v, v.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 50).select("vec_id", "cosine")


def q_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Nodes reached and mean score of the best-path activation and of the two-hop proxy."""
    e, n, s = _input(spark, d)
    best = best_path_activation(walk_adjacency(both_directions(e), n), s).select(F.lit("best_path").alias("method"), "node_id", "score")
    hops = two_hop_proxy(both_directions(e).select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id")), s).select(F.lit("two_hop").alias("method"), "node_id", "score")
    t = n.select("node_id", "node_type")
    return best.unionByName(hops).join(t, "node_id").groupBy("method").agg(F.count("*").alias("reached"), F.count_distinct("node_type").alias("types"), F.round(F.avg("score"), 6).alias("mean_score"))


def word_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(l, text), right(r, text) -> (l, r, overlap): share of the left text's distinct words in the right one, where any is.

    Joined by word; the words of the left side must be few and rare enough (titles), as no pair without a common word is made."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 2))).alias("w"))
    lw, rw = words(left, "l"), words(right, "r")
    size = lw.groupBy("l").agg(F.count("*").alias("n"))
    return lw.join(rw, "w").groupBy("l", "r").agg(F.count("*").alias("c")).join(size, "l").select("l", "r", (F.col("c") / F.col("n")).alias("overlap"))


def q_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Each published hypothesis with its best match among the newer ones: exact from half of its words on, partial from 0.4."""
    seeds = read(spark, d, "seed_hypotheses").select(F.col("hypothesis_id").alias("l"), F.col("title").alias("text"))
    new = read(spark, d, "hypotheses").filter("title is not null").select(F.col("hypothesis_id").alias("r"), F.col("title").alias("text"))
    best = word_overlap(seeds, new).groupBy("l").agg(F.max("overlap").alias("overlap"))
    o = F.coalesce("overlap", F.lit(0.0))
    return seeds.join(best, "l", "left").select(F.col("l").alias("hypothesis_id"), F.round(o, 6).alias("overlap"), F.when(o >= 0.5, "exact").when(o >= 0.4, "partial").otherwise("none").alias("match"))


def q_holdout_summary(spark: SparkSession, d: str) -> DataFrame:
    h = q_holdout(spark, d)
    matched = F.count_if(F.col("match") != "none")
    return h.agg(F.count("*").alias("total"), matched.alias("matched"), F.count_if(F.col("match") == "exact").alias("exact"), F.round(matched / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"), (matched >= 5).alias("passed"))


def q_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    """Fill rate of mathematical structures as the report states it: techniques with one, over the techniques judged and those
    that the checks found without one; 1 where there are none."""
    e = read(spark, d, "extractions").select(F.inline("entities")).filter("type = 'Technique'")
    filled = F.count_if(~F.lower(F.coalesce("mathematical_structure", F.lit(""))).isin("", "none", "n/a"))
    return e.agg(F.count("*").alias("techniques"), filled.alias("filled"), F.round(F.coalesce(F.try_divide(filled, 2 * F.count("*") - filled), F.lit(1.0)), 6).alias("rate"))


def co_citation(e: DataFrame) -> DataFrame:
    """Typed edges between what two papers introduce or evaluate on, where some paper cites both."""
    cites = e.filter("edge_type = 'CITES'").select(F.col("dst_id").alias("paper"), F.col("src_id").alias("citing")).distinct()
    holds = e.filter("edge_type in ('INTRODUCES', 'EVALUATES_ON')").select(F.col("src_id").alias("paper"), F.col("dst_id").alias("item")).distinct()
    seen = holds.join(cites, "paper").select("item", "paper", "citing")
    other = e.filter("edge_type not in ('CITES', 'INTRODUCES', 'EVALUATES_ON')").select("src_id", "edge_type", "dst_id")
    a = seen.select(F.col("item").alias("src_id"), F.col("paper").alias("p1"), "citing")
    b = seen.select(F.col("item").alias("dst_id"), F.col("paper").alias("p2"), "citing")
    return other.join(a, "src_id").join(b, ["dst_id", "citing"]).filter("p1 <> p2").select("src_id", "edge_type", "dst_id").distinct()


def q_co_citation(spark: SparkSession, d: str) -> DataFrame:
    return co_citation(edges(spark, d))


def q_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """Problems by how many techniques are limited by them less how many mitigate them."""
    e = edges(spark, d).filter("edge_type in ('HAS_LIMITATION', 'MITIGATES') and dst_type = 'Problem'")
    n = e.groupBy("dst_id").agg(F.count_if(F.col("edge_type") == "HAS_LIMITATION").alias("limits"), F.count_if(F.col("edge_type") == "MITIGATES").alias("mitigated"))
    return n.orderBy(F.desc(F.col("limits") - F.col("mitigated")), "dst_id").limit(20)


def q_export(spark: SparkSession, d: str) -> DataFrame:
    """Feedback written as JSON, one folder per event type, and read back."""
    path = workspace(spark, "export")
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    e.repartition("event_type").sortWithinPartitions(F.desc("event_id")).write.partitionBy("event_type").json(path)
    return spark.read.schema(e.schema).json(path).select("event_id", "user_id", "event_type", "value")


def q_sample_neighbors(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """At most k neighbours per node, drawn without replacement by weight: the k least exponential keys, from a hash."""
    e, n, _ = _input(spark, d)
    u = (F.pmod(F.xxhash64("node_id", "other_id", "edge_type"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    keyed = walk_adjacency(both_directions(e), n).withColumn("key", -F.log(u) / F.col("weight"))
    w = Window.partitionBy("node_id").orderBy("key", "other_id", "edge_type")
    return keyed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("node_id", "other_id", "edge_type", "rank")


_TIERS = sql_values([(v, t, TIER_WEIGHTS[t]) for t, vs in VENUES.items() for v in vs])
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_W = "SELECT {i}, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 2))) AS w FROM {t} WHERE title IS NOT NULL"
_HOLD = f"WITH lw AS ({_W.format(i='hypothesis_id AS l', t='seed_hypotheses')}), rw AS ({_W.format(i='hypothesis_id AS r', t='hypotheses')}), sz AS (SELECT l, count(*) AS n FROM lw GROUP BY 1), ov AS (SELECT l, r, count(*) AS c FROM lw JOIN rw USING (w) GROUP BY 1, 2), b AS (SELECT l, max(c / n) AS o FROM ov JOIN sz USING (l) GROUP BY 1), hd AS (SELECT hypothesis_id, round(coalesce(o, 0.0)::double, 6) AS overlap, CASE WHEN coalesce(o, 0.0) >= 0.5 THEN 'exact' WHEN coalesce(o, 0.0) >= 0.4 THEN 'partial' ELSE 'none' END AS match FROM seed_hypotheses LEFT JOIN b ON l = hypothesis_id)"
_ABL = _IN + """, sg AS MATERIALIZED (SELECT bi.node_id, other_id, max(coalesce(confidence, 0.5) * significance) AS step FROM bi JOIN gn ON gn.node_id = other_id WHERE coalesce(confidence, 0.5) * significance > 0 GROUP BY 1, 2),
l0 AS (SELECT node_id, 1.0::double AS score FROM seed)""" + "".join(f", l{k} AS MATERIALIZED (SELECT other_id AS node_id, max(score * step) AS score FROM l{k - 1} JOIN sg USING (node_id) WHERE score >= 0.05 GROUP BY 1)" for k in (1, 2, 3, 4)) + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in (1, 2, 3, 4)) + """), bp AS (SELECT 'best_path' AS method, node_id, max(score) AS score FROM al WHERE node_id NOT IN (SELECT node_id FROM seed) GROUP BY 1, 2),
f1 AS (SELECT DISTINCT other_id AS node_id FROM bi WHERE node_id IN (SELECT node_id FROM seed)), f2 AS (SELECT DISTINCT other_id AS node_id FROM bi WHERE node_id IN (SELECT node_id FROM f1) AND other_id NOT IN (SELECT node_id FROM seed)),
th AS (SELECT 'two_hop' AS method, node_id, max(score)::double AS score FROM (SELECT node_id, 0.8 AS score FROM f1 UNION ALL SELECT node_id, 0.5 FROM f2) GROUP BY 1, 2)
SELECT method, count(*) AS reached, count(DISTINCT node_type) AS types, round(avg(score), 6) AS mean_score FROM (SELECT * FROM bp UNION ALL SELECT * FROM th) JOIN gn USING (node_id) GROUP BY 1"""
QUERIES = {
    "scan_nodes_all": scan_nodes_all,
    "paper_props": paper_props,
    "layout_normalise": q_layout,
    "er_embedding_lookup": q_embedding_lookup,
    "embedding_baseline": q_embedding_baseline,
    "ablation_metrics": q_ablation,
    "holdout_match": q_holdout,
    "holdout_summary": q_holdout_summary,
    "math_fill_rate": q_fill_rate,
    "co_citation": q_co_citation,
    "bottleneck_finder": q_bottlenecks,
    "feedback_export_json": q_export,
    "sample_neighbors": q_sample_neighbors,
}
SQL = {
    "scan_nodes_all": G + "SELECT node_id, node_type, significance FROM gn ORDER BY node_id LIMIT 100",
    "paper_props": G + f", v(k, tier, weight) AS (VALUES {_TIERS}) SELECT title, arxiv_id, year, coalesce(nullif(venue, ''), 'arXiv') AS venue, coalesce(citation_count, 0) AS citation_count, coalesce(significance, 0.5) AS significance, coalesce(tier, 6) AS venue_tier, coalesce(weight, 0.15)::double AS venue_weight FROM gp LEFT JOIN v ON lower(trim(venue, ' ')) = k",
    "layout_normalise": "WITH p AS (SELECT vec_id AS id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings), s AS (SELECT avg(x) AS mx, avg(y) AS my, greatest(max(x) - min(x), max(y) - min(y)) AS w FROM p) SELECT id, round((x - mx) * (10.0 / w), 5) AS x, round((y - my) * (10.0 / w), 5) AS y FROM p, s",
    "er_embedding_lookup": "WITH p AS (SELECT name_a, name_b, confidence FROM entity_pairs WHERE name_a IS NOT NULL AND name_b IS NOT NULL), m AS (SELECT DISTINCT name_b AS a, name_a AS b FROM p), s AS (SELECT least(name_a, name_b) AS k1, greatest(name_a, name_b) AS k2, max(confidence) AS score FROM p GROUP BY 1, 2) SELECT a, b, score FROM m LEFT JOIN s ON least(a, b) = k1 AND greatest(a, b) = k2",
    "embedding_baseline": f"SELECT b.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY cosine DESC, b.vec_id LIMIT 50",
    "ablation_metrics": _ABL,
    "holdout_match": _HOLD + " SELECT * FROM hd",
    "holdout_summary": _HOLD + " SELECT count(*) AS total, count(*) FILTER (match <> 'none') AS matched, count(*) FILTER (match = 'exact') AS exact, round(count(*) FILTER (match <> 'none') / greatest(1, count(*)), 6) AS rate, count(*) FILTER (match <> 'none') >= 5 AS passed FROM hd",
    "math_fill_rate": "SELECT techniques, filled, round(coalesce(filled / nullif(2 * techniques - filled, 0), 1.0)::double, 6) AS rate FROM (SELECT count(*) AS techniques, count(*) FILTER (lower(coalesce(mathematical_structure, '')) NOT IN ('', 'none', 'n/a')) AS filled FROM (SELECT unnest(entities, recursive := true) FROM extractions) WHERE type = 'Technique')",
    "co_citation": G + ", ci AS (SELECT DISTINCT src_id AS citing, dst_id AS paper FROM ge WHERE edge_type = 'CITES'), ho AS (SELECT DISTINCT src_id AS paper, dst_id AS item FROM ge WHERE edge_type IN ('INTRODUCES', 'EVALUATES_ON')), c AS (SELECT item, paper, citing FROM ho JOIN ci USING (paper)) SELECT DISTINCT e.src_id, e.edge_type, e.dst_id FROM ge e JOIN c a ON a.item = e.src_id JOIN c b ON b.item = e.dst_id AND a.citing = b.citing AND a.paper <> b.paper WHERE e.edge_type NOT IN ('CITES', 'INTRODUCES', 'EVALUATES_ON')",
    "bottleneck_finder": G + "SELECT dst_id, count(*) FILTER (edge_type = 'HAS_LIMITATION') AS limits, count(*) FILTER (edge_type = 'MITIGATES') AS mitigated FROM ge WHERE edge_type IN ('HAS_LIMITATION', 'MITIGATES') AND dst_type = 'Problem' GROUP BY 1 ORDER BY limits - mitigated DESC, dst_id LIMIT 20",
    "feedback_export_json": "SELECT event_id, user_id, event_type, value FROM events",
}
