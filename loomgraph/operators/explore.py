"""Graph exploration, validation and upserts: joins on node ids; every operator is DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.graph import EDGE_TYPES, G, NODE_TYPES, TIER_WEIGHTS, TRIPLES, VENUES, as_label, edges, latest_papers, linked_edges, node_id, nodes, sql_values, triple_dim, undirected, venue_dim
from loomgraph.runtime import read



def seed_of(spark: SparkSession, d: str) -> DataFrame:
    """The node with most edges (then by id): a one-row table."""
    u = undirected(linked_edges(spark, d)).groupBy("node_id").count()
    return u.orderBy(F.desc("count"), "node_id").limit(1).select("node_id")


def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    """Out-edges with the neighbour's attributes on them."""
    n = nodes(spark, d).select(F.col("node_id").alias("dst_id"), "node_type", "name", "significance")
    return edges(spark, d).join(n, "dst_id").select("src_id", "edge_type", "dst_id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "node_type", "name", "significance")


def neighbors_undirected(spark: SparkSession, d: str) -> DataFrame:
    return undirected(edges(spark, d)).groupBy("node_id").agg(F.count_distinct("other_id").alias("neighbors"), F.count("*").alias("edges"))


def top_incident(e: DataFrame, k: int) -> DataFrame:
    """At most k incident edges per node: confidence first, unknown before known, then by type and other end."""
    w = Window.partitionBy("node_id").orderBy(F.col("confidence").desc_nulls_first(), "edge_type", "other_id")
    return undirected(e).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighborhood(e: DataFrame, centre: DataFrame, k: int = 50, fan: int = 10) -> DataFrame:
    """Edges around centre(node_id) to depth two: k at the centre, `fan` of each of its first `fan` neighbours; each edge once."""
    first = top_incident(undirected_of(e, centre), k).join(F.broadcast(centre), "node_id", "left_semi").select(F.lit(1).alias("depth"), "node_id", "other_id", "edge_type", "confidence", "rank")
    border = first.filter(F.col("rank") <= fan).select(F.col("other_id").alias("node_id")).distinct()
    second = top_incident(undirected_of(e, border), fan).join(F.broadcast(border), "node_id", "left_semi").select(F.lit(2).alias("depth"), "node_id", "other_id", "edge_type", "confidence", "rank")
    both = first.unionByName(second)
    key = [F.least("node_id", "other_id").alias("a"), F.greatest("node_id", "other_id").alias("b"), "edge_type"]
    return both.groupBy(*key).agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"))


def undirected_of(e: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with an end in keep(node_id), a set of bounded size (a seed, or the first neighbours of one)."""
    ids = F.broadcast(keep.select("node_id").distinct().withColumn("_k", F.lit(True)))
    j = e.join(ids.select(F.col("node_id").alias("src_id"), F.col("_k").alias("_s")), "src_id", "left").join(ids.select(F.col("node_id").alias("dst_id"), F.col("_k").alias("_d")), "dst_id", "left")
    return j.filter("_s or _d").select("src_id", "dst_id", "edge_type", "confidence")


def q_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood(linked_edges(spark, d), seed_of(spark, d)).select("a", "b", "edge_type", "depth", F.round("confidence", 6).alias("confidence"))


def node_detail(spark: SparkSession, d: str) -> DataFrame:
    n = undirected(edges(spark, d)).groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes(spark, d).join(n, "node_id", "left").select("node_id", "node_type", F.coalesce("n", F.lit(0)).alias("edges"))


def edges_among(spark: SparkSession, d: str) -> DataFrame:
    """Edges between techniques and problems that are nodes."""
    keep = nodes(spark, d).filter("node_type in ('Technique', 'Problem')").select("node_id")
    e = edges(spark, d)
    return e.join(keep.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(keep.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select("src_id", "edge_type", "dst_id")


def conf_type_filter(spark: SparkSession, d: str, least: float = 0.7, hidden: str = "Dataset") -> DataFrame:
    """What the viewer shows: no hidden node type, confidence (unknown counts as 1) from `least` on."""
    return edges(spark, d).filter((F.col("src_type") != hidden) & (F.col("dst_type") != hidden) & (F.coalesce("confidence", F.lit(1.0)) >= least)).select("src_id", "edge_type", "dst_id")


def hover_subgraph(spark: SparkSession, d: str) -> DataFrame:
    s = seed_of(spark, d)
    return undirected(linked_edges(spark, d)).join(F.broadcast(s), "node_id", "left_semi").groupBy("other_id").agg(F.count("*").alias("edges"))


def coupling(e: DataFrame) -> DataFrame:
    """Bibliographic coupling: typed edges between what two papers introduce or evaluate on gain 0.15 confidence (to 1 at
    most, once) if both papers cite a common one. Pairs of papers come from their common reference, never from all pairs:
    each edge is looked up by its two ends' papers."""
    cites = e.filter("edge_type = 'CITES'").select("src_id", "dst_id").distinct()
    holds = e.filter("edge_type in ('INTRODUCES', 'EVALUATES_ON')").select(F.col("src_id").alias("paper"), F.col("dst_id").alias("item")).distinct()
    cited = holds.join(cites, holds["paper"] == cites["src_id"]).select("item", "paper", F.col("dst_id").alias("common"))
    weak = e.filter("confidence < 1 and edge_type not in ('CITES', 'INTRODUCES', 'EVALUATES_ON')").select("src_id", "edge_type", "dst_id", "confidence")
    a = cited.select(F.col("item").alias("src_id"), F.col("paper").alias("p1"), "common")
    b = cited.select(F.col("item").alias("dst_id"), F.col("paper").alias("p2"), "common")
    hit = weak.join(a, "src_id").join(b, ["dst_id", "common"]).filter("p1 <> p2").select("src_id", "edge_type", "dst_id", "confidence").distinct()
    return hit.select("src_id", "edge_type", "dst_id", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.15), 6).alias("confidence"))


def q_coupling(spark: SparkSession, d: str) -> DataFrame:
    return coupling(edges(spark, d))


def q_shared_references(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of papers joined by a CITES edge: how many references they share."""
    c = edges(spark, d).filter("edge_type = 'CITES'").select("src_id", "dst_id").distinct()
    r1 = c.select("src_id", F.col("dst_id").alias("ref"))
    r2 = c.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("ref"))
    n = c.join(r1, "src_id").join(r2, ["dst_id", "ref"]).groupBy("src_id", "dst_id").agg(F.count("*").alias("shared"))
    return c.join(n, ["src_id", "dst_id"], "left").select("src_id", "dst_id", F.coalesce("shared", F.lit(0)).alias("shared"))


def validate_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges per triple, with whether the triple is legal."""
    legal = F.broadcast(triple_dim(spark).withColumn("legal", F.lit(True)))
    return edges(spark, d).join(legal, ["src_type", "edge_type", "dst_type"], "left").groupBy("src_type", "edge_type", "dst_type").agg(F.count("*").alias("n"), F.coalesce(F.first("legal"), F.lit(False)).alias("legal"))


def validate_props(spark: SparkSession, d: str) -> DataFrame:
    """Required properties that entities lack, per type and property."""
    e = read(spark, d, "entities").filter("type in ('Technique', 'Problem', 'Dataset')")
    need = {"Technique": ["name", "description", "mathematical_structure"], "Problem": ["name", "description", "bottleneck_class"], "Dataset": ["name", "description"]}
    gaps = F.array_compact(F.array(*[F.when((F.col("type") == t) & F.col(c).isNull(), F.lit(c)) for t, cs in need.items() for c in cs]))
    return e.select("type", F.explode(gaps).alias("missing")).groupBy("type", "missing").agg(F.count("*").alias("n"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness constraint on paper ids: keys held by several rows."""
    return read(spark, d, "papers").filter("arxiv_id is not null").groupBy("arxiv_id").agg(F.count("*").alias("rows")).filter("rows > 1")


def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    """Citations as lists paper -> cited, in order, without self references and repeats, with the number of rows dropped."""
    c = edges(spark, d).filter("edge_type = 'CITES'")
    good = F.col("src_id") != F.col("dst_id")
    out = c.groupBy("src_id").agg(F.array_sort(F.collect_set(F.when(good, F.col("dst_id")))).alias("l"), F.sum("n").alias("n"))
    return out.select("src_id", F.array_join("l", "|").alias("cited"), (F.col("n") - F.size("l")).alias("dropped"))


def upsert_papers(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key-wise last writer wins: new rows replace old ones. One shuffle, no window."""
    cols = [c for c in old.columns if c != key]
    both = old.select(F.lit(0).alias("_v"), key, *cols).unionByName(new.select(F.lit(1).alias("_v"), key, *cols))
    return both.groupBy(key).agg(F.max(F.struct("_v", *cols)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def q_upsert_papers(spark: SparkSession, d: str) -> DataFrame:
    """Extractions of later batches written over the papers, by title."""
    old = latest_papers(read(spark, d, "papers")).select("title", "year", "venue")
    x = read(spark, d, "extractions").filter("batch_no > 0 and title is not null").groupBy("title").agg(F.max(F.struct("record_id", "year", "venue")).alias("r")).select("title", "r.year", "r.venue")
    return upsert_papers(old, x, "title")


def q_upsert_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose both ends are papers, with the number of rows that said so."""
    return linked_edges(spark, d).filter("edge_type = 'CITES'").groupBy("src_id", "dst_id").agg(F.sum("n").alias("matched"))


def q_citation_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Papers that are cited but not held, as stubs."""
    t = edges(spark, d).filter("edge_type = 'CITES'").select(F.col("dst_id").alias("node_id")).distinct()
    return t.join(nodes(spark, d).select("node_id"), "node_id", "left_anti").select("node_id", F.lit(True).alias("stub"))


def q_upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    """The last written description per entity name and type."""
    e = read(spark, d, "entities").filter("name is not null and type is not null")
    return e.groupBy("type", "name").agg(F.max(F.struct("extracted_at", "entity_id", "description")).alias("r")).select("type", "name", F.col("r.description").alias("description"))


def q_upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between known nodes with their provenance: the most confident row that said so (then the latest), its paper, and
    the weight of that paper's venue; how they came to be and that nobody has checked them are constants."""
    r = read(spark, d, "relations").select("relation_id", "arxiv_id", as_label(F.col("source_type"), NODE_TYPES).alias("st"), "source", as_label(F.col("relation"), [t[0] for t in EDGE_TYPES]).alias("edge_type"), as_label(F.col("target_type"), NODE_TYPES).alias("tt"), "target", "confidence")
    r = r.select(node_id(F.col("st"), F.col("source")).alias("src_id"), "edge_type", node_id(F.col("tt"), F.col("target")).alias("dst_id"), F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "relation_id", F.coalesce("arxiv_id", F.lit("")).alias("source_paper")).alias("r")).filter("src_id is not null and edge_type is not null and dst_id is not null")
    best = r.groupBy("src_id", "edge_type", "dst_id").agg(F.max("r").alias("r"))
    n = nodes(spark, d).select("node_id")
    best = best.join(n.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(n.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select("src_id", "edge_type", "dst_id", F.when(F.col("r.c") >= 0, F.col("r.c")).alias("confidence"), F.col("r.source_paper").alias("source_paper"))
    venue = latest_papers(read(spark, d, "papers")).filter("arxiv_id <> ''").groupBy(F.col("arxiv_id").alias("source_paper")).agg(F.max(F.struct("ingested_at", F.coalesce("venue", F.lit("")).alias("v"))).alias("m"))
    venue = venue.select("source_paper", F.lower(F.trim("m.v")).alias("venue_key")).join(F.broadcast(venue_dim(spark)), "venue_key", "left").select("source_paper", "weight")
    return best.join(venue, "source_paper", "left").select("src_id", "edge_type", "dst_id", "confidence", "source_paper", F.coalesce("weight", F.lit(0.15)).alias("venue_weight"), F.lit("extraction").alias("method"), F.lit(False).alias("validated"))


def q_entities_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entities by lower-case name and type; the first spelling stays."""
    e = read(spark, d, "entities").filter("name is not null and type is not null")
    return e.groupBy(F.lower("name").alias("key"), "type").agg(F.min(F.struct("entity_id", "name")).alias("m")).select("key", "type", F.col("m.name").alias("name"))


def q_search_merge(spark: SparkSession, d: str) -> DataFrame:
    """The ten most significant or connected nodes of each type, then the twenty best of all."""
    n = nodes(spark, d).select("node_id", "node_type", "significance")
    w = Window.partitionBy("node_type").orderBy(F.desc("significance"), "node_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").drop("rank").orderBy(F.desc("significance"), "node_id").limit(20)


def q_technique_presence(spark: SparkSession, d: str) -> DataFrame:
    """Names of the seed graph that the extracted graph holds or lacks."""
    have = nodes(spark, d).select(F.lower("name").alias("k")).distinct().withColumn("found", F.lit(True))
    return read(spark, d, "nodes").withColumn("k", F.lower("name")).join(have, "k", "left").select("node_id", F.coalesce("found", F.lit(False)).alias("found"))


def q_novelty_check(spark: SparkSession, d: str) -> DataFrame:
    """Technique-problem pairs that are linked as a limitation and not yet as mitigated: still novel."""
    e = edges(spark, d)
    lim = e.filter("edge_type = 'HAS_LIMITATION'").select("src_id", "dst_id")
    return lim.join(e.filter("edge_type = 'MITIGATES'").select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")


_PROV = f""", vn(k, weight) AS (VALUES {sql_values([(v, TIER_WEIGHTS[t]) for t, vs in VENUES.items() for v in vs])}),
b AS (SELECT st || ':' || source AS src_id, rel AS edge_type, tt || ':' || target AS dst_id, max((coalesce(confidence, -1.0), relation_id, coalesce(arxiv_id, ''))) AS m FROM gr WHERE st IS NOT NULL AND rel IS NOT NULL AND tt IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3),
pv AS (SELECT arxiv_id, max((ingested_at, coalesce(venue, ''))) AS m FROM gp WHERE arxiv_id <> '' GROUP BY 1)
SELECT src_id, edge_type, dst_id, CASE WHEN b.m[1] >= 0 THEN b.m[1] END AS confidence, b.m[3] AS source_paper, coalesce(weight, 0.15)::double AS venue_weight, 'extraction' AS method, false AS validated
FROM b LEFT JOIN pv ON b.m[3] = arxiv_id LEFT JOIN vn ON lower(trim(pv.m[2], ' ')) = k WHERE src_id IN (SELECT node_id FROM gn) AND dst_id IN (SELECT node_id FROM gn)"""
_SEED = ", du AS (SELECT node_id, count(*) AS n FROM (SELECT src_id AS node_id FROM gl UNION ALL SELECT dst_id FROM gl) GROUP BY 1), seed AS (SELECT node_id FROM du ORDER BY n DESC, node_id LIMIT 1), lu AS (SELECT src_id AS node_id, dst_id AS other_id, edge_type, confidence FROM gl UNION ALL SELECT dst_id, src_id, edge_type, confidence FROM gl)"
_NH = G + _SEED + """, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC NULLS FIRST, edge_type, other_id) AS rank FROM lu),
f AS (SELECT 1 AS depth, r.* FROM r WHERE node_id IN (SELECT node_id FROM seed) AND rank <= 50),
s AS (SELECT 2 AS depth, r.* FROM r WHERE node_id IN (SELECT other_id FROM f WHERE rank <= 10) AND rank <= 10)
SELECT least(node_id, other_id) AS a, greatest(node_id, other_id) AS b, edge_type, min(depth) AS depth, round(max(confidence), 6) AS confidence FROM (SELECT * FROM f UNION ALL SELECT * FROM s) GROUP BY 1, 2, 3"""
_CPL = G + """, ci AS (SELECT DISTINCT src_id, dst_id FROM ge WHERE edge_type = 'CITES'), ho AS (SELECT DISTINCT src_id AS paper, dst_id AS item FROM ge WHERE edge_type IN ('INTRODUCES', 'EVALUATES_ON')),
c AS (SELECT item, paper, ci.dst_id AS common FROM ho JOIN ci ON paper = ci.src_id)
SELECT DISTINCT e.src_id, e.edge_type, e.dst_id, round(least(1.0, e.confidence + 0.15), 6) AS confidence FROM ge e JOIN c a ON a.item = e.src_id JOIN c b ON b.item = e.dst_id AND a.common = b.common AND a.paper <> b.paper
WHERE e.confidence < 1 AND e.edge_type NOT IN ('CITES', 'INTRODUCES', 'EVALUATES_ON')"""
QUERIES = {
    "neighbors_out": neighbors_out,
    "neighbors_undirected": neighbors_undirected,
    "neighborhood": q_neighborhood,
    "node_detail": node_detail,
    "scan_edges_among": edges_among,
    "conf_type_filter": conf_type_filter,
    "hover_subgraph": hover_subgraph,
    "bibliographic_coupling_boost": q_coupling,
    "shared_papers": q_shared_references,
    "validate_edge": validate_edges,
    "validate_node_props": validate_props,
    "schema_migrate": duplicate_keys,
    "citation_validate": citation_validate,
    "upsert_papers": q_upsert_papers,
    "upsert_citations": q_upsert_citations,
    "merge_citation_stubs": q_citation_stubs,
    "upsert_entities": q_upsert_entities,
    "upsert_relations": q_upsert_relations,
    "scan_entities_dedup": q_entities_dedup,
    "search_merge_topk": q_search_merge,
    "technique_presence": q_technique_presence,
    "novelty_check_kg": q_novelty_check,
}
SQL = {
    "neighbors_out": G + "SELECT src_id, edge_type, dst_id, coalesce(confidence, 0.5) AS confidence, node_type, name, significance FROM ge JOIN gn ON dst_id = node_id",
    "neighbors_undirected": G + "SELECT node_id, count(DISTINCT other_id) AS neighbors, count(*) AS edges FROM gu GROUP BY 1",
    "neighborhood": _NH,
    "node_detail": G + "SELECT gn.node_id, node_type, count(gu.node_id) AS edges FROM gn LEFT JOIN gu USING (node_id) GROUP BY 1, 2",
    "scan_edges_among": G + "SELECT src_id, edge_type, dst_id FROM gl WHERE src_type IN ('Technique', 'Problem') AND dst_type IN ('Technique', 'Problem')",
    "conf_type_filter": G + "SELECT src_id, edge_type, dst_id FROM ge WHERE src_type <> 'Dataset' AND dst_type <> 'Dataset' AND coalesce(confidence, 1.0) >= 0.7",
    "hover_subgraph": G + _SEED + " SELECT other_id, count(*) AS edges FROM lu WHERE node_id IN (SELECT node_id FROM seed) GROUP BY 1",
    "bibliographic_coupling_boost": _CPL,
    "shared_papers": G + ", c AS (SELECT DISTINCT src_id, dst_id FROM ge WHERE edge_type = 'CITES') SELECT c.src_id, c.dst_id, (SELECT count(*) FROM c a JOIN c b ON a.dst_id = b.dst_id WHERE a.src_id = c.src_id AND b.src_id = c.dst_id) AS shared FROM c",
    "validate_edge": G + f", tr(s, t, o) AS (VALUES {sql_values(TRIPLES)}) SELECT src_type, edge_type, dst_type, count(*) AS n, bool_or(s IS NOT NULL) AS legal FROM ge LEFT JOIN tr ON src_type = s AND edge_type = t AND dst_type = o GROUP BY 1, 2, 3",
    "validate_node_props": "SELECT type, missing, count(*) AS n FROM (SELECT type, 'name' AS missing FROM entities WHERE name IS NULL UNION ALL SELECT type, 'description' FROM entities WHERE description IS NULL UNION ALL SELECT type, 'mathematical_structure' FROM entities WHERE type = 'Technique' AND mathematical_structure IS NULL UNION ALL SELECT type, 'bottleneck_class' FROM entities WHERE type = 'Problem' AND bottleneck_class IS NULL) WHERE type IN ('Technique', 'Problem', 'Dataset') GROUP BY 1, 2",
    "schema_migrate": 'SELECT arxiv_id, count(*) AS "rows" FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1',
    "citation_validate": G + "SELECT src_id, coalesce(string_agg(DISTINCT dst_id, '|' ORDER BY dst_id) FILTER (src_id <> dst_id), '') AS cited, (sum(n) - count(DISTINCT dst_id) FILTER (src_id <> dst_id))::bigint AS dropped FROM ge WHERE edge_type = 'CITES' GROUP BY 1",
    "upsert_papers": G + ", x AS (SELECT title, year, venue, row_number() OVER (PARTITION BY title ORDER BY record_id DESC) AS rn FROM extractions WHERE batch_no > 0 AND title IS NOT NULL) SELECT title, year, venue FROM x WHERE rn = 1 UNION ALL SELECT title, year, nullif(venue, '') FROM gp WHERE title NOT IN (SELECT title FROM x)",
    "upsert_citations": G + "SELECT src_id, dst_id, sum(n)::bigint AS matched FROM gl WHERE edge_type = 'CITES' GROUP BY 1, 2",
    "merge_citation_stubs": G + "SELECT DISTINCT dst_id AS node_id, true AS stub FROM ge WHERE edge_type = 'CITES' AND dst_id NOT IN (SELECT node_id FROM gn)",
    "upsert_entities": "SELECT type, name, description FROM (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY extracted_at DESC, entity_id DESC) AS rn FROM entities WHERE name IS NOT NULL AND type IS NOT NULL) WHERE rn = 1",
    "upsert_relations": G + _PROV,
    "scan_entities_dedup": "SELECT key, type, name FROM (SELECT lower(name) AS key, type, name, row_number() OVER (PARTITION BY lower(name), type ORDER BY entity_id) AS rn FROM entities WHERE name IS NOT NULL AND type IS NOT NULL) WHERE rn = 1",
    "search_merge_topk": G + "SELECT node_id, node_type, significance FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY significance DESC, node_id) AS rn FROM gn) WHERE rn <= 10 ORDER BY significance DESC, node_id LIMIT 20",
    "technique_presence": G + "SELECT n.node_id, lower(n.name) IN (SELECT lower(name) FROM gn WHERE name IS NOT NULL) AS found FROM nodes n",
    "novelty_check_kg": G + "SELECT src_id, dst_id FROM ge a WHERE edge_type = 'HAS_LIMITATION' AND NOT EXISTS (SELECT 1 FROM ge b WHERE b.edge_type = 'MITIGATES' AND a.src_id = b.src_id AND a.dst_id = b.dst_id)",
}
