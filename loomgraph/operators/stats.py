"""Dashboard aggregates: counts, distributions, degrees, summaries, extraction-quality rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import G, NODE_TYPES, VENUES, edge_type_dim, edges, latest_papers, linked_edges, nodes, relation_rows, sql_list, sql_values, undirected, venue_dim
from loomgraph.runtime import cut, read

# Which types each relation may join, for the direction check.
DIRECTIONS = [
    ("INTRODUCES", "paper", "technique"),
    ("EVALUATES_ON", "paper", "dataset"),
    ("HAS_LIMITATION", "technique", "problem"),
    ("MITIGATES", "technique", "problem"),
    ("IMPROVES_OVER", "technique", "technique"),
    ("USES", "technique", "technique"),
    ("IS_INSTANCE_OF", "technique|problem", "technique|problem"),
    ("CAUSED_BY", "problem", "problem"),
    ("TEMPORALLY_FOLLOWS", "technique", "technique"),
]
# Targets that are too vague to improve over, in cleaning and in judging, and names of no real dataset.
VAGUE_CLEAN = ["existing methods", "previous approaches", "prior work", "existing best results", "baseline", "baselines", "existing models", "previous methods", "state-of-the-art", "existing approaches", "traditional methods"]
VAGUE_JUDGE = ["existing methods", "existing approaches", "previous methods", "previous approaches", "prior work", "baseline", "baselines", "existing best results", "state-of-the-art", "current methods", "traditional methods", "conventional approaches"]
GENERIC_DATASETS = ["i.i.d.", "datasets", "large-scale", "real-world", "synthetic", "training data", "test data", "benchmark data"]


#: Rounds of label propagation.
COMMUNITY_ROUNDS = 5


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges per type, types without edges with 0."""
    n = edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"))
    return F.broadcast(edge_type_dim(spark)).select("edge_type").join(n, "edge_type", "left").select("edge_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).groupBy("node_type").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(t,) for t in NODE_TYPES], "node_type string").join(n, "node_type", "left").select("node_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") > 0.5, "medium").otherwise("low")
    return edges(spark, d).filter("confidence is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def year_distribution(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(read(spark, d, "papers")).filter("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    p = latest_papers(read(spark, d, "papers")).withColumn("venue_key", F.lower(F.trim("venue")))
    return p.join(F.broadcast(venue_dim(spark)), "venue_key", "left").groupBy(F.coalesce("tier", F.lit(6)).alias("tier")).agg(F.count("*").alias("n"))


def hypothesis_summary(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "hypotheses")
    return h.agg(F.count("*").alias("total"), F.coalesce(F.sum("feedback_up"), F.lit(0)).alias("up"), F.coalesce(F.sum("feedback_down"), F.lit(0)).alias("down"))


def community_overview(nodes_in: DataFrame, community: str, top: int = 50) -> DataFrame:
    """Per community its size and dominant type (most nodes, then by name); the largest `top`."""
    each = nodes_in.groupBy(community, "node_type").agg(F.count("*").alias("n"))
    best = each.groupBy(community).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "node_type")).alias("b"))
    return best.select(F.col(community).alias("community"), "total", F.col("b.node_type").alias("dominant")).orderBy(F.desc("total"), "community").limit(top)


def communities(arcs: DataFrame, n: DataFrame, rounds: int = COMMUNITY_ROUNDS) -> DataFrame:
    """(node_id, community) by label propagation: in each round every node takes the label that most of its edges lead to, the
    smallest of equals; nodes without edges keep their own. arcs(node_id, other_id) go both ways. Labels are counted before
    they meet, so a hub is a count."""
    arcs, labels = cut(arcs), n.select("node_id", F.col("node_id").alias("community"))
    for _ in range(rounds):
        said = arcs.join(labels.withColumnRenamed("node_id", "other_id"), "other_id").groupBy("node_id", "community").agg(F.count("*").alias("c"))
        best = said.groupBy("node_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "community")).alias("b")).select("node_id", F.col("b.community").alias("new"))
        labels = cut(labels.join(best, "node_id", "left").select("node_id", F.coalesce("new", "community").alias("community")))
    return labels


def q_communities(spark: SparkSession, d: str) -> DataFrame:
    return communities(undirected(linked_edges(spark, d)).select("node_id", "other_id"), nodes(spark, d))


def q_community_overview(spark: SparkSession, d: str) -> DataFrame:
    return community_overview(nodes(spark, d).select("node_id", "node_type").join(q_communities(spark, d), "node_id"), "community")


def degrees(e: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree) in one shuffle over distinct arcs."""
    pairs = e.select("src_id", "dst_id").distinct()
    ends = F.array(F.struct(F.col("src_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return pairs.select(F.inline(ends)).groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_top_cited(spark: SparkSession, d: str) -> DataFrame:
    cites = edges(spark, d).filter("edge_type = 'CITES'")
    p = nodes(spark, d).filter("node_type = 'Paper'").select("node_id")
    out = p.join(degrees(cites), "node_id", "left").select("node_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    return out.orderBy(F.desc("in_degree"), "node_id").limit(10)


def citation_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals, mean degrees over the corpus, and isolated papers."""
    cites = edges(spark, d).filter("edge_type = 'CITES'")
    p = nodes(spark, d).filter("node_type = 'Paper'").select("node_id").join(degrees(cites), "node_id", "left").select(F.coalesce("out_degree", F.lit(0)).alias("o"), F.coalesce("in_degree", F.lit(0)).alias("i"))
    return p.agg(F.count("*").alias("papers"), F.sum("o").alias("edges_out"), F.round(F.avg("o"), 2).alias("avg_out"), F.round(F.avg("i"), 2).alias("avg_in"), F.max("o").alias("max_out"), F.max("i").alias("max_in"), F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("isolated"))


def isolated_papers(spark: SparkSession, d: str) -> DataFrame:
    cites = edges(spark, d).filter("edge_type = 'CITES'")
    ends = cites.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    return nodes(spark, d).filter("node_type = 'Paper'").select("node_id").join(ends, "node_id", "left_anti")


def ingestion_summary(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "papers")
    return p.agg(F.count("*").alias("ingested"), F.count_distinct("arxiv_id").alias("papers"), F.count_if(F.col("venue").isNull()).alias("no_venue"), F.round(F.avg("significance"), 4).alias("avg_significance"))


def flat_relations(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.inline("relations"))


def _checked(rel: DataFrame, vague: list[str]) -> DataFrame:
    """Flags of one relation: self reference, wrong direction, vague target, unknown types. Types are compared in lower case."""
    spark = rel.sparkSession
    low = rel.withColumn("st", F.lower(F.coalesce("source_type", F.lit("")))).withColumn("tt", F.lower(F.coalesce("target_type", F.lit(""))))
    rules = F.broadcast(spark.createDataFrame(DIRECTIONS, "relation string, want_s string, want_t string"))
    low = low.join(rules, "relation", "left")
    ok = F.array_contains(F.split("want_s", r"\|"), F.col("st")) & F.array_contains(F.split("want_t", r"\|"), F.col("tt"))
    return low.select(
        "*",
        ((F.coalesce("source", F.lit("")) == F.coalesce("target", F.lit(""))) & (F.col("st") == F.col("tt"))).alias("is_self"),
        (F.col("want_s").isNotNull() & ~ok).alias("is_reversed"),
        F.coalesce((F.col("relation") == "IMPROVES_OVER") & F.lower("target").isin(vague), F.lit(False)).alias("is_vague"),
        (~F.col("st").isin([t.lower() for t in NODE_TYPES]) | ~F.col("tt").isin([t.lower() for t in NODE_TYPES]) | F.col("want_s").isNull()).alias("is_unknown"),
    )


def relation_clean(records: DataFrame) -> DataFrame:
    """Every extracted relation with the first reason to drop it, or null if it stays."""
    reason = F.when(F.col("is_self"), "self_reference").when(F.col("is_reversed"), "wrong_types").when(F.col("is_vague"), "vague_target").when(F.col("is_unknown"), "invalid_types")
    return _checked(flat_relations(records), VAGUE_CLEAN).withColumn("drop_reason", reason)


def q_relation_clean(spark: SparkSession, d: str) -> DataFrame:
    return relation_clean(read(spark, d, "extractions")).groupBy("record_id").agg(F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason") == "self_reference").alias("self_reference"), F.count_if(F.col("drop_reason") == "wrong_types").alias("wrong_types"), F.count_if(F.col("drop_reason") == "vague_target").alias("vague_target"), F.count_if(F.col("drop_reason") == "invalid_types").alias("invalid_types"))


def schema_conformance(records: DataFrame) -> DataFrame:
    """Per record: missing structures, generic datasets, bad relations, and whether it passes."""
    missing = lambda c: F.lower(F.coalesce(c, F.lit(""))).isin("", "none", "n/a")
    es = F.coalesce("entities", F.array().cast(records.schema["entities"].dataType))
    generic = lambda e: F.coalesce(F.exists(F.array(*[F.lit(g) for g in GENERIC_DATASETS]), lambda g: F.lower(e["name"]).contains(g)), F.lit(False))
    per = records.select(
        "record_id",
        F.size(F.filter(es, lambda e: (e["type"] == "Technique") & missing(e["mathematical_structure"]))).alias("no_structure"),
        F.size(F.filter(es, lambda e: (e["type"] == "Problem") & missing(e["bottleneck_class"]))).alias("no_bottleneck"),
        F.size(F.filter(es, lambda e: (e["type"] == "Dataset") & generic(e))).alias("generic_datasets"),
    )
    rel = _checked(flat_relations(records), VAGUE_JUDGE).groupBy("record_id").agg(F.count_if("is_self").alias("self_references"), F.count_if("is_reversed").alias("reversed"), F.count_if("is_vague").alias("vague"))
    out = per.join(rel, "record_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("self_references", "reversed", "vague")]
    out = out.select("record_id", "no_structure", "no_bottleneck", "generic_datasets", *zero)
    return out.withColumn("passed", (F.col("self_references") == 0) & (F.col("reversed") == 0))


def q_schema_conformance(spark: SparkSession, d: str) -> DataFrame:
    return schema_conformance(read(spark, d, "extractions"))


def q_schema_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    c = q_schema_conformance(spark, d)
    return c.agg(F.count("*").alias("records"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


def accuracy(verdicts: DataFrame, group: str) -> DataFrame:
    """Macro average: mean over groups of the share of correct verdicts in each (verdicts: group, correct)."""
    per = verdicts.groupBy(group).agg(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")).alias("a"))
    return per.agg(F.count("*").alias("groups"), F.round(F.avg("a"), 6).alias("accuracy"))


def q_eval_rates(spark: SparkSession, d: str) -> DataFrame:
    """The extraction report: records that pass the schema checks, mean accuracy of entities (named and of a known type) and of
    relations (kept by the cleaning), and whether each is above the gate of 0.8."""
    x = read(spark, d, "extractions")
    e = x.select("record_id", F.inline("entities")).select("record_id", (F.coalesce(F.trim("name"), F.lit("")) != "").alias("named"), F.coalesce(F.col("type").isin(NODE_TYPES), F.lit(False)).alias("typed"))
    entity = accuracy(e.select("record_id", (F.col("named") & F.col("typed")).alias("correct")), "record_id").select(F.lit("entity").alias("rate"), "groups", "accuracy")
    kept = relation_clean(x).select("record_id", F.col("drop_reason").isNull().alias("correct"))
    relation = accuracy(kept, "record_id").select(F.lit("relation").alias("rate"), "groups", "accuracy")
    schema = schema_conformance(x).agg(F.lit("schema").alias("rate"), F.count("*").alias("groups"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy")).select("rate", "groups", "accuracy")
    return entity.unionByName(relation).unionByName(schema).withColumn("passes", F.when(F.col("rate") == "schema", F.col("accuracy") >= 1.0).otherwise(F.col("accuracy") > 0.8))


def q_novelty_mix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "extractions").groupBy(F.col("novelty.classification").alias("classification")).agg(F.count("*").alias("n"), F.round(F.avg("novelty.confidence"), 6).alias("confidence"))


_DIR = f"dirs(relation, want_s, want_t) AS (VALUES {sql_values(DIRECTIONS)})"
_REL = f"""{_DIR},
rel AS (SELECT record_id, unnest(relations, recursive := true) FROM extractions),
chk AS (SELECT rel.*, lower(coalesce(source_type, '')) AS st, lower(coalesce(target_type, '')) AS tt, want_s, want_t FROM rel LEFT JOIN dirs USING (relation)),
flags AS (SELECT *, coalesce(source, '') = coalesce(target, '') AND st = tt AS is_self,
  want_s IS NOT NULL AND NOT (list_contains(string_split(want_s, '|'), st) AND list_contains(string_split(want_t, '|'), tt)) AS is_reversed,
  st NOT IN ('paper', 'technique', 'problem', 'dataset') OR tt NOT IN ('paper', 'technique', 'problem', 'dataset') OR want_s IS NULL AS is_unknown FROM chk),
clean AS (SELECT *, CASE WHEN is_self THEN 'self_reference' WHEN is_reversed THEN 'wrong_types' WHEN coalesce(relation = 'IMPROVES_OVER' AND lower(target) IN ({sql_list(VAGUE_CLEAN)}), false) THEN 'vague_target' WHEN is_unknown THEN 'invalid_types' END AS drop_reason FROM flags)"""
_GEN = " OR ".join(f"contains(lower(e.name), '{g}')" for g in GENERIC_DATASETS)
_MISS = "lower(coalesce({}, '')) IN ('', 'none', 'n/a')"
_CONF = f"""WITH {_REL},
ent AS (SELECT record_id, unnest(entities) AS e FROM extractions),
ea AS (SELECT record_id, count(*) FILTER (e.type = 'Technique' AND {_MISS.format('e.mathematical_structure')}) AS no_structure, count(*) FILTER (e.type = 'Problem' AND {_MISS.format('e.bottleneck_class')}) AS no_bottleneck,
  count(*) FILTER (e.type = 'Dataset' AND coalesce({_GEN}, false)) AS generic_datasets FROM ent GROUP BY 1),
ra AS (SELECT record_id, count(*) FILTER (is_self) AS self_references, count(*) FILTER (is_reversed) AS reversed, count(*) FILTER (coalesce(relation = 'IMPROVES_OVER' AND lower(target) IN ({sql_list(VAGUE_JUDGE)}), false)) AS vague FROM flags GROUP BY 1),
conf AS (SELECT x.record_id, coalesce(no_structure, 0)::int AS no_structure, coalesce(no_bottleneck, 0)::int AS no_bottleneck, coalesce(generic_datasets, 0)::int AS generic_datasets, coalesce(self_references, 0) AS self_references, coalesce(reversed, 0) AS reversed, coalesce(vague, 0) AS vague,
  coalesce(self_references, 0) = 0 AND coalesce(reversed, 0) = 0 AS passed FROM extractions x LEFT JOIN ea USING (record_id) LEFT JOIN ra USING (record_id))"""
_CITED = G + """, c AS (SELECT DISTINCT src_id, dst_id FROM ge WHERE edge_type = 'CITES'),
dg AS (SELECT node_id, (SELECT count(*) FROM c WHERE src_id = node_id) AS o, (SELECT count(*) FROM c WHERE dst_id = node_id) AS i FROM gn WHERE node_type = 'Paper')"""
_COMM = G + ", bi AS MATERIALIZED (SELECT src_id AS node_id, dst_id AS other_id FROM gl UNION ALL SELECT dst_id, src_id FROM gl), c0 AS (SELECT node_id, node_id AS community FROM gn)" + "".join(
    f", b{k} AS MATERIALIZED (SELECT node_id, min((-c, community)) AS m FROM (SELECT bi.node_id, community, count(*) AS c FROM bi JOIN c{k - 1} l ON other_id = l.node_id GROUP BY 1, 2) GROUP BY 1), c{k} AS MATERIALIZED (SELECT l.node_id, coalesce(m[2], community) AS community FROM c{k - 1} l LEFT JOIN b{k} USING (node_id))"
    for k in range(1, COMMUNITY_ROUNDS + 1)
) + f", lb AS (SELECT * FROM c{COMMUNITY_ROUNDS})"
_TIERS = sql_values([(v, t) for t, vs in VENUES.items() for v in vs])

QUERIES = {
    "edge_counts": edge_counts,
    "relation_rows": relation_rows,
    "node_counts": node_counts,
    "confidence_bands": confidence_bands,
    "year_distribution": year_distribution,
    "tier_distribution": tier_distribution,
    "hypothesis_summary": hypothesis_summary,
    "community_overview": q_community_overview,
    "degree_top_cited": degree_top_cited,
    "citation_graph_stats": citation_graph_stats,
    "isolated_papers": isolated_papers,
    "ingestion_summary": ingestion_summary,
    "relation_clean": q_relation_clean,
    "schema_conformance": q_schema_conformance,
    "schema_pass_rate": q_schema_pass_rate,
    "eval_rates": q_eval_rates,
    "community_detection": q_communities,
    "novelty_mix": q_novelty_mix,
}
SQL = {
    "relation_rows": G + "SELECT CASE WHEN source IS NULL OR target IS NULL THEN 'no end' WHEN rel IS NULL THEN 'unknown relation' WHEN st IS NULL OR tt IS NULL THEN 'unknown type' ELSE 'edge' END AS outcome, count(*) AS n FROM gr GROUP BY 1",
    "edge_counts": G + "SELECT et.edge_type, count(ge.src_id) AS n FROM et LEFT JOIN ge USING (edge_type) GROUP BY 1",
    "node_counts": G + f"SELECT t.node_type, count(gn.node_id) AS n FROM (VALUES {sql_values([(t,) for t in NODE_TYPES])}) t(node_type) LEFT JOIN gn USING (node_type) GROUP BY 1",
    "confidence_bands": G + "SELECT CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM ge WHERE confidence IS NOT NULL GROUP BY 1",
    "year_distribution": G + "SELECT year, count(*) AS n FROM gp WHERE year IS NOT NULL GROUP BY 1",
    "tier_distribution": G + f"SELECT coalesce(tier, 6) AS tier, count(*) AS n FROM gp LEFT JOIN (VALUES {_TIERS}) v(k, tier) ON lower(trim(venue, ' ')) = k GROUP BY 1",
    "hypothesis_summary": "SELECT count(*) AS total, coalesce(sum(feedback_up), 0)::bigint AS up, coalesce(sum(feedback_down), 0)::bigint AS down FROM hypotheses",
    "community_overview": _COMM + ", x AS (SELECT community, node_type, count(*) AS n FROM lb JOIN gn USING (node_id) GROUP BY 1, 2) SELECT community, sum(n)::bigint AS total, (arg_min(node_type, (-n, node_type))) AS dominant FROM x GROUP BY 1 ORDER BY total DESC, community LIMIT 50",
    "community_detection": _COMM + " SELECT node_id, community FROM lb",
    "degree_top_cited": _CITED + "SELECT node_id, o AS out_degree, i AS in_degree FROM dg ORDER BY i DESC, node_id LIMIT 10",
    "citation_graph_stats": _CITED + "SELECT count(*) AS papers, sum(o)::bigint AS edges_out, round(avg(o), 2) AS avg_out, round(avg(i), 2) AS avg_in, max(o) AS max_out, max(i) AS max_in, count(*) FILTER (o = 0 AND i = 0) AS isolated FROM dg",
    "isolated_papers": _CITED + "SELECT node_id FROM dg WHERE o = 0 AND i = 0",
    "ingestion_summary": "SELECT count(*) AS ingested, count(DISTINCT arxiv_id) AS papers, count(*) FILTER (venue IS NULL) AS no_venue, round(avg(significance), 4) AS avg_significance FROM papers",
    "relation_clean": f"WITH {_REL} SELECT record_id, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason = 'self_reference') AS self_reference, count(*) FILTER (drop_reason = 'wrong_types') AS wrong_types, count(*) FILTER (drop_reason = 'vague_target') AS vague_target, count(*) FILTER (drop_reason = 'invalid_types') AS invalid_types FROM clean GROUP BY 1",
    "schema_conformance": _CONF + " SELECT * FROM conf",
    "schema_pass_rate": _CONF + " SELECT count(*) AS records, round(avg(passed::int), 6) AS pass_rate FROM conf",
    "eval_rates": _CONF + f""", er AS (SELECT record_id, avg((coalesce(trim(e.name, ' '), '') <> '' AND coalesce(e.type IN ({sql_list(NODE_TYPES)}), false))::int) AS a FROM ent GROUP BY 1), rr AS (SELECT record_id, avg((drop_reason IS NULL)::int) AS a FROM clean GROUP BY 1),
u AS (SELECT 'entity' AS rate, count(*) AS groups, round(avg(a), 6) AS accuracy FROM er UNION ALL SELECT 'relation', count(*), round(avg(a), 6) FROM rr UNION ALL SELECT 'schema', count(*), round(avg(passed::int), 6) FROM conf) SELECT *, CASE WHEN rate = 'schema' THEN accuracy >= 1.0 ELSE accuracy > 0.8 END AS passes FROM u""",
    "novelty_mix": "SELECT novelty.classification AS classification, count(*) AS n, round(avg(novelty.confidence), 6) AS confidence FROM extractions GROUP BY 1",
}
