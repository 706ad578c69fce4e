"""The property graph as two DataFrames, nodes and edges, with its dimension tables.

Fixed values below must equal the published data model; they are small, so they join by broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import read

# Edge types with their weights in walks and in activation waves.
EDGE_TYPES = [
    ("CITES", 0.3, 0.3),
    ("INTRODUCES", 0.8, 0.9),
    ("EVALUATES_ON", 0.5, 0.5),
    ("HAS_LIMITATION", 0.9, 0.8),
    ("MITIGATES", 1.0, 0.9),
    ("IMPROVES_OVER", 0.85, 0.85),
    ("USES", 0.7, 0.7),
    ("IS_INSTANCE_OF", 0.6, 0.6),
    ("CAUSED_BY", 0.8, 0.7),
    ("TEMPORALLY_FOLLOWS", 0.4, 0.5),
    ("SAME_AS", 0.1, 0.1),
]
# Node types, and the legal triples.
NODE_TYPES = ["Paper", "Technique", "Problem", "Dataset"]
TRIPLES = [
    ("Paper", "CITES", "Paper"),
    ("Paper", "INTRODUCES", "Technique"),
    ("Paper", "EVALUATES_ON", "Dataset"),
    ("Technique", "HAS_LIMITATION", "Problem"),
    ("Technique", "MITIGATES", "Problem"),
    ("Technique", "IMPROVES_OVER", "Technique"),
    ("Technique", "USES", "Technique"),
    ("Problem", "IS_INSTANCE_OF", "Problem"),
    ("Technique", "IS_INSTANCE_OF", "Technique"),
    ("Problem", "CAUSED_BY", "Problem"),
    ("Technique", "TEMPORALLY_FOLLOWS", "Technique"),
    ("Technique", "SAME_AS", "Technique"),
    ("Problem", "SAME_AS", "Problem"),
    ("Dataset", "SAME_AS", "Dataset"),
]
# Venues by tier, and the weight of each tier.
VENUES = {
    1: ["neurips", "icml", "iclr", "cvpr", "iccv", "acl", "emnlp", "jmlr", "tpami"],
    2: ["aaai", "ijcai", "eccv", "kdd", "colt", "naacl", "aistats"],
    3: ["uai", "wsdm", "corl", "mlsys", "nature machine intelligence", "tmlr", "sigir"],
    4: ["sosp", "s&p", "chi", "siggraph"],
}
TIER_WEIGHTS = {1: 1.0, 2: 0.85, 3: 0.7, 4: 0.55, 5: 0.35, 6: 0.15}
DEFAULT_TIER = 6

NULL_CONFIDENCE, NULL_SIGNIFICANCE = 0.5, 0.5


def edge_type_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_TYPES, "edge_type string, walk_weight double, wave_weight double")


def triple_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRIPLES, "src_type string, edge_type string, dst_type string")


def venue_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, t, TIER_WEIGHTS[t]) for t, vs in VENUES.items() for v in vs], "venue_key string, tier int, weight double")


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z]+", ""))


def as_label(c: Column, labels: list[str]) -> Column:
    """The label that is meant, whatever its case, spacing and punctuation; null if none is."""
    known = F.create_map(*[F.lit(x) for label in labels for x in (re.sub("[^A-Za-z]", "", label).lower(), label)])
    return F.try_element_at(known, _letters(c))


def node_id(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit(":"), key)


def latest_papers(papers: DataFrame) -> DataFrame:
    """One row per title: the last ingested (then by id, count, venue, year, significance). Pre-aggregates; no window."""
    row = F.struct("ingested_at", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), F.coalesce("citation_count", F.lit(-1)).alias("citations"), F.coalesce("venue", F.lit("")).alias("v"), F.coalesce("year", F.lit(-1)).alias("y"), F.coalesce("significance", F.lit(-1.0)).alias("s"))
    best = papers.filter("title is not null").groupBy("title").agg(F.max(row).alias("r"))
    keep = lambda c, none: F.when(F.col(f"r.{c}") != none, F.col(f"r.{c}"))
    return best.select("title", "r.arxiv_id", "r.ingested_at", keep("citations", -1).alias("citation_count"), keep("v", "").alias("venue"), keep("y", -1).alias("year"), keep("s", -1.0).alias("significance"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, node_type, name, significance, year, venue): papers by title, the entities of the flat table by type and name."""
    p = latest_papers(read(spark, d, "papers")).select(node_id(F.lit("Paper"), F.col("title")).alias("node_id"), F.lit("Paper").alias("node_type"), F.col("title").alias("name"), F.coalesce("significance", F.lit(NULL_SIGNIFICANCE)).alias("significance"), "year", "venue")
    e = read(spark, d, "entities").filter("name is not null").select(as_label(F.col("type"), NODE_TYPES[1:]).alias("type"), "name").filter("type is not null").distinct()
    e = e.select(node_id(F.col("type"), F.col("name")).alias("node_id"), F.col("type").alias("node_type"), "name", F.lit(NULL_SIGNIFICANCE).alias("significance"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("venue"))
    return p.unionByName(e)


def typed_relations(spark: SparkSession, d: str) -> DataFrame:
    """relations with the labels that their types and relation mean: (source, st, relation, target, tt, confidence)."""
    return read(spark, d, "relations").select("source", as_label(F.col("source_type"), NODE_TYPES).alias("st"), as_label(F.col("relation"), [t[0] for t in EDGE_TYPES]).alias("relation"), "target", as_label(F.col("target_type"), NODE_TYPES).alias("tt"), "confidence")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src_id, edge_type, dst_id, src_type, dst_type, confidence, n): one row per typed edge, the best confidence."""
    r = typed_relations(spark, d).filter("st is not null and relation is not null and tt is not null and source is not null and target is not null")
    r = r.select(node_id(F.col("st"), F.col("source")).alias("src_id"), F.col("relation").alias("edge_type"), node_id(F.col("tt"), F.col("target")).alias("dst_id"), F.col("st").alias("src_type"), F.col("tt").alias("dst_type"), "confidence")
    return r.groupBy("src_id", "edge_type", "dst_id", "src_type", "dst_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def relation_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of relations become edges, and why the others do not: (outcome, n)."""
    why = F.when(F.col("source").isNull() | F.col("target").isNull(), "no end").when(F.col("relation").isNull(), "unknown relation").when(F.col("st").isNull() | F.col("tt").isNull(), "unknown type").otherwise("edge")
    return typed_relations(spark, d).groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def linked_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose both ends are nodes."""
    n = nodes(spark, d).select("node_id")
    e = edges(spark, d)
    return e.join(n.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(n.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")


def undirected(e: DataFrame) -> DataFrame:
    """Each edge from either end: (node_id, other_id, edge_type, confidence)."""
    ends = F.array(F.struct(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id")), F.struct(F.col("dst_id").alias("node_id"), F.col("src_id").alias("other_id")))
    return e.select("edge_type", "confidence", F.inline(ends))


def sql_list(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def sql_label(x: str, labels: list[str]) -> str:
    """as_label in SQL."""
    whens = " ".join(f"WHEN '{re.sub('[^A-Za-z]', '', t).lower()}' THEN '{t}'" for t in labels)
    return f"CASE lower(regexp_replace({x}, '[^A-Za-z]+', '', 'g')) {whens} END"


_RELS = [t[0] for t in EDGE_TYPES]
#: The same graph in SQL: views gp (papers), gn (nodes), ge (edges), gl (linked edges), gu (undirected), et (edge types).
G = f"""
WITH et(edge_type, walk_weight, wave_weight) AS (VALUES {sql_values(EDGE_TYPES)}),
gp AS (SELECT * FROM (SELECT title, coalesce(arxiv_id, '') AS arxiv_id, ingested_at, citation_count, venue, year, significance, row_number() OVER (PARTITION BY title
  ORDER BY ingested_at DESC, coalesce(arxiv_id, '') DESC, coalesce(citation_count, -1) DESC, coalesce(venue, '') DESC, coalesce(year, -1) DESC, coalesce(significance, -1.0) DESC) AS rn
  FROM papers WHERE title IS NOT NULL) WHERE rn = 1),
gn AS (SELECT 'Paper:' || title AS node_id, 'Paper' AS node_type, title AS name, coalesce(significance, 0.5) AS significance, year, nullif(venue, '') AS venue FROM gp
  UNION ALL SELECT DISTINCT t || ':' || name, t, name, 0.5, CAST(NULL AS INT), CAST(NULL AS VARCHAR) FROM (SELECT {sql_label('type', NODE_TYPES[1:])} AS t, name FROM entities) WHERE t IS NOT NULL AND name IS NOT NULL),
gr AS (SELECT relation_id, arxiv_id, source, {sql_label('source_type', NODE_TYPES)} AS st, {sql_label('relation', _RELS)} AS rel, target, {sql_label('target_type', NODE_TYPES)} AS tt, confidence FROM relations),
ge AS MATERIALIZED (SELECT st || ':' || source AS src_id, rel AS edge_type, tt || ':' || target AS dst_id, st AS src_type, tt AS dst_type, max(confidence) AS confidence, count(*) AS n
  FROM gr WHERE st IS NOT NULL AND rel IS NOT NULL AND tt IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
gl AS (SELECT * FROM ge WHERE src_id IN (SELECT node_id FROM gn) AND dst_id IN (SELECT node_id FROM gn)),
gu AS (SELECT src_id AS node_id, dst_id AS other_id, edge_type, confidence FROM ge UNION ALL SELECT dst_id, src_id, edge_type, confidence FROM ge)
"""
