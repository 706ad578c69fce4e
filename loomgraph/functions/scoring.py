"""Row-level derivations: significance and its factors, display properties, edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import G, NULL_SIGNIFICANCE, TIER_WEIGHTS, VENUES, edge_type_dim, edges, latest_papers, nodes, sql_values, venue_dim
from loomgraph.runtime import read

CURRENT_YEAR = 2025
# Citations a year -> signal, first match; and the signal of each novelty class.
CITATION_STEPS = [(500, 1.0), (100, 0.9), (50, 0.8), (20, 0.7), (10, 0.6), (5, 0.5), (2, 0.4), (1, 0.3)]
CITATION_LEAST = 0.2
NOVELTY = {"novel_technique": 1.0, "significant_improvement": 0.8, "survey": 0.3, "incremental": 0.2}
NOVELTY_DEFAULT = 0.5


def with_venue(papers: DataFrame, known_lab: Column | None = None) -> DataFrame:
    """Adds venue_tier and venue_weight; a known lab lifts the lowest tier to 0.25."""
    lab = F.coalesce(known_lab, F.lit(False)) if known_lab is not None else F.lit(False)
    dim = F.broadcast(venue_dim(papers.sparkSession))
    out = papers.withColumn("venue_key", F.lower(F.trim("venue"))).join(dim, "venue_key", "left")
    tier = F.coalesce("tier", F.lit(6))
    weight = F.when((tier == 6) & lab, 0.25).otherwise(F.coalesce("weight", F.lit(TIER_WEIGHTS[6])))
    return out.withColumn("venue_tier", tier).withColumn("venue_weight", weight).drop("venue_key", "tier", "weight")


def recency_factor(year: Column, now: int = CURRENT_YEAR) -> Column:
    return F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(0.1) * F.greatest(F.lit(0), F.lit(now) - year))


def citation_signal_rate(citations: Column, year: Column, now: int = CURRENT_YEAR) -> Column:
    rate = citations / F.greatest(F.lit(1), F.lit(now) - year)
    out = F.when(rate >= CITATION_STEPS[0][0], CITATION_STEPS[0][1])
    for least, value in CITATION_STEPS[1:]:
        out = out.when(rate >= least, value)
    return out.otherwise(CITATION_LEAST)


def cohort_medians(papers: DataFrame) -> DataFrame:
    """Median citations by venue (as compared) and year; exact percentile, pre-aggregated by count."""
    return papers.filter("venue is not null and year is not null and citation_count is not null").groupBy(F.lower(F.trim("venue")).alias("venue_key"), "year").agg(F.percentile("citation_count", F.lit(0.5)).alias("median"))


def citation_signal_cohort(papers: DataFrame, now: int = CURRENT_YEAR) -> DataFrame:
    """Adds citation_signal: citations against twice the cohort's median, within 0.1..1; without a cohort by rate."""
    cites = F.coalesce("citation_count", F.lit(0))
    joined = papers.withColumn("venue_key", F.lower(F.trim("venue"))).join(cohort_medians(papers), ["venue_key", "year"], "left")
    by_cohort = F.least(F.lit(1.0), F.greatest(F.lit(0.1), cites / (F.lit(2.0) * F.col("median"))))
    return joined.withColumn("citation_signal", F.when(F.col("median") > 0, by_cohort).otherwise(citation_signal_rate(cites, F.coalesce("year", F.lit(now)), now))).drop("venue_key", "median")


def novelty_signal(c: Column) -> Column:
    out = F.lit(NOVELTY_DEFAULT)
    for k, v in NOVELTY.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def year_from_id(c: Column, default: int = CURRENT_YEAR) -> Column:
    """The year in an arXiv id: its first two digits, from 91 on of the last century."""
    yy = F.expr("try_cast(substring(arxiv_id, 1, 2) as int)") if c is None else F.substring(c, 1, 2).try_cast("int")
    return F.when(yy.isNull(), default).when(yy >= 91, 1900 + yy).otherwise(2000 + yy)


def enriched(papers: DataFrame, now: int = CURRENT_YEAR) -> DataFrame:
    """All factors and their product; factors multiply in a fixed order."""
    base = with_venue(papers)
    year = F.coalesce("year", year_from_id(F.col("arxiv_id")))
    base = base.withColumn("recency", recency_factor(year, now)).withColumn("citation_signal", citation_signal_rate(F.coalesce("citation_count", F.lit(0)), year, now)).withColumn("novelty_signal", F.lit(NOVELTY_DEFAULT))
    return base.withColumn("score", F.col("venue_weight") * F.col("citation_signal") * F.col("recency") * F.col("novelty_signal"))


def q_venue_weight(spark: SparkSession, d: str) -> DataFrame:
    return with_venue(latest_papers(read(spark, d, "papers"))).select("title", "venue_tier", "venue_weight")


def q_recency(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(read(spark, d, "papers")).filter("year is not null").select("title", F.round(recency_factor(F.col("year")), 6).alias("recency"))


def q_citation_rate(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(read(spark, d, "papers")).select("title", citation_signal_rate(F.coalesce("citation_count", F.lit(0)), F.coalesce("year", F.lit(CURRENT_YEAR))).alias("signal"))


def q_citation_cohort(spark: SparkSession, d: str) -> DataFrame:
    return citation_signal_cohort(latest_papers(read(spark, d, "papers"))).select("title", F.round("citation_signal", 6).alias("signal"))


def q_novelty(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "extractions").select("record_id", novelty_signal(F.col("novelty.classification")).alias("signal"))


def q_year_from_id(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(read(spark, d, "papers")).select("title", year_from_id(F.col("arxiv_id")).alias("year"))


def q_enriched(spark: SparkSession, d: str) -> DataFrame:
    return enriched(latest_papers(read(spark, d, "papers"))).select("title", "venue_tier", "venue_weight", F.round("recency", 6).alias("recency"), "citation_signal", F.round("score", 6).alias("score"))


def q_results_to_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Significance of stored extractions: their own novelty class, the citation signal a constant half."""
    r = with_venue(read(spark, d, "extractions"))
    year = F.coalesce("year", F.lit(CURRENT_YEAR))
    return r.select("record_id", F.round(F.col("venue_weight") * F.lit(0.5) * recency_factor(year) * novelty_signal(F.col("novelty.classification")), 6).alias("significance"))


def q_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    """Walk weight of each edge: type x confidence x significance of the target, half as much again at nodes of few edges."""
    e = edges(spark, d)
    deg = e.select(F.explode(F.array("src_id", "dst_id")).alias("dst_id")).groupBy("dst_id").agg(F.count("*").alias("degree"))
    t = nodes(spark, d).select(F.col("node_id").alias("dst_id"), "significance")
    j = e.join(t, "dst_id").join(deg, "dst_id").join(F.broadcast(edge_type_dim(spark)), "edge_type")
    w = F.col("walk_weight") * F.coalesce("confidence", F.lit(0.5)) * F.col("significance") * F.when(F.col("degree") <= 5, 1.5).otherwise(1.0)
    return j.select("src_id", "edge_type", "dst_id", "degree", F.round(w, 6).alias("weight"))


def q_node_display(spark: SparkSession, d: str) -> DataFrame:
    """Label, size and snippet as shown: empty names fall back to '?', size follows significance."""
    e = read(spark, d, "entities")
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("?"))
    return e.select("entity_id", label.alias("label"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("snippet"), F.greatest(F.lit(1.0), F.lit(5.0) * F.lit(NULL_SIGNIFICANCE)).alias("size"))


def q_edge_display(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("confidence", F.lit(1.0))
    return edges(spark, d).select("src_id", "edge_type", "dst_id", F.round(F.greatest(F.lit(0.5), 2.0 * c), 6).alias("size"), F.when(c > 0.8, "high").when(c > 0.5, "medium").otherwise("low").alias("band"))


def q_describe_path(spark: SparkSession, d: str) -> DataFrame:
    """Two-step paths from papers, as text."""
    e = edges(spark, d)
    a = e.filter("edge_type = 'INTRODUCES'").select("src_id", F.col("dst_id").alias("mid"), F.coalesce("confidence", F.lit(0.5)).alias("c1"))
    b = e.filter("edge_type = 'HAS_LIMITATION'").select(F.col("src_id").alias("mid"), "dst_id", F.coalesce("confidence", F.lit(0.5)).alias("c2"))
    j = a.join(b, "mid").withColumn("score", F.round(F.col("c1") * F.col("c2"), 4))
    return j.select(F.concat("src_id", F.lit(" -[INTRODUCES]-> "), "mid", F.lit(" -[HAS_LIMITATION]-> "), "dst_id").alias("path"), "score")


_TIERS = sql_values([(v, t, TIER_WEIGHTS[t]) for t, vs in VENUES.items() for v in vs])
_V = f"v(k, tier, weight) AS (VALUES {_TIERS})"
_REC = "greatest(0.3, 1.0 - 0.1 * greatest(0, 2025 - {}))"
_RATE = "CASE " + " ".join(f"WHEN {{0}} >= {a} THEN {float(b)}" for a, b in CITATION_STEPS) + f" ELSE {CITATION_LEAST} END"
_NOV = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in NOVELTY.items()) + f" ELSE {NOVELTY_DEFAULT} END"
_YID = "CASE WHEN try_cast(substring(arxiv_id, 1, 2) AS int) IS NULL THEN 2025 WHEN try_cast(substring(arxiv_id, 1, 2) AS int) >= 91 THEN 1900 + try_cast(substring(arxiv_id, 1, 2) AS int) ELSE 2000 + try_cast(substring(arxiv_id, 1, 2) AS int) END"
_R0 = _RATE.format("(coalesce(citation_count, 0)::double / greatest(1, 2025 - coalesce(year, 2025)))")
QUERIES = {
    "venue_weight": q_venue_weight,
    "recency_factor": q_recency,
    "citation_signal_rate": q_citation_rate,
    "citation_signal_cohort": q_citation_cohort,
    "novelty_signal": q_novelty,
    "year_from_id": q_year_from_id,
    "enrich_metadata": q_enriched,
    "results_to_metadata": q_results_to_metadata,
    "edge_transition_weight": q_edge_weight,
    "node_display": q_node_display,
    "edge_display": q_edge_display,
    "describe_path": q_describe_path,
}
SQL = {
    "venue_weight": G + f", {_V} SELECT title, coalesce(tier, 6) AS venue_tier, coalesce(weight, 0.15)::double AS venue_weight FROM gp LEFT JOIN v ON lower(trim(venue, ' ')) = k",
    "recency_factor": G + f"SELECT title, round({_REC.format('year')}::double, 6) AS recency FROM gp WHERE year IS NOT NULL",
    "citation_signal_rate": G + f"SELECT title, ({_R0})::double AS signal FROM gp",
    "citation_signal_cohort": G + f", co AS (SELECT lower(trim(venue, ' ')) AS k, year AS y, quantile_cont(citation_count, 0.5) AS m FROM gp WHERE venue IS NOT NULL AND year IS NOT NULL AND citation_count IS NOT NULL GROUP BY 1, 2) SELECT title, round(CASE WHEN m > 0 THEN least(1.0, greatest(0.1, coalesce(citation_count, 0)::double / (2.0 * m))) ELSE {_R0} END::double, 6) AS signal FROM gp LEFT JOIN co ON lower(trim(venue, ' ')) = k AND year = y",
    "novelty_signal": f"SELECT record_id, ({_NOV.format('novelty.classification')})::double AS signal FROM extractions",
    "year_from_id": G + f"SELECT title, {_YID} AS year FROM gp",
    "enrich_metadata": G + f", {_V}, x AS (SELECT *, coalesce(year, {_YID}) AS yy FROM gp LEFT JOIN v ON lower(trim(venue, ' ')) = k), f AS (SELECT title, coalesce(tier, 6) AS venue_tier, coalesce(weight, 0.15)::double AS venue_weight, {_REC.format('yy')}::double AS recency, ({_RATE.format('(coalesce(citation_count, 0)::double / greatest(1, 2025 - yy))')})::double AS citation_signal FROM x) SELECT title, venue_tier, venue_weight, round(recency, 6) AS recency, citation_signal, round(venue_weight * citation_signal * recency * 0.5::double, 6) AS score FROM f",
    "results_to_metadata": f"WITH {_V} SELECT record_id, round(coalesce(weight, 0.15)::double * 0.5::double * {_REC.format('coalesce(year, 2025)')}::double * ({_NOV.format('novelty.classification')})::double, 6) AS significance FROM extractions LEFT JOIN v ON lower(trim(venue, ' ')) = k",
    "edge_transition_weight": G + ", dg AS (SELECT node_id, count(*) AS degree FROM gu GROUP BY 1) SELECT src_id, edge_type, dst_id, degree, round(walk_weight::double * coalesce(confidence, 0.5) * significance * (CASE WHEN degree <= 5 THEN 1.5 ELSE 1.0 END)::double, 6) AS weight FROM ge JOIN gn ON dst_id = gn.node_id JOIN dg ON dst_id = dg.node_id JOIN et USING (edge_type)",
    "node_display": "SELECT entity_id, coalesce(nullif(name, ''), '?') AS label, substring(coalesce(description, ''), 1, 200) AS snippet, 2.5::double AS size FROM entities",
    "edge_display": G + "SELECT src_id, edge_type, dst_id, round(greatest(0.5, 2.0 * coalesce(confidence, 1.0))::double, 6) AS size, CASE WHEN coalesce(confidence, 1.0) > 0.8 THEN 'high' WHEN coalesce(confidence, 1.0) > 0.5 THEN 'medium' ELSE 'low' END AS band FROM ge",
    "describe_path": G + "SELECT a.src_id || ' -[INTRODUCES]-> ' || a.dst_id || ' -[HAS_LIMITATION]-> ' || b.dst_id AS path, round(coalesce(a.confidence, 0.5) * coalesce(b.confidence, 0.5), 4) AS score FROM ge a JOIN ge b ON a.dst_id = b.src_id AND a.edge_type = 'INTRODUCES' AND b.edge_type = 'HAS_LIMITATION'",
}
