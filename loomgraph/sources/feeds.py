"""Sources: Atom feeds, reference lists and extraction files, from text columns or folders; malformed input gives nulls or no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import EDGE_TYPES, G, NODE_TYPES, edges, latest_papers, sql_list
from loomgraph.runtime import read, workspace

ATOM = "entry array<struct<id string, title string, summary string, published string, author array<struct<name string>>>>"


def scan_atom(feeds: DataFrame) -> DataFrame:
    """feeds(xml) -> (arxiv_id, title, abstract, authors, published): one row per entry.

    The id is what follows /abs/ up to the version; runs of white space become one space; the date is the first ten characters."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    e = feeds.select(F.explode(F.from_xml("xml", ATOM)["entry"]).alias("e"))
    return e.select(F.regexp_extract("e.id", r"/abs/([^v\s]+)", 1).alias("arxiv_id"), tidy(F.col("e.title")).alias("title"), tidy(F.col("e.summary")).alias("abstract"), F.transform("e.author", lambda a: F.trim(a["name"])).alias("authors"), F.substring("e.published", 1, 10).cast("date").alias("published"))


def scan_by_date(entries: DataFrame, since: str, until: str, most: int) -> DataFrame:
    """Entries published within the dates, newest first (then by id), `most` of them."""
    return entries.filter(F.col("published").between(F.to_date(F.lit(since)), F.to_date(F.lit(until)))).orderBy(F.desc("published"), "arxiv_id").limit(most)


def scan_references(answers: DataFrame) -> DataFrame:
    """answers(paper, body): JSON of a citation service -> (paper, cited); what can't be read or has no id gives no row."""
    schema = "data array<struct<citedPaper struct<externalIds struct<ArXiv string>>>>"
    ids = F.transform(F.from_json("body", schema)["data"], lambda x: x["citedPaper"]["externalIds"]["ArXiv"])
    return answers.select("paper", F.explode(F.filter(ids, lambda i: i.isNotNull())).alias("cited"))


def scan_citation_map(texts: DataFrame) -> DataFrame:
    """texts(body): JSON objects of paper -> list of cited ids -> (paper, cited)."""
    return texts.select(F.explode(F.from_json("body", "map<string, array<string>>")).alias("paper", "list")).select("paper", F.explode("list").alias("cited"))


def within_corpus(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """citations(paper, cited) whose cited paper is in corpus(cited)."""
    return citations.join(corpus, "cited", "left_semi")


EXTRACTION = (
    "array<struct<arxiv_id string, title string, year int, venue string, "
    "entities array<struct<name string, type string, entity_type string, description string, mathematical_structure string, bottleneck_class string>>, "
    "relations array<struct<source string, source_name string, source_type string, relation string, target string, target_name string, target_type string, confidence string, supporting_text string>>, "
    "novelty struct<classification string, confidence string, reasoning string>>>"
)


def scan_extractions(texts: DataFrame) -> dict[str, DataFrame]:
    """texts(body): JSON arrays of extraction records -> the tables papers, entities, relations and novelty.

    Keys have two names (type or entity_type, source or source_name, target or target_name). Records without an id are left
    out, as are entities without a name or of no known type, and relations of no known type or with a confidence that is no
    number; an absent confidence is 0.5 (0 for novelty). Text that is no such JSON gives no row.
    """
    x = texts.select(F.inline(F.from_json("body", EXTRACTION))).filter("arxiv_id is not null")
    papers = x.select("arxiv_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit(0)).alias("year"), "venue")
    e = x.select("arxiv_id", F.inline("entities"))
    entities = e.select("arxiv_id", "name", F.coalesce("type", "entity_type").alias("type"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("description", "mathematical_structure", "bottleneck_class"))).filter(F.col("name").isNotNull() & F.col("type").isin(NODE_TYPES))
    r = x.select("arxiv_id", F.inline("relations"))
    sure = F.col("confidence").try_cast("double")
    r = r.select("arxiv_id", F.coalesce("source", "source_name", F.lit("")).alias("source"), "source_type", "relation", F.coalesce("target", "target_name", F.lit("")).alias("target"), "target_type", F.when(F.col("confidence").isNull(), 0.5).otherwise(sure).alias("confidence"), F.coalesce("supporting_text", F.lit("")).alias("supporting_text"))
    relations = r.filter(F.col("source_type").isin(NODE_TYPES) & F.col("target_type").isin(NODE_TYPES) & F.col("relation").isin([t[0] for t in EDGE_TYPES]) & F.col("confidence").isNotNull())
    novelty = x.filter("novelty is not null").select("arxiv_id", F.coalesce("novelty.classification", F.lit("")).alias("classification"), F.coalesce(F.col("novelty.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), "novelty.reasoning")
    return {"papers": papers, "entities": entities, "relations": relations, "novelty": novelty}


def q_extraction_json(spark: SparkSession, d: str) -> DataFrame:
    """The extraction records written as JSON files and loaded from there: rows and mean confidence of each table and label."""
    path = workspace(spark, "extraction")
    x = read(spark, d, "extractions").select("arxiv_id", "title", "year", "venue", "entities", "relations", "novelty")
    x.select(F.to_json(F.array(F.struct(*x.columns)))).write.text(path)
    t = scan_extractions(spark.read.text(path).withColumnRenamed("value", "body"))
    table = lambda name, label, c: t[name].groupBy(F.lit(name).alias("table_name"), label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(c), 4).alias("confidence"))
    none = F.lit(None).cast("double")
    parts = [table("papers", F.lit(""), none), table("entities", F.col("type"), none), table("relations", F.col("relation"), F.col("confidence")), table("novelty", F.col("classification"), F.col("confidence"))]
    return reduce(DataFrame.unionByName, parts)


def q_atom(spark: SparkSession, d: str) -> DataFrame:
    """Papers written as Atom feeds of one entry and scanned back: id, title, date."""
    p = latest_papers(read(spark, d, "papers")).filter("arxiv_id <> ''")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/"), esc(F.col("arxiv_id")), F.lit("v1</id><title>"), esc(F.col("title")), F.lit("</title><summary> a  b </summary><published>"), F.date_format("ingested_at", "yyyy-MM-dd"), F.lit("T00:00:00Z</published><author><name>x</name></author></entry></feed>"))
    return scan_atom(p.select(xml.alias("xml"))).select("arxiv_id", "title", "abstract", F.col("published").cast("string").alias("published"))


def q_by_date(spark: SparkSession, d: str) -> DataFrame:
    """The 50 latest entries of a year, by date."""
    return scan_by_date(q_atom(spark, d).withColumn("published", F.to_date("published")), "2024-01-01", "2024-12-31", 50).select("arxiv_id", "title", F.col("published").cast("string").alias("published"))


def q_citation_map(spark: SparkSession, d: str) -> DataFrame:
    """The corpus's citations, written as maps and scanned back."""
    c = edges(spark, d).filter("edge_type = 'CITES'").groupBy("src_id").agg(F.collect_set("dst_id").alias("l"))
    texts = c.select(F.to_json(F.map_from_arrays(F.array("src_id"), F.array("l"))).alias("body"))
    return scan_citation_map(texts)


def q_within_corpus(spark: SparkSession, d: str) -> DataFrame:
    c = edges(spark, d).filter("edge_type = 'CITES'").select(F.col("src_id").alias("paper"), F.col("dst_id").alias("cited")).distinct()
    return within_corpus(c, c.select(F.col("paper").alias("cited")).distinct())


QUERIES = {"scan_extraction_json": q_extraction_json, "scan_arxiv_by_id": q_atom, "scan_arxiv_by_date": q_by_date, "scan_citations_json": q_citation_map, "scan_citations_batch": q_within_corpus}
SQL = {
    "scan_extraction_json": f"""WITH x AS (SELECT * FROM extractions WHERE arxiv_id IS NOT NULL), e AS (SELECT unnest(entities, recursive := true) FROM x), r AS (SELECT unnest(relations, recursive := true) FROM x)
SELECT 'papers' AS table_name, '' AS label, count(*) AS n, NULL::double AS confidence FROM x HAVING count(*) > 0
UNION ALL SELECT 'entities', type, count(*), NULL FROM e WHERE name IS NOT NULL AND type IN ({sql_list(NODE_TYPES)}) GROUP BY type
UNION ALL SELECT 'relations', relation, count(*), round(sum(coalesce(confidence, 0.5)), 4) FROM r WHERE relation IN ({sql_list([t[0] for t in EDGE_TYPES])}) AND source_type IN ({sql_list(NODE_TYPES)}) AND target_type IN ({sql_list(NODE_TYPES)}) GROUP BY relation
UNION ALL SELECT 'novelty', coalesce(novelty.classification, ''), count(*), round(sum(coalesce(novelty.confidence, 0.0)), 4) FROM x WHERE novelty IS NOT NULL GROUP BY 2""",
    "scan_arxiv_by_id": G + "SELECT regexp_extract(arxiv_id || 'v1', '^([^v\\s]+)', 1) AS arxiv_id, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS title, 'a b' AS abstract, strftime(ingested_at, '%Y-%m-%d') AS published FROM gp WHERE arxiv_id <> ''",
    "scan_arxiv_by_date": G + "SELECT regexp_extract(arxiv_id || 'v1', '^([^v\\s]+)', 1) AS arxiv_id, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS title, strftime(ingested_at, '%Y-%m-%d') AS published FROM gp WHERE arxiv_id <> '' AND year(ingested_at) = 2024 ORDER BY published DESC, arxiv_id LIMIT 50",
    "scan_citations_json": G + "SELECT DISTINCT src_id AS paper, dst_id AS cited FROM ge WHERE edge_type = 'CITES'",
    "scan_citations_batch": G + ", c AS (SELECT DISTINCT src_id AS paper, dst_id AS cited FROM ge WHERE edge_type = 'CITES') SELECT paper, cited FROM c WHERE cited IN (SELECT paper FROM c)",
}
