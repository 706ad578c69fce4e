"""What a viewer shows: labels, colours, sizes, plain properties, path texts; and the search over nodes by their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.search import bm25, sql_bm25
from loomgraph.plans.graph import G, NODE_TYPES, as_label, edges, latest_papers, linked_edges, node_id, nodes, sql_label
from loomgraph.runtime import read

# Colours by node type, of other nodes, and of edges by confidence.
NODE_COLORS = {"Paper": "#2196F3", "Technique": "#4CAF50", "Problem": "#F44336", "Dataset": "#FF9800"}
OTHER_COLOR = "#999999"
EDGE_COLORS = [(0.8, "#555555"), (0.5, "#999999")]
FAINT = "#cccccc"
#: Properties that are not shown.
HIDDEN = ("embedding", "x", "y")


def node_color(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NODE_COLORS.items() for x in kv]), kind), F.lit(OTHER_COLOR))


def edge_color(confidence: Column) -> Column:
    return F.when(confidence > EDGE_COLORS[0][0], EDGE_COLORS[0][1]).when(confidence > EDGE_COLORS[1][0], EDGE_COLORS[1][1]).otherwise(FAINT)


def node_size(significance: Column) -> Column:
    """Five times the significance, 1 at least; 2 where it is unknown."""
    return F.when(significance.isNull(), 2.0).otherwise(F.greatest(F.lit(1.0), significance * 5.0))


def label(name: Column, title: Column) -> Column:
    """The name, else the title, else '?'; empty ones are none."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(title, F.lit("")), F.lit("?"))


def safe_columns(df: DataFrame) -> list[str]:
    """Columns that can be shown: scalars and lists of scalars, without those of HIDDEN."""
    plain = lambda t: t.split("(")[0] in ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "decimal", "boolean")
    return [c for c, t in df.dtypes if c not in HIDDEN and (plain(t) or t.startswith("array<") and plain(t[6:-1]))]


def safe_props(df: DataFrame, key: str) -> DataFrame:
    """(key, prop, value): the properties of each row that can be shown and are not null, values as JSON."""
    cols = [c for c in safe_columns(df) if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("prop"), F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":|\}$', "").alias("value")) for c in cols])
    return df.select(key, F.inline(pairs)).filter("value <> '' and value <> '{}' and value <> '{'")


def is_known_lab(strings: Column, labs: list[str]) -> Column:
    """Whether any of the strings (authors or their affiliations) holds a lab as whole words, ignoring case."""
    pattern = r"\b(" + "|".join(x.lower().replace(".", r"\.") for x in labs) + r")\b"
    return F.coalesce(F.exists(strings, lambda s: F.coalesce(F.lower(s).rlike(pattern), F.lit(False))), F.lit(False))


def describe(nodes_: Column, edges_: Column, score: Column) -> Column:
    """'A -[T]-> B -[U]-> C (score=0.1234)' of names and edge types, for paths of any length."""
    steps = F.zip_with(nodes_, edges_, lambda n, t: F.when(t.isNull(), n).otherwise(F.concat(n, F.lit(" -["), t, F.lit("]-> "))))
    return F.concat(F.array_join(steps, ""), F.lit(" (score="), F.format_string("%.4f", score), F.lit(")"))


def node_texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, node_type, label, text) of all nodes with the texts they are searched by: titles and abstracts, names and the
    last description."""
    p = read(spark, d, "papers").filter("title is not null").groupBy("title").agg(F.max(F.struct("ingested_at", F.coalesce("abstract", F.lit("")).alias("abstract"))).alias("r"))
    p = p.select(node_id(F.lit("Paper"), F.col("title")).alias("doc_id"), F.lit("Paper").alias("node_type"), F.col("title").alias("label"), F.concat_ws(" ", "title", "r.abstract").alias("text"), F.col("r.abstract").alias("d"))
    e = read(spark, d, "entities").select(as_label(F.col("type"), NODE_TYPES[1:]).alias("node_type"), "name", F.struct("extracted_at", "entity_id", F.coalesce("description", F.lit("")).alias("d")).alias("r")).filter("node_type is not null and name is not null")
    e = e.groupBy("node_type", "name").agg(F.max("r").alias("r"))
    e = e.select(node_id(F.col("node_type"), F.col("name")).alias("doc_id"), "node_type", F.col("name").alias("label"), F.concat_ws(" ", "name", "r.d").alias("text"), F.col("r.d").alias("d"))
    return p.unionByName(e)


def search_nodes(texts: DataFrame, query: list[str], kind: str | None = None, limit: int = 20) -> DataFrame:
    """(doc_id, node_type, label, score, snippet): the best of each type by its own statistics, then the best of all."""
    kinds = [kind] if kind in NODE_TYPES else NODE_TYPES
    best = None
    for t in kinds:
        hits = bm25(texts.filter(F.col("node_type") == t).select("doc_id", "text"), query, limit)
        best = hits if best is None else best.unionByName(hits)
    shown = texts.select("doc_id", "node_type", label(F.col("label"), F.lit(None).cast("string")).alias("label"), F.substring("d", 1, 200).alias("snippet"))
    top = best.orderBy(F.desc("score"), "doc_id").limit(limit)
    return shown.join(F.broadcast(top), "doc_id").select("doc_id", "node_type", "label", "score", "snippet")


QUERY = ["attention", "memory", "gradient"]


def q_search(spark: SparkSession, d: str) -> DataFrame:
    return search_nodes(node_texts(spark, d), QUERY)


def q_search_type(spark: SparkSession, d: str) -> DataFrame:
    return search_nodes(node_texts(spark, d), QUERY, "Problem", 5)


def q_node_style(spark: SparkSession, d: str) -> DataFrame:
    """Colour and size of every node: papers by their significance, others by default."""
    p = latest_papers(read(spark, d, "papers")).select(node_id(F.lit("Paper"), F.col("title")).alias("node_id"), "significance")
    n = nodes(spark, d).select("node_id", "node_type").join(p, "node_id", "left")
    return n.select("node_id", node_color(F.col("node_type")).alias("color"), F.round(node_size(F.col("significance")), 6).alias("size"))


def q_edge_style(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.5))
    return edges(spark, d).select("src_id", "edge_type", "dst_id", edge_color(c).alias("color"), F.round(F.greatest(F.lit(0.5), 2.0 * c), 6).alias("size"))


def q_labels(spark: SparkSession, d: str) -> DataFrame:
    """How every paper and entity row is labelled."""
    none = F.lit(None).cast("string")
    p = read(spark, d, "papers").select(F.lit("paper").alias("kind"), label(none, F.col("title")).alias("label"))
    e = read(spark, d, "entities").select(F.lit("entity").alias("kind"), label(F.col("name"), none).alias("label"))
    return p.unionByName(e).groupBy("kind", "label").agg(F.count("*").alias("n"))


def q_safe_props(spark: SparkSession, d: str) -> DataFrame:
    """Per property of papers that can be shown, how many rows have it and its longest value."""
    p = read(spark, d, "papers").withColumn("embedding", F.array(F.lit(1.0))).withColumn("x", F.lit(1.0)).withColumn("row", F.monotonically_increasing_id())
    return safe_props(p.select("row", "arxiv_id", "abstract", "year", "venue", "citation_count", "embedding", "x"), "row").groupBy("prop").agg(F.count("*").alias("n"))


def q_known_lab(spark: SparkSession, d: str) -> DataFrame:
    """Papers with an author whose name holds one of some words, as whole words."""
    p = read(spark, d, "papers").select("arxiv_id", "title", is_known_lab(F.col("authors"), LABS).alias("known"))
    return p.filter("known").groupBy("title").agg(F.count("*").alias("n"))


#: Words that stand for labs in the registered query, as the tables name authors only.
LABS = ["mewin", "niltor marisu"]


def q_paths_text(spark: SparkSession, d: str) -> DataFrame:
    """Paths paper - technique - problem as texts, with the product of their confidences."""
    n = nodes(spark, d)
    names = lambda c: n.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name"))
    e = linked_edges(spark, d)
    a = e.filter("edge_type = 'INTRODUCES'").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.coalesce("confidence", F.lit(0.5)).alias("c1"))
    b = e.filter("edge_type = 'HAS_LIMITATION'").select(F.col("src_id").alias("b"), F.col("dst_id").alias("c"), F.coalesce("confidence", F.lit(0.5)).alias("c2"))
    j = a.join(b, "b").join(names("a"), "a").join(names("b"), "b").join(names("c"), "c")
    text = describe(F.array("a_name", "b_name", "c_name"), F.array(F.lit("INTRODUCES"), F.lit("HAS_LIMITATION")), F.col("c1") * F.col("c2"))
    return j.select(text.alias("path")).groupBy("path").agg(F.count("*").alias("n"))


_COLOR = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NODE_COLORS.items()) + f" ELSE '{OTHER_COLOR}' END"
_TEXTS = f"""tx AS (SELECT 'Paper:' || title AS doc_id, 'Paper' AS node_type, title AS label, title || ' ' || m[2] AS text, m[2] AS d FROM (SELECT title, max((ingested_at, coalesce(abstract, ''))) AS m FROM papers WHERE title IS NOT NULL GROUP BY 1)
UNION ALL SELECT t || ':' || name, t, name, name || ' ' || m[3], m[3] FROM (SELECT t, name, max((extracted_at, entity_id, coalesce(description, ''))) AS m FROM (SELECT *, {sql_label('type', NODE_TYPES[1:])} AS t FROM entities) WHERE t IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2))"""


def _search_sql(kinds: list[str], limit: int) -> str:
    per = ", ".join(f"h{i} AS ({sql_bm25(f'(SELECT * FROM tx WHERE node_type = {chr(39)}{t}{chr(39)})', QUERY, limit)})" for i, t in enumerate(kinds))
    union = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(len(kinds)))
    return f"WITH {_TEXTS}, {per}, tp AS (SELECT * FROM ({union}) ORDER BY score DESC, doc_id LIMIT {limit}) SELECT doc_id, node_type, coalesce(nullif(label, ''), '?') AS label, score, substring(d, 1, 200) AS snippet FROM tp JOIN tx USING (doc_id)"


QUERIES = {
    "fulltext_nodes": q_search,
    "fulltext_nodes_of_type": q_search_type,
    "node_style": q_node_style,
    "edge_style": q_edge_style,
    "label_coalesce": q_labels,
    "safe_props": q_safe_props,
    "is_known_lab": q_known_lab,
    "describe_any_path": q_paths_text,
}
SQL = {
    "fulltext_nodes": _search_sql(NODE_TYPES, 20),
    "fulltext_nodes_of_type": _search_sql(["Problem"], 5),
    "node_style": G + f"SELECT gn.node_id, {_COLOR} AS color, round(CASE WHEN gp.significance IS NULL THEN 2.0 ELSE greatest(1.0, gp.significance * 5.0) END::double, 6) AS size FROM gn LEFT JOIN gp ON gn.node_id = 'Paper:' || gp.title",
    "edge_style": G + "SELECT src_id, edge_type, dst_id, CASE WHEN coalesce(confidence, 0.5) > 0.8 THEN '#555555' WHEN coalesce(confidence, 0.5) > 0.5 THEN '#999999' ELSE '#cccccc' END AS color, round(greatest(0.5, 2.0 * coalesce(confidence, 0.5))::double, 6) AS size FROM ge",
    "label_coalesce": "SELECT kind, label, count(*) AS n FROM (SELECT 'paper' AS kind, coalesce(nullif(title, ''), '?') AS label FROM papers UNION ALL SELECT 'entity', coalesce(nullif(name, ''), '?') FROM entities) GROUP BY 1, 2",
    "safe_props": "SELECT prop, n FROM (SELECT count(arxiv_id) AS arxiv_id, count(abstract) AS abstract, count(year) AS year, count(venue) AS venue, count(citation_count) AS citation_count FROM papers) UNPIVOT (n FOR prop IN (arxiv_id, abstract, year, venue, citation_count)) WHERE n > 0",
    "is_known_lab": r"SELECT title, count(*) AS n FROM papers WHERE len(list_filter(authors, lambda a: regexp_matches(lower(a), '\b(mewin|niltor marisu)\b'))) > 0 GROUP BY 1",
    "describe_any_path": G + "SELECT na.name || ' -[INTRODUCES]-> ' || nb.name || ' -[HAS_LIMITATION]-> ' || nc.name || printf(' (score=%.4f)', coalesce(a.confidence, 0.5)::double * coalesce(b.confidence, 0.5)::double) AS path, count(*) AS n FROM gl a JOIN gl b ON a.dst_id = b.src_id AND a.edge_type = 'INTRODUCES' AND b.edge_type = 'HAS_LIMITATION' JOIN gn na ON na.node_id = a.src_id JOIN gn nb ON nb.node_id = a.dst_id JOIN gn nc ON nc.node_id = b.dst_id GROUP BY 1",
}
