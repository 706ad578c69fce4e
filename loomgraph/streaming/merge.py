"""Incremental merge of extraction records into the graph: papers, entities, what papers introduce, and relations.

A stream of records goes batch by batch into one keyed store. Rows carry the order of their record, so the last record wins
in whatever order files arrive. A relation stays, and counts from the batch on in which both its ends are known. The mark
(the latest time of a record) and the job's counters move with the manifest, after a batch has been stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import EDGE_TYPES, NODE_TYPES, as_label, sql_label
from loomgraph.runtime import read, workspace
from loomgraph.streaming.store import KeyedStore

#: Errors that a job keeps: the last ones.
LAST_ERRORS = 10


def parts(records: DataFrame) -> DataFrame:
    """extraction records -> (kind, key, ord, value) of all they say; items without name or of unknown type say nothing."""
    arrow = [F.col("r.st"), F.lit(":"), F.col("r.source"), F.lit(" -["), F.col("r.rel"), F.lit("]-> "), F.col("r.tt"), F.lit(":"), F.col("r.target")]
    papers = records.select(F.lit("paper").alias("kind"), F.col("arxiv_id").alias("key"), F.col("record_id").alias("ord"), F.to_json(F.struct("title", "year", "venue")).alias("value"))
    e = records.select("record_id", "arxiv_id", F.inline("entities")).select("record_id", "arxiv_id", "name", "description", as_label(F.col("type"), NODE_TYPES[1:]).alias("t")).filter("name is not null and t is not null")
    entities = e.select(F.lit("entity").alias("kind"), F.concat("t", F.lit(":"), "name").alias("key"), F.col("record_id").alias("ord"), F.coalesce("description", F.lit("")).alias("value"))
    intro = e.select(F.lit("introduces").alias("kind"), F.concat("arxiv_id", F.lit(" -> "), "t", F.lit(":"), "name").alias("key"), F.col("record_id").alias("ord"), F.lit("").alias("value"))
    r = records.select("record_id", "arxiv_id", F.inline("relations"))
    r = r.select("record_id", F.struct("source", as_label(F.col("source_type"), NODE_TYPES).alias("st"), as_label(F.col("relation"), [t[0] for t in EDGE_TYPES]).alias("rel"), "target", as_label(F.col("target_type"), NODE_TYPES).alias("tt")).alias("r"), F.struct(F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("arxiv_id").alias("source_paper"), "supporting_text").alias("v"))
    ends = F.struct(F.concat("r.st", F.lit(":"), "r.source").alias("src"), F.concat("r.tt", F.lit(":"), "r.target").alias("dst"), "v.confidence", "v.source_paper", "v.supporting_text")
    relations = r.select(F.lit("relation").alias("kind"), F.concat(*arrow).alias("key"), F.col("record_id").alias("ord"), F.to_json(ends).alias("value"))
    return papers.unionByName(entities).unionByName(intro).unionByName(relations)


def merge_batch(store: KeyedStore, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch into the store, with its mark and counters."""
    batch = batch.persist()
    said = batch.agg(F.date_format(F.max("extracted_at"), "yyyy-MM-dd HH:mm:ss").alias("mark"), F.count("*").alias("fetched"), F.count_if(F.size("entities") > 0).alias("extracted")).first()
    late = batch.select("record_id", F.posexplode("errors").alias("pos", "error")).filter("error is not null").orderBy(F.desc("record_id"), F.desc("pos")).limit(LAST_ERRORS).collect()
    job = {"batch": batch_id, "status": "completed", "fetched": said.fetched, "extracted": said.extracted, "errors": [(r.record_id, r.pos, r.error) for r in late]}
    store.upsert(parts(batch), batch_id, said.mark, job)
    batch.unpersist()


def ingest_records(source: DataFrame, path: str) -> KeyedStore:
    """Runs a stream of extraction records into the store at path until it has caught up."""
    spark = source.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(KeyedStore(spark, f"{path}/store"), batch, batch_id)

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return KeyedStore(spark, f"{path}/store")


def graph_of(store: KeyedStore) -> DataFrame:
    """(kind, key, value) of papers, entities, introductions by known papers, and relations whose both ends are known."""
    rows = store.rows().drop("ord")
    entities = rows.filter("kind = 'entity'").select("key")
    papers = rows.filter("kind = 'paper'").select("key")
    intro = rows.filter("kind = 'introduces'").withColumn("p", F.substring_index("key", " -> ", 1))
    intro = intro.join(papers.withColumnRenamed("key", "p"), "p", "left_semi").drop("p")
    rel = rows.filter("kind = 'relation'").select("*", F.get_json_object("value", "$.src").alias("src"), F.get_json_object("value", "$.dst").alias("dst"))
    rel = rel.join(entities.withColumnRenamed("key", "src"), "src", "left_semi").join(entities.withColumnRenamed("key", "dst"), "dst", "left_semi").drop("src", "dst")
    return rows.filter("kind in ('paper', 'entity')").unionByName(intro).unionByName(rel)


def streamed(spark: SparkSession, d: str, files: int = 3) -> KeyedStore:
    """extractions as a stream of files, in ranges of record_id."""
    path = workspace(spark, "merge")
    x = read(spark, d, "extractions").select("record_id", "arxiv_id", "title", "year", "venue", "entities", "relations", "errors", "extracted_at")
    x.repartitionByRange(files, "record_id").write.parquet(f"{path}/in")
    live = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return ingest_records(live, path)


def q_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every node and edge of the merged graph, with what was last said of it: title, description or confidence."""
    value = F.when(F.col("kind") == "paper", F.get_json_object("value", "$.title")).when(F.col("kind") == "relation", F.round(F.get_json_object("value", "$.confidence").cast("double"), 6).cast("string")).otherwise(F.col("value"))
    return graph_of(streamed(spark, d)).select("kind", "key", F.coalesce(value, F.lit("")).alias("value"))


def q_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The mark after all batches, and how many records they held."""
    store = streamed(spark, d)
    return spark.createDataFrame([(store.mark, sum(j["fetched"] for j in store.jobs), sum(j["extracted"] for j in store.jobs))], "last_date string, fetched long, extracted long")


def q_job_errors(spark: SparkSession, d: str) -> DataFrame:
    """The last ten errors of the job, latest first."""
    errors = sorted((tuple(e) for j in streamed(spark, d).jobs for e in j["errors"]), reverse=True)[:LAST_ERRORS]
    return spark.createDataFrame(errors, "record_id long, pos int, error string")


_RELS = [t[0] for t in EDGE_TYPES]
_SQL = f"""WITH e AS (SELECT record_id, arxiv_id, x.name AS name, x.description AS description, {sql_label('x.type', NODE_TYPES[1:])} AS t FROM (SELECT record_id, arxiv_id, unnest(entities) AS x FROM extractions) WHERE x.name IS NOT NULL),
r AS (SELECT record_id, {sql_label('x.source_type', NODE_TYPES)} || ':' || x.source AS src, {sql_label('x.relation', _RELS)} AS rel, {sql_label('x.target_type', NODE_TYPES)} || ':' || x.target AS dst, coalesce(x.confidence, 0.5) AS confidence, arxiv_id, x.supporting_text AS txt FROM (SELECT record_id, arxiv_id, unnest(relations) AS x FROM extractions)),
en AS (SELECT t || ':' || name AS key, max((record_id, coalesce(description, ''))) AS m FROM e WHERE t IS NOT NULL GROUP BY 1),
rk AS (SELECT src || ' -[' || rel || ']-> ' || dst AS key, src, dst, max((record_id, confidence)) AS m FROM r WHERE src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)
SELECT 'paper' AS kind, arxiv_id AS key, coalesce(title, '') AS value FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY record_id DESC) AS rn FROM extractions WHERE arxiv_id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT 'entity', key, m[2] FROM en
UNION ALL SELECT DISTINCT 'introduces', arxiv_id || ' -> ' || t || ':' || name, '' FROM e WHERE t IS NOT NULL AND arxiv_id IS NOT NULL
UNION ALL SELECT 'relation', key, round(m[2], 6)::varchar FROM rk WHERE src IN (SELECT key FROM en) AND dst IN (SELECT key FROM en)"""
QUERIES = {"merge_incremental": q_merge, "watermark": q_watermark, "ingestion_errors": q_job_errors}
SQL = {
    "merge_incremental": _SQL,
    "watermark": "SELECT strftime(max(extracted_at), '%Y-%m-%d %H:%M:%S') AS last_date, count(*) AS fetched, count(*) FILTER (len(entities) > 0) AS extracted FROM extractions",
    "ingestion_errors": "SELECT record_id, (pos - 1)::int AS pos, errors[pos] AS error FROM (SELECT record_id, errors, unnest(range(1, len(errors) + 1)) AS pos FROM extractions) WHERE errors[pos] IS NOT NULL ORDER BY record_id DESC, pos DESC LIMIT 10",
}
