"""Search: BM25 in one pass over the texts, and cosine top-k for a stated query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.runtime import read

K1, B = 1.2, 0.75


def terms_of(c):
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query: list[str], k: int = 20) -> DataFrame:
    """docs(doc_id, text) -> the k best (doc_id, score) for the distinct query terms; statistics cover all documents.

    Only the query's terms are counted, in one pass over the texts; ties go to the smaller id."""
    terms = sorted({q.lower() for q in query})
    words = docs.select("doc_id", terms_of(F.coalesce("text", F.lit(""))).alias("w"))
    tf = words.select("doc_id", F.size("w").alias("len"), *[F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    row = stats.first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1.0) + (F.lit(float(row["n"])) - row[f"df{i}"] + 0.5) / (F.lit(float(row[f"df{i}"])) + 0.5))
        f = F.col(f"tf{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / (row["avg_len"] or 1.0)))
    hit = tf.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))) if terms else tf.limit(0)
    return hit.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def sql_bm25(table: str, query: list[str], k: int = 20) -> str:
    """bm25 in SQL over a table with doc_id and text."""
    terms = sorted({q.lower() for q in query})
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{i} > 0)::double AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1.0 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * {K1 + 1} / (t{i} + {K1} * ({1 - B} + {B} * l / av))" for i in range(len(terms)))
    return f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {table}), t AS (SELECT doc_id, len(w) AS l, {tf} FROM w), s AS (SELECT count(*)::double AS n, avg(l) AS av, {df} FROM t) SELECT doc_id, round({score}, 6) AS score FROM t, s WHERE {' OR '.join(f't{i} > 0' for i in range(len(terms)))} ORDER BY score DESC, doc_id LIMIT {k}"


def q_fulltext(spark: SparkSession, d: str) -> DataFrame:
    return bm25(read(spark, d, "documents"), ["gradient", "variance", "samples"])


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, q) and vectors(vec_id, embedding) -> the k nearest per query by cosine, exactly.

    The query set is stated and bounded (ids divisible by 100, or one seed): it goes to every block of vectors, which keeps its
    own k best per query before they meet."""
    pairs = vectors.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def q_vector(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return vector_top(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
QUERIES = {"fulltext_search": q_fulltext, "vector_search": q_vector}
SQL = {
    "fulltext_search": sql_bm25("documents", ["gradient", "variance", "samples"]),
    "vector_search": f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10",
}
