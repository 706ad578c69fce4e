import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scoring
from loomgraph.functions.canonical import canonical, is_blank, pair_key
from loomgraph.operators import explore, falsify, rank, resolve, search, stats
from loomgraph.runtime import cut, global_rank, hot_keys, skew_join
from loomgraph.sources import feeds
from loomgraph.streaming.ingest import ingest, rate_limit


def test_canonical_forms(spark):
    df = spark.createDataFrame([("Graph-Net ​(V2)", "graphnetv2", "…​"), (None, "STRASSE", " \t"), ("a", "Straße", "x")], "a string, b string, c string")
    got = df.select(canonical(F.col("a")), canonical(F.col("b")), is_blank(F.col("c")), pair_key(F.col("a"), F.col("b")) == pair_key(F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["graphnetv2", "", "a"] and got[1][1] == got[2][1]
    assert [r[2] for r in got] == [False, True, False] and all(r[3] for r in got)


def test_skew_join_and_ranks(spark):
    big = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, x long")
    one = spark.createDataFrame([("h", "H"), ("k3", "three")], "k string, y string")
    assert hot_keys(big, "k", share=10, floor=50) == ["h"] and hot_keys(big, "k") == []
    for how in ("inner", "left"):
        plain = sorted(map(str, big.join(one, "k", how).collect()))
        assert sorted(map(str, skew_join(big, one, "k", ["h"], how).collect())) == plain
    ranked = global_rank(big.filter("k = 'h'"), [F.col("x").desc()]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 201)) and ranked[0].x == 299
    assert global_rank(big.limit(0), [F.col("x")]).count() == 0
    assert cut(big.limit(0)).columns == ["k", "x"]


@pytest.mark.parametrize("year,want", [(2025, 1.0), (2024, 0.9), (2010, 0.3), (2030, 1.0)])
def test_recency(spark, year, want):
    assert spark.range(1).select(scoring.recency_factor(F.lit(year))).first()[0] == pytest.approx(want)


def test_scores(spark):
    p = spark.createDataFrame([("NeurIPS ", 100, 2024, "2401.000001"), (None, None, None, "9912.1"), ("unknown", 3, 2020, "x")], "venue string, citation_count int, year int, arxiv_id string").withColumn("title", F.lit("t"))
    got = scoring.enriched(p).orderBy(F.desc("score")).collect()
    assert (got[0].venue_tier, got[0].citation_signal) == (1, 0.9) and [r.venue_tier for r in got[1:]] == [6, 6]
    assert [r[0] for r in p.select(scoring.year_from_id(F.col("arxiv_id"))).collect()] == [2024, 1999, 2025]
    lab = scoring.with_venue(p, F.lit(True)).collect()
    assert sorted(r.venue_weight for r in lab) == [0.25, 0.25, 1.0]
    cohort = spark.createDataFrame([("a", "icml", 2020, 100), ("b", "ICML", 2020, 0), ("c", "icml", 2020, 50)], "title string, venue string, year int, citation_count int")
    assert {r.title: r.citation_signal for r in scoring.citation_signal_cohort(cohort).collect()} == {"a": 1.0, "b": 0.1, "c": 0.5}


def test_similarity_and_confidence(spark):
    pairs = [("flash-attention", "flash attention", 1.0), ("attention", "flashattention", 9 / 14), ("bert", "resnet", 0.0), ("x", "x", 1.0), ("", "", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double").withColumn("got", resolve.string_similarity(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.got == pytest.approx(r.want)
    c = spark.range(1).select(resolve.pair_confidence(F.lit(1.0), F.lit(True)), resolve.pair_confidence(F.lit(1.0), F.lit(False)), resolve.pair_confidence(F.lit(1.0), F.lit(True), F.lit(0.5))).first()
    assert [round(x, 4) for x in c] == [1.0, 0.7778, 0.85]


def test_blocking_is_complete(spark):
    import random

    rnd = random.Random(2)
    names = sorted({" ".join(rnd.choice(["deep", "graph", "net", "sparse", "attention", "mini", "netto"]) for _ in range(rnd.randint(1, 4))) for _ in range(60)} | {"attention", "attentions", "graphnet"})
    df = spark.createDataFrame([(n, "T", n, False) for n in names], "id string, node_type string, norm string, norm_known boolean")
    got = {(r.a, r.b) for r in resolve.block_by_token(df).collect()}

    def sim(a, b):
        x, y = set(a.split()), set(b.split())
        inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0
        return max(len(x & y) / len(x | y), inside)

    assert got == {(a, b) for a in names for b in names if a < b and sim(a, b) >= resolve.BLOCK}


def test_elo_conserves_points(spark):
    m = [(1, i, f"p{i % 4}", f"p{(i * 3 + 1) % 4}", [1.0, 0.0, 0.5][i % 3]) for i in range(40) if i % 4 != (i * 3 + 1) % 4]
    df = spark.createDataFrame(m + [(2, 0, "x", "y", 1.0)], "tournament int, ord int, a string, b string, score_a double")
    got = rank.elo_tournament(df).collect()
    one = [r for r in got if r.tournament == 1]
    assert sum(r.rating for r in one) == pytest.approx(1500 * len(one)) and sum(r.wins for r in one) == sum(r.losses for r in one)
    assert {(r.item, r.rating) for r in got if r.tournament == 2} == {("x", 1516.0), ("y", 1484.0)}


def test_rate_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    hits = [(1, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 61, 62, 200])] + [(2, t0, 10)]
    df = spark.createDataFrame(hits, "key long, ts timestamp_ntz, id long")
    got = {(r.key, r.id): r.allowed for r in rate_limit(df, most=2).collect()}
    assert [got[(1, i)] for i in range(6)] == [True, True, False, True, True, True] and got[(2, 10)]


def test_bm25_and_cosine(spark):
    docs = spark.createDataFrame([(1, "gradient gradient noise"), (2, "gradient"), (3, None), (4, "noise")], "doc_id long, text string")
    got = [r.doc_id for r in search.bm25(docs, ["Gradient", "gradient"]).collect()]
    assert set(got) == {1, 2} and search.bm25(docs, ["absent"]).count() == 0
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    top = search.vector_top(v, v.filter("vec_id = 0").selectExpr("vec_id as query_id", "embedding as q"), 1).collect()
    assert [r.vec_id for r in top] == [1]


def test_sources(spark):
    xml = "<feed><entry><id>http://x/abs/2401.00001v2</id><title>A\n  b</title><summary> s </summary><published>2024-01-05T00:00:00Z</published><author><name> N </name></author></entry></feed>"
    r = feeds.scan_atom(spark.createDataFrame([(xml,), ("<feed></feed>",)], "xml string")).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].title, r[0].abstract, r[0].authors, str(r[0].published)) == ("2401.00001", "A b", "s", ["N"], "2024-01-05")
    body = json.dumps({"data": [{"citedPaper": {"externalIds": {"ArXiv": "1"}}}, {"citedPaper": {"externalIds": None}}, {"citedPaper": None}]})
    got = feeds.scan_references(spark.createDataFrame([("p", body), ("q", "not json"), ("r", None)], "paper string, body string"))
    assert [tuple(x) for x in got.collect()] == [("p", "1")]


def test_relation_checks(spark):
    rel = "array<struct<source string, source_type string, relation string, target string, target_type string, confidence double, supporting_text string>>"
    ent = "array<struct<name string, type string, description string, mathematical_structure string, bottleneck_class string>>"
    rows = [(1, [("a", "Paper", "INTRODUCES", "b", "technique", 0.5, ""), ("a", "Technique", "USES", "a", "Technique", 0.5, ""), ("p", "Problem", "MITIGATES", "t", "Technique", 0.5, ""), ("t", "Technique", "IMPROVES_OVER", "Prior Work", "Technique", 0.5, ""), ("t", "Thing", "LIKES", "u", "Technique", 0.5, "")], [("d", "Dataset", None, None, None), ("synthetic set", "Dataset", "", "", ""), ("t", "Technique", "", "N/A", None)]), (2, None, None), (3, [], [])]
    df = spark.createDataFrame(rows, f"record_id long, relations {rel}, entities {ent}")
    assert [r.drop_reason for r in stats.relation_clean(df).collect()].count(None) == 1
    got = {r.record_id: (r.no_structure, r.generic_datasets, r.reversed, r.passed) for r in stats.schema_conformance(df).collect()}
    assert got == {1: (1, 1, 1, False), 2: (0, 0, 0, True), 3: (0, 0, 0, True)}


def test_falsification(spark):
    e = spark.createDataFrame([("A", "HAS_LIMITATION", "P", 0.9), ("B", "MITIGATES", "P", 0.8), ("C", "MITIGATES", "P", 0.5), ("C", "USES", "ghost", 0.5), ("D", "MITIGATES", "P", 0.7), ("D", "HAS_LIMITATION", "P", None)], "src_id string, edge_type string, dst_id string, confidence double")
    n = spark.createDataFrame([(x, x) for x in "ABCDP"], "node_id string, name string")
    paths = falsify.problem_paths(e)
    got = {r.path_id: r.failed for r in falsify.falsify(paths, e, n).collect()}
    assert got["A | P | B"] is None and got["A | P | C"] == "prerequisites" and got["A | P | D"] == "contradictions"


def test_upsert_and_stream(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, x int")
    assert {tuple(r) for r in explore.upsert_papers(old, new, "k").collect()} == {("a", 1), ("b", None), ("c", 3)}
    src = str(tmp_path / "in")
    old.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(old.schema).parquet(src)
    ingest(stream(), str(tmp_path), "k", ["x"])
    new.coalesce(1).write.mode("append").parquet(src)
    got = ingest(stream(), str(tmp_path), "k", ["x"]).rows().select("key", F.get_json_object("value", "$.x").cast("int"))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", None), ("c", 3)}
