import datetime as dt
import json

from pyspark.sql import functions as F

from loomgraph.operators.display import describe, edge_color, is_known_lab, label, node_color, node_size, safe_columns
from loomgraph.plans.graph import NODE_TYPES, as_label
from loomgraph.sources.feeds import scan_extractions
from loomgraph.streaming.ingest import live_events, rate_limit, rate_limit_live, stored
from loomgraph.streaming.merge import graph_of, merge_batch
from loomgraph.streaming.store import KeyedStore

RECORD = "record_id long, arxiv_id string, title string, year int, venue string, entities array<struct<name string, type string, description string>>, relations array<struct<source string, source_type string, relation string, target string, target_type string, confidence double, supporting_text string>>, errors array<string>, extracted_at timestamp_ntz"


def test_store_keeps_the_last_and_counts_a_batch_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "kind string, key string, ord long, value string")
    path = str(tmp_path / "s")
    KeyedStore(spark, path, 4).upsert(rows(("a", "x", 2, "new"), ("a", "x", 1, "old"), ("a", None, 1, "none")), 0, mark="2024-01-02")
    KeyedStore(spark, path, 4).upsert(rows(("a", "x", 1, "late"), ("b", "y", 1, "y")), 1, mark="2024-01-01")
    KeyedStore(spark, path, 4).upsert(rows(("a", "x", 9, "sent again")), 1)
    store = KeyedStore(spark, path, 4)
    assert sorted(tuple(r) for r in store.rows().collect()) == [("a", "x", 2, "new"), ("b", "y", 1, "y")]
    assert store.mark == "2024-01-02" and store.batch == 1 and len(store.jobs) == 2


def test_a_batch_that_dies_leaves_everything(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "x", 1, "v")], "kind string, key string, ord long, value string")
    path = str(tmp_path / "s")
    KeyedStore(spark, path, 4).upsert(rows, 0, mark="m")

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr("loomgraph.streaming.store.write_text", fail)
    try:
        KeyedStore(spark, path, 4).upsert(rows.withColumn("value", F.lit("w")).withColumn("ord", F.lit(5).cast("long")), 1, mark="n")
    except OSError:
        pass
    store = KeyedStore(spark, path, 4)
    assert (store.mark, store.batch, store.rows().first().value) == ("m", 0, "v")


def test_relations_wait_for_their_ends(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    rel = [("A", "technique", "mitigates", "P", "Problem", None, "t")]
    first = [(1, "1", "one", 2020, None, [("A", "Technique.", "a"), (None, "Problem", ""), ("Z", "thing", "")], rel, ["e%d" % i for i in range(12)], day(1))]
    then = [(2, "2", "two", 2021, "v", [("P", "Problem", None)], None, None, day(3)), (3, "1", "one again", 2022, None, None, None, [None, "last"], day(2))]
    path = str(tmp_path / "s")
    merge_batch(KeyedStore(spark, path), spark.createDataFrame(first, RECORD), 0)
    assert not [r for r in graph_of(KeyedStore(spark, path)).collect() if r.kind == "relation"]
    merge_batch(KeyedStore(spark, path), spark.createDataFrame(then, RECORD), 1)
    store = KeyedStore(spark, path)
    got = {(r.kind, r.key): r.value for r in graph_of(store).collect()}
    assert set(got) == {("paper", "1"), ("paper", "2"), ("entity", "Technique:A"), ("entity", "Problem:P"), ("introduces", "1 -> Technique:A"), ("introduces", "2 -> Problem:P"), ("relation", "Technique:A -[MITIGATES]-> Problem:P")}
    assert json.loads(got[("paper", "1")])["title"] == "one again" and json.loads(got[("relation", "Technique:A -[MITIGATES]-> Problem:P")])["confidence"] == 0.5
    assert store.mark.startswith("2024-01-03") and len(store.jobs[0]["errors"]) == 10 and store.jobs[1]["errors"] == [[3, 1, "last"]]


def test_live_limits_equal_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hits = [(u, start + dt.timedelta(seconds=7 * i * (u + 1) % 100), 100 * u + i) for u in range(3) for i in range(20)]
    df = spark.createDataFrame(hits, "user_id long, ts timestamp_ntz, event_id long")
    df.write.parquet(str(tmp_path / "events.parquet"))
    live = live_events(spark, str(tmp_path), str(tmp_path / "w"), ["user_id", "ts", "event_id"]).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    got = stored(rate_limit_live(live, 4, 30.0), str(tmp_path / "w"), "append")
    want = rate_limit(df.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")), 4, 30.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_extraction_json(spark):
    body = [{"arxiv_id": "1", "entities": [{"name": "a", "entity_type": "Technique"}, {"type": "Problem"}, {"name": "b", "type": "Thing"}], "relations": [{"source_name": "a", "source_type": "Technique", "relation": "USES", "target": "b", "target_type": "Technique"}, {"source": "a", "source_type": "Technique", "relation": "LIKES", "target": "b", "target_type": "Technique"}, {"source": "a", "source_type": "Technique", "relation": "USES", "target": "b", "target_type": "Technique", "confidence": "high"}], "novelty": {"classification": "c"}}, {"title": "no id"}]
    t = scan_extractions(spark.createDataFrame([(json.dumps(body),), ("{broken",), (None,)], "body string"))
    assert [(r.name, r.type) for r in t["entities"].collect()] == [("a", "Technique")]
    assert [(r.source, r.target, r.confidence) for r in t["relations"].collect()] == [("a", "b", 0.5)]
    assert [(r.classification, r.confidence) for r in t["novelty"].collect()] == [("c", 0.0)] and t["papers"].count() == 1


def test_display(spark):
    one = spark.range(1)
    lit = F.lit
    none = lit(None).cast("string")
    row = one.select(node_color(lit("Problem")), node_color(lit("x")), edge_color(lit(0.81)), edge_color(lit(0.8)), edge_color(lit(0.5)), node_size(lit(0.1)), node_size(lit(0.9)), node_size(lit(None).cast("double")), label(lit(""), lit("t")), label(none, none)).first()
    assert tuple(row) == ("#F44336", "#999999", "#555555", "#999999", "#cccccc", 1.0, 4.5, 2.0, "t", "?")
    labs = lambda *xs: one.select(is_known_lab(F.array(*map(lit, xs)), ["mit", "deepmind"])).first()[0]
    assert labs("J. Doe (MIT)") and labs("x", "Google DeepMind") and not labs("Smith") and not labs("submit")
    path = one.select(describe(F.array(lit("A"), lit("B"), lit("C")), F.array(lit("USES"), lit("MITIGATES")), lit(0.12345))).first()[0]
    assert path == "A -[USES]-> B -[MITIGATES]-> C (score=0.1235)"
    assert safe_columns(spark.createDataFrame([], "a string, x double, embedding array<float>, l array<string>, s struct<a int>, t timestamp")) == ["a", "l"]


def test_labels_however_written(spark):
    df = spark.createDataFrame([("technique",), ("[Problem]",), ("DATA SET",), ("thing",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(as_label(F.col("t"), NODE_TYPES)).collect()] == ["Technique", "Problem", "Dataset", None, None, None]
