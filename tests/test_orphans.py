import datetime as dt
import random

from pyspark.sql import functions as F

from loomgraph.operators import orphans
from loomgraph.operators.orphans import find_orphans, known_parents, relation_ends


def t(day):
    return None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def brute(refs, parents):
    out = set()
    for kind, key, at, ref in refs:
        mine = [(f, e) for k, x, f, e in parents if (k, x) == (kind, key)]
        when = dt.datetime.max if at is None else at
        begun = [p for p in mine if p[0] is not None and p[0] <= when]
        if any(e is None or e > when for _, e in begun):
            continue
        out.add((ref, kind, "missing" if not mine else "late" if not begun else "deleted"))
    return out


def frames(spark, refs, parents):
    r = spark.createDataFrame(refs, "kind string, key string, at timestamp_ntz, ref long")
    p = spark.createDataFrame(parents, "kind string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    return r, p


def test_against_brute_force_however_partitions_fall(spark):
    rnd = random.Random(5)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)]
    parents = [("e", rnd.choice(keys[3:]), t(rnd.randrange(60)), rnd.choice([None, t(rnd.randrange(60))])) for _ in range(60)]
    parents = [p for p in parents if p[1] != "hot" or p[3] is not None] + [("e", "k3", None, None)]
    refs = [("e", rnd.choice(keys), t(rnd.choice([None, *range(70)])), i) for i in range(400)]
    for parts in (None, 1, 7, 40):
        got = {(r.ref, r.kind, r.state) for r in find_orphans(*frames(spark, refs, parents), parts=parts).collect()}
        assert got == brute(refs, parents)


def test_one_key_at_one_instant_is_split(spark, monkeypatch):
    """A key that holds all rows, all at one time: it lies in several partitions, and each knows what came before."""
    parents = [("e", "hot", t(1), t(3)), ("e", "hot", t(6), None)]
    for day, state in ((0, "late"), (2, None), (3, "deleted"), (7, None)):
        refs = [("e", "hot", t(day), i) for i in range(300)]
        sizes = []
        monkeypatch.setattr(orphans, "_carried", lambda ends, f=orphans._carried: sizes.append(len(ends)) or f(ends))
        got = {(r.ref, r.state) for r in find_orphans(*frames(spark, refs, parents), parts=6).collect()}
        assert got == (set() if state is None else {(i, state) for i in range(300)}) and sizes[-1] >= 3


def test_long_keys_nulls_and_repeats(spark):
    refs = [("e", "x" * 200_000, t(1), 1), ("e", "x" * 200_000, t(1), 1), (None, "a", t(1), 2), ("e", None, t(1), 3)]
    assert sorted((r.ref, r.state) for r in find_orphans(*frames(spark, refs, [("e", None, t(0), None)])).collect()) == [(1, "missing"), (1, "missing")]


def test_empty_tables(spark):
    refs, parents = frames(spark, [], [("e", "a", t(0), None)])
    assert find_orphans(refs, parents).count() == 0
    refs, parents = frames(spark, [("e", "a", t(0), 1)], [])
    assert [r.state for r in find_orphans(refs, parents).collect()] == ["missing"]


def test_names_are_compared_as_written_unevenly(spark):
    rel = spark.createDataFrame([(1, "Graph-Net", "technique.", "  ", "Paper", t(5), "x"), (2, "problem", "Slow​ mixing", "On  GRAPHS", "[Paper]", t(5), "x")], "relation_id long, source string, source_type string, target string, target_type string, created_at timestamp_ntz, key string")
    ent = spark.createDataFrame([("GRAPHNET", "Technique", t(1), None), ("slow mixing", "Problem", t(9), None), (None, "Problem", t(0), None)], "name string, type string, extracted_at timestamp_ntz, deleted_at timestamp_ntz")
    nodes = spark.createDataFrame([], "name string, node_type string")
    papers = spark.createDataFrame([("on graphs.", t(0))], "title string, ingested_at timestamp_ntz")
    got = find_orphans(relation_ends(rel), known_parents(ent, nodes, papers)).select("ref.relation_id", "ref.side", "state")
    assert [tuple(r) for r in got.collect()] == [(2, "source", "late")]
    assert relation_ends(rel).filter(F.col("ref.relation_id") == 1).count() == 1
