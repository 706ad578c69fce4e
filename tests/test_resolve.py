import random
import re

import pytest

from loomgraph import registry
from loomgraph.operators import resolve as resolve_module
from loomgraph.operators.resolve import SEPARATORS, alias_dim, block_by_token, candidates, normalized, resolve


def similar(a, b):
    ta, tb = set(re.split(SEPARATORS, a)), set(re.split(SEPARATORS, b))
    inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    return max(len(ta & tb) / len(ta | tb), inside)


def test_extracted_entities_are_blocked_as_all_pairs(spark, tmp_path):
    rnd = random.Random(4)
    words = ["deep", "net", "of", "codes", "collapse", *(f"{a}{b}x" for a in "bdfg" for b in "aeio")]
    names = {" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(300)} | {"ab", "abc", "cab", "xyz", "wxyz", "deepnet", "deepnets"}
    rows = [(i, t, x) for i, x in enumerate(sorted(names)) for t in ("Technique", rnd.choice(["Problem", "Dataset"]))] + [(-1, "Problem", None), (-2, None, "ab")]
    spark.createDataFrame(rows, "entity_id long, type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([("a", "b", 0.5)], "name_a string, name_b string, confidence double").write.parquet(f"{tmp_path}/entity_pairs.parquet")
    spark.createDataFrame([("N1", "Technique", "seed only net"), ("N2", "Technique", "seed only nets")], "node_id string, node_type string, name string").write.parquet(f"{tmp_path}/nodes.parquet")
    have = {(t, x) for _, t, x in rows if t and x} | {("Technique", "seed only net"), ("Technique", "seed only nets")}
    want = {(t, a, b) for t, a in have for u, b in have if t == u and a < b and similar(a, b) >= 0.6}
    got = registry.queries()["er_block"](spark, str(tmp_path)).collect()
    assert {(r.node_type, r.a, r.b) for r in got} == want and len(got) == len(want) > 50
    assert {("Technique", "ab", "abc"), ("Technique", "ab", "cab")} <= want
    assert registry.queries()["resolve_entities"](spark, str(tmp_path)).count() == len(want)


def test_aliases_merge_and_link(spark):
    names = [("Technique", x) for x in ("Transformer", "transformer model", "Transformer Architecture ", "GRU", "Gated Recurrent Unit", "Own Net", "own net")] + [("Problem", "gru")]
    named = normalized(spark.createDataFrame(names, "node_type string, name string"), "name", alias_dim(spark), "norm")
    pairs = candidates(named)
    got = {(r.a, r.b): (r.similarity, r.decision) for r in resolve(pairs).filter("similarity = 1").collect()}
    assert got == {("Transformer", "transformer model"): (1.0, "merge"), ("Transformer", "Transformer Architecture "): (1.0, "merge"), ("GRU", "Gated Recurrent Unit"): (1.0, "merge"), ("Own Net", "own net"): (1.0, "none")}
    said = spark.createDataFrame([("transformer model", "Transformer", 0.6), ("GRU", "Gated Recurrent Unit", 0.1)], "a string, b string, score double")
    with_scores = {(r.a, r.b): r.decision for r in resolve(pairs, said).filter("similarity = 1").collect()}
    assert with_scores[("Transformer", "transformer model")] == "link" and with_scores[("GRU", "Gated Recurrent Unit")] == "none" and with_scores[("Transformer", "Transformer Architecture ")] == "merge"


@pytest.mark.parametrize("crowd", [2, 500])
def test_long_and_odd_names_are_blocked_as_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr("loomgraph.operators.resolve.CROWD", crowd)
    rnd = random.Random(9)
    words = ["deep", "slow", "mixing", "tilo", "samado", "nori", "net", "", "ab"]
    names = {" ".join(rnd.choices(words, k=rnd.choice([2, 3, 4, 5, 8, 9, 12, 16]))).strip() for _ in range(120)}
    names |= {x[: len(x) - k] for x in list(names) if len(x) > 50 for k in (1, 9)} | {"x" * n for n in (1, 2, 3, 63, 64, 65, 66, 90)} | {"y" * 64 + "z", "y" * 39, "y" * 64}
    rows = [("Technique", x) for x in sorted({x.strip() for x in names})]
    df = spark.createDataFrame(rows, "node_type string, norm string")
    want = {(a, b) for _, a in rows for _, b in rows if a < b and similar(a, b) >= 0.6}
    got = [(r.a, r.b) for r in block_by_token(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_pairs_of_names_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "Technique", "deep net of codes"), (2, "Technique", "deep net of code")], "entity_id long, type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([("deep net of code", "deep net of codes", 0.5)], "name_a string, name_b string, confidence double").write.parquet(f"{tmp_path}/entity_pairs.parquet")
    spark.createDataFrame([], "node_id string, node_type string, name string").write.parquet(f"{tmp_path}/nodes.parquet")
    for query in ("er_block", "resolve_entities", "er_duplicate_rate", "er_candidates_sorted"):
        plan = registry.queries()[query](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "similarity" in x]
    assert [r.confidence for r in registry.queries()["resolve_entities"](spark, str(tmp_path)).collect()] == [round(0.5 * (16 / 17) + 0.15, 6)]


@pytest.fixture
def tables(spark, tmp_path):
    """Names of one form, alike names, scores of some pairs (also high ones, in either order, of names that are no entities)."""
    rnd = random.Random(3)
    words = ["deep", "net", "of", "codes", "collapse", "Deep", "gru", *(f"{a}{b}x" for a in "bd" for b in "aeio")]
    names = sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(150)} | {"GRU", "Gated Recurrent Unit", "transformer model", "Transformer"})
    rows = [(i, t, x) for i, x in enumerate(names) for t in ("Technique", rnd.choice(["Problem", "Dataset"]))]
    spark.createDataFrame(rows, "entity_id long, type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    said = [(rnd.choice(names), rnd.choice([*names, "nowhere"]), rnd.choice([None, 0.2, 0.9, 1.0, 2.0])) for _ in range(4000)]
    spark.createDataFrame(said, "name_a string, name_b string, confidence double").write.parquet(f"{tmp_path}/entity_pairs.parquet")
    spark.createDataFrame([("N1", "Technique", "gru "), ("N2", "Problem", "seed only")], "node_id string, node_type string, name string").write.parquet(f"{tmp_path}/nodes.parquet")
    return str(tmp_path)


def test_duplicates_are_counted_without_the_pairs_that_cannot_be(spark, tables, monkeypatch):
    want: dict = {}
    for r in registry.queries()["resolve_entities"](spark, tables).collect():
        want.setdefault(r.node_type, []).append(r.decision)
    # a string of 1 alone
    assert spark.range(1).select(resolve_module.pair_confidence(resolve_module.F.lit(1.0), resolve_module.F.lit(False))).first()[0] < resolve_module.LINK
    monkeypatch.setattr(resolve_module, "alike_names", lambda *_: pytest.fail("all alike names are paired"))
    got = {r.node_type: (r.links, r.merges) for r in registry.queries()["er_duplicate_rate"](spark, tables).collect()}
    assert got == {t: (x.count("link"), x.count("merge")) for t, x in want.items()} and sum(map(sum, got.values())) > 9


def test_the_most_alike_pairs_are_found_first(spark, tables, monkeypatch):
    rows = sorted((-r.similarity, r.node_type, r.a, r.b) for r in registry.queries()["er_block"](spark, tables).collect())
    tried, pairs = [], resolve_module.candidates
    monkeypatch.setattr(resolve_module, "candidates", lambda names, most: tried.append(most) or pairs(names, most))
    monkeypatch.setattr(resolve_module, "NEAR", (0.95, 0.7))
    for k, least in ((3, 0.95), (sum(r[0] <= -0.75 for r in rows), 0.7), (len(rows) + 5, resolve_module.BLOCK)):
        got = resolve_module.q_candidates_sorted(spark, tables, k).collect()
        assert [(-r.similarity, r.node_type, r.a, r.b) for r in got] == rows[:k] and tried[-1] == least


def test_alike_names_carry_no_token_sets(spark):
    names = spark.createDataFrame([("Technique", "deep net of codes", "D"), ("Technique", "deep net of code", "E"), ("Technique", "net-of codes deep deep", "F")], "node_type string, norm string, id string")
    got = resolve_module.alike_names(names, 0.6)
    assert got.schema["x"].dataType.names == got.schema["y"].dataType.names == names.columns
    assert sorted((*sorted((r.x.id, r.y.id)), round(r.similarity, 6)) for r in got.collect()) == [("D", "E", round(16 / 17, 6)), ("D", "F", 1.0), ("E", "F", 0.6)]


@pytest.mark.parametrize("together", [2, 50])
def test_all_spellings_are_blocked(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(resolve_module, "SPELLINGS", together)
    spellings = ["Deep Net", "deep net", "DEEP NET ", "deep NET", "deep nets", "Deep Nets", "a b c d e f g h i", "A b c d e f g h i", "a b c d e f g h j", "A b c d e f g h j", "GRU", "gru", "gated recurrent unit"]
    rows = [(i, t, x) for i, x in enumerate(spellings) for t in ("Technique", "Problem") if t == "Technique" or i % 2]
    spark.createDataFrame(rows, "entity_id long, type string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([], "node_id string, node_type string, name string").write.parquet(f"{tmp_path}/nodes.parquet")
    norm = lambda x: {"gated recurrent unit": "gru"}.get(x.strip().lower(), x.strip().lower())
    want = {(t, a, b) for _, t, a in rows for _, u, b in rows if t == u and a < b and (norm(a) == norm(b) or similar(norm(a), norm(b)) >= 0.6)}
    got = registry.queries()["er_block"](spark, str(tmp_path)).collect()
    assert sorted((r.node_type, r.a, r.b) for r in got) == sorted(want)
    assert {r.similarity for r in got if norm(r.a) == norm(r.b)} == {1.0} and ("Technique", "Deep Net", "deep net") in want
