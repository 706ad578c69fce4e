import pytest
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.operators import iterate
from loomgraph.operators.iterate import activation_wave, best_path_activation, ppr, random_walks, two_hop_proxy, wave_adjacency
from loomgraph.plans.graph import edge_type_dim

NODES = {"transformer": 0.95, "self_attn": 0.9, "flash_attn": 0.85, "mamba": 0.8, "lora": 0.8, "quantization": 0.7, "moe": 0.75, "dpo": 0.8, "ppo": 0.7, "quad_mem": 0.9, "slow_inf": 0.85, "finetune_cost": 0.8, "rlhf_instab": 0.75, "imagenet": 0.9, "mmlu": 0.85}
FORWARD = [
    ("transformer", "self_attn", "USES", 0.95), ("transformer", "quad_mem", "HAS_LIMITATION", 0.9), ("flash_attn", "quad_mem", "MITIGATES", 0.9),
    ("flash_attn", "self_attn", "IMPROVES_OVER", 0.85), ("mamba", "quad_mem", "MITIGATES", 0.8), ("lora", "finetune_cost", "MITIGATES", 0.85),
    ("quantization", "slow_inf", "MITIGATES", 0.8), ("moe", "slow_inf", "MITIGATES", 0.7), ("dpo", "rlhf_instab", "MITIGATES", 0.85), ("dpo", "ppo", "IMPROVES_OVER", 0.8),
]
BACK = {("flash_attn", "quad_mem"), ("mamba", "quad_mem"), ("transformer", "quad_mem"), ("quantization", "slow_inf"), ("moe", "slow_inf"), ("lora", "finetune_cost"), ("flash_attn", "self_attn"), ("dpo", "rlhf_instab")}


@pytest.fixture(scope="module")
def graph(spark):
    rows = FORWARD + [(b, a, t, c) for a, b, t, c in FORWARD if (a, b) in BACK]
    e = spark.createDataFrame(rows, "src_id string, dst_id string, edge_type string, confidence double")
    n = spark.createDataFrame(list(NODES.items()), "node_id string, significance double")
    adj = e.join(n.withColumnRenamed("node_id", "dst_id"), "dst_id").join(edge_type_dim(spark), "edge_type")
    adj = adj.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id"), "edge_type", (F.col("confidence") * F.col("significance")).alias("step")).withColumn("weight", F.col("step"))
    return e, n, adj


def seed(spark, name):
    return spark.createDataFrame([(name,)], "node_id string")


@pytest.mark.parametrize("name,mean,depths", [("transformer", 0.7007625, {1: 2, 2: 2}), ("flash_attn", 0.6964875, {1: 2, 2: 2}), ("mamba", 0.6031845, {1: 1, 2: 2, 3: 1})])
def test_best_path_goldens(spark, graph, name, mean, depths):
    got = best_path_activation(graph[2], seed(spark, name)).collect()
    assert sum(r.score for r in got) / len(got) == pytest.approx(mean, abs=1e-12)
    assert {d: sum(r.depth == d for r in got) for d in {r.depth for r in got}} == depths


@pytest.mark.parametrize("name,mean", [("transformer", 0.1939929429459029), ("mamba", 0.18885912011312236)])
def test_pagerank_goldens(spark, graph, name, mean):
    _, n, adj = graph
    got = ppr(adj.select("node_id", "other_id"), n, seed(spark, name), rounds=50).filter("score > 0").collect()
    rest = [r.score for r in got if r.node_id != name]
    assert sum(rest) / len(rest) == pytest.approx(mean, abs=1e-9)
    assert sum(r.score for r in got) == pytest.approx(1.0)


def test_two_hops_and_isolated_seed(spark, graph):
    arcs = graph[2].select("node_id", "other_id")
    got = {r.node_id: r.score for r in two_hop_proxy(arcs, seed(spark, "transformer")).collect()}
    assert got == {"self_attn": 0.8, "quad_mem": 0.8, "flash_attn": 0.5, "mamba": 0.5}
    assert best_path_activation(graph[2], seed(spark, "imagenet")).count() == 0


def test_walks_stay_below_best_paths(spark, graph):
    best = {r.node_id: r.score for r in best_path_activation(graph[2], seed(spark, "mamba")).collect()}
    once = random_walks(graph[2], seed(spark, "mamba"), walks=50).collect()
    assert once and all(r.score <= best[r.node_id] + 1e-12 and 1 <= r.depth <= 4 for r in once)
    again = random_walks(graph[2].repartition(7), seed(spark, "mamba"), walks=50).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))


def test_wave_expands_each_node_once(spark, graph):
    e, n, _ = graph
    got = activation_wave(wave_adjacency(e, n), seed(spark, "transformer"), steps=2).collect()
    first = {r.node_id: r.score for r in got if r.step == 1}
    assert first["quad_mem"] == pytest.approx(0.7 * 0.8 * 0.9 * 0.9) and set(first) == {"self_attn", "quad_mem"}
    assert all(r.step > 0 or r.node_id == "transformer" for r in got)


@pytest.fixture
def chain(spark, monkeypatch):
    """n00 - n01 - ... - n12, the seed at n00."""
    e = spark.createDataFrame([(f"n{i:02}", "USES", f"n{i + 1:02}", 1.0) for i in range(12)], "src_id string, edge_type string, dst_id string, confidence double")
    n = spark.createDataFrame([(f"n{i:02}", 1.0) for i in range(13)], "node_id string, significance double")
    monkeypatch.setattr(iterate, "_input", lambda spark, d: (e, n, seed(spark, "n00")))


def test_registered_wave_takes_all_steps(spark, chain):
    got = {r.node_id: r.step for r in registry.queries()["activation_wave"](spark, "").collect()}
    assert got == {f"n{i:02}": i for i in range(6)}
    assert {r.step for r in registry.queries()["wave_step_topk"](spark, "").collect()} <= set(range(6))
    with pytest.raises(ValueError):
        activation_wave(None, None, steps=11)


def test_registered_pagerank_takes_all_rounds(spark, chain):
    want = [1.0] + [0.0] * 12
    for _ in range(50):
        new = [0.15] + [0.0] * 12
        for i, x in enumerate(want):
            to = [j for j in (i - 1, i + 1) if 0 <= j <= 12]
            for j in to:
                new[j] += 0.85 * x / len(to)
        want = new
    got = {r.node_id: r.score for r in registry.queries()["ppr_full"](spark, "").collect()}
    assert got == pytest.approx({f"n{i:02}": x for i, x in enumerate(want)}, abs=1e-12)
