"""Consolidating pairwise matches into groups: peel the graph, solve the core, put the labels back.

Each round strips the vertices of degree one and compresses the chains of degree two by list ranking (pointer doubling along
the chain). A round that removes little has reached a core in which nearly every vertex has three or more neighbours: there
each vertex joins its first neighbour in a fixed random order, which halves the core at least in expectation and leaves new
vertices of degree one and two to peel. Rounds go on until no edge is left, on inputs of any size alike. Every removed vertex
remembers one vertex of its group that outlived it; the labels are restored in the opposite order of removal.

Vertices are (kind, name) in one string. No group is ever gathered: a hub with a third of all edges is a degree
(a pre-aggregated count), and labels reach the vertices of hot hubs and groups by broadcast of that one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import HOT_FLOOR, cut, hot_keys, read, skew_join

#: Doublings in one list ranking; longer chains go on in the next round.
DOUBLINGS = 4
#: A round of peeling that removes less than this part of the edges has reached a core.
LEAST_SHRINK = 0.25


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.filter("u <> v")
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _order(c: str):
    """A fixed random order of the vertices: expected O(log n) monotone runs, whatever the names."""
    return F.struct(F.xxhash64(c), F.col(c))


def _degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.count("*").alias("deg"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _hot(df: DataFrame, key: str, rows: int) -> list:
    """hot_keys, without looking where there are too few rows for one."""
    return hot_keys(df, key) if rows >= HOT_FLOOR else []


def _replace(arcs: DataFrame, removed: DataFrame, rows: int) -> DataFrame:
    """Arcs whose ends were removed point to the vertex that stands for them: removed(u, to)."""
    r = removed.select(F.col("u").alias("v"), F.col("to"))
    hot = _hot(arcs, "u", rows)  # the arcs go both ways, so v has the same hot keys
    moved = skew_join(arcs, r, "v", hot, "left").select("u", F.coalesce("to", "v").alias("v"))
    moved = skew_join(moved, removed.select("u", "to"), "u", hot, "left").select(F.coalesce("to", "u").alias("u"), "v")
    return both_ways(moved)


def strip_leaves(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs without vertices of degree one, removed(u, to)). Of an edge by itself the larger end is removed."""
    deg = _degrees(arcs)
    leaf = deg.filter("deg = 1").select("u", F.col("lo").alias("to"))
    mutual = leaf.alias("a").join(leaf.alias("b"), (F.col("a.to") == F.col("b.u")) & (F.col("b.to") == F.col("a.u")) & (F.col("a.u") < F.col("b.u"))).select(F.col("a.u").alias("u"))
    removed = cut(leaf.join(mutual, "u", "left_anti"))
    # a removed vertex has one arc each way: the arcs go by pairs, without a join on the other end
    lost = removed.select("u", F.col("to").alias("v"))
    lost = lost.unionByName(lost.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return cut(arcs.join(lost, ["u", "v"], "left_anti")), removed


def compress_chains(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of degree two that lie inside a chain give way to one edge between the chain's ends.

    A chain ends at any other vertex and at vertices that come before both their neighbours in a fixed random order; so
    closed rings end too. Each inner vertex holds a pointer in either direction; pointers double until they reach an end.
    """
    inner = _degrees(arcs).filter("deg = 2").select("u", "lo", "hi")
    inner = cut(inner.filter(~((_order("u") < _order("lo")) & (_order("u") < _order("hi")))))
    # one pointer per direction: at u, coming from `back`, the chain goes on to `to`
    ptr = inner.select("u", F.col("lo").alias("back"), F.col("hi").alias("to")).unionByName(inner.select("u", F.col("hi").alias("back"), F.col("lo").alias("to")))
    hop = ptr.select("u", "back", F.col("u").alias("last"), "to")
    for i in range(DOUBLINGS):
        nxt = hop.select(F.col("u").alias("to"), F.col("back").alias("last"), F.col("last").alias("last2"), F.col("to").alias("to2"))
        hop = hop.join(nxt, ["to", "last"], "left").select("u", "back", F.coalesce("last2", "last").alias("last"), F.coalesce("to2", "to").alias("to"))
        hop = cut(hop) if i % 2 else hop
    ended = hop.join(inner.select(F.col("u").alias("to")), "to", "left_anti")
    whole = ended.groupBy("u").agg(F.count("*").alias("n"), F.min("to").alias("a"), F.max("to").alias("b")).filter("n = 2")
    removed = cut(whole.select("u", F.col("a").alias("to"), "b").join(inner, "u"))
    lost = removed.select("u", F.explode(F.array("lo", "hi")).alias("v"))
    lost = lost.unionByName(lost.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    left = arcs.join(lost, ["u", "v"], "left_anti")
    spans = removed.select(F.col("to").alias("u"), F.col("b").alias("v"))
    return cut(left.unionByName(both_ways(spans)).distinct()), removed.select("u", "to")


def contract(arcs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each vertex joins its first neighbour in the fixed order, if that comes before it; trees become single vertices."""
    best = arcs.groupBy("u").agg(F.min(_order("v")).alias("m")).select("u", F.when(F.col("m") < _order("u"), F.col("m")["v"]).alias("to"))
    best = cut(best.filter("to is not null"))
    while True:
        up = best.select(F.col("u").alias("to"), F.col("to").alias("top"))
        nxt = cut(skew_join(best, up, "to", _hot(best, "to", rows), "left").select("u", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")))
        best = nxt.select("u", "to")
        if nxt.filter("moved").limit(1).count() == 0:
            break
    return cut(_replace(arcs, best, rows)), best


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any comparable type -> (vertex, label): label is one vertex of the group, the same for all of it.

    Loops, repeats and direction do not matter; an edge with a null end says nothing; no edges, no rows.
    """
    arcs = cut(both_ways(edges.filter("u is not null and v is not null")))
    nothing, stages, n = arcs.limit(0), [], arcs.count()
    while n:
        before = n
        for peel in (strip_leaves, compress_chains):
            arcs, removed = peel(arcs)
            stages.append((removed, before))
        n = arcs.count()
        if n > (1 - LEAST_SHRINK) * before:
            arcs, removed = contract(arcs, n)
            stages.append((removed, n))
            n = arcs.count()
    if not stages:
        return nothing.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    # the last vertex of a group is one that others gave way to and that never gave way
    gone = cut(reduce(DataFrame.unionByName, [removed.select("u", "to") for removed, _ in stages]))
    labels = gone.select(F.col("to").alias("vertex")).distinct().join(gone.select(F.col("u").alias("vertex")), "vertex", "left_anti").withColumn("label", F.col("vertex"))
    labels = cut(labels)
    for removed, rows in reversed(stages):
        back = skew_join(removed, labels.select(F.col("vertex").alias("to"), "label"), "to", _hot(removed, "to", rows))
        labels = labels.unionByName(cut(back.select(F.col("u").alias("vertex"), "label")))
    return labels


def with_smallest(labels: DataFrame, hot: list | None = None) -> DataFrame:
    """(vertex, label) -> (vertex, root): the group's smallest vertex."""
    roots = labels.groupBy("label").agg(F.min("vertex").alias("root"))
    return skew_join(labels, roots, "label", hot_keys(labels, "label") if hot is None else hot).select("vertex", "root")


def name_links(pairs: DataFrame) -> DataFrame:
    """entity_pairs -> edges(u, v) between names of one node_type that some row says should merge; nulls link nothing."""
    def at(c: str):
        return F.concat(F.col("node_type"), F.lit("\u0001"), F.col(c))

    return pairs.filter("should_merge and node_type is not null and name_a is not null and name_b is not null and name_a <> name_b").select(at("name_a").alias("u"), at("name_b").alias("v"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(node_type, root_name, member_name): one row per name that is not its group's smallest (in byte order)."""
    groups = with_smallest(connected_components(name_links(read(spark, d, "entity_pairs")))).filter("vertex <> root")
    split = F.split("vertex", "\u0001", 2)
    return groups.select(split[0].alias("node_type"), F.split("root", "\u0001", 2)[1].alias("root_name"), split[1].alias("member_name"))


QUERIES = {"p3_found": p3_found}
SQL = {
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT node_type, name_a AS u, name_b AS v FROM entity_pairs WHERE should_merge AND name_a <> name_b AND node_type IS NOT NULL
  UNION SELECT DISTINCT node_type, name_b, name_a FROM entity_pairs WHERE should_merge AND name_a <> name_b AND node_type IS NOT NULL),
reach AS (SELECT node_type, u, v FROM e UNION SELECT r.node_type, r.u, e.v FROM reach r JOIN e ON r.node_type = e.node_type AND r.v = e.u),
roots AS (SELECT node_type, u AS member_name, least(u, min(v)) AS root_name FROM reach GROUP BY 1, 2)
SELECT node_type, root_name, member_name FROM roots WHERE root_name <> member_name"""
}
