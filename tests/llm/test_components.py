import random

from loomgraph.llm.components import connected_components, name_links, with_smallest


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def cases():
    rnd = random.Random(11)
    chain = [(i, i + 1) for i in range(60)]
    ring = [(100 + i, 100 + (i + 1) % 17) for i in range(17)]
    star = [(200, 201 + i) for i in range(40)] + [(201, 300), (300, 301)]
    clique = [(400 + i, 400 + j) for i in range(6) for j in range(i)]
    dense = [(500 + rnd.randrange(60), 500 + rnd.randrange(60)) for _ in range(150)]
    sparse = [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)]
    return chain + ring + star + clique + dense + sparse + [(None, 1), (5, None), (7, 7), (61, 60)] + chain[:5]


def test_against_union_find(spark):
    edges = cases()
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.vertex: r.root for r in with_smallest(connected_components(df), hot=[]).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(None, "a")], "u string, v string")).count() == 0


def test_links_by_name_as_written(spark):
    rows = [("A", "a", "T", True), ("a", None, "T", True), ("a", "b", None, True), ("b", "a", "P", True), ("c", "d", "T", False), ("c", "d", "T", None), ("c", "c", "T", True)]
    pairs = spark.createDataFrame(rows, "name_a string, name_b string, node_type string, should_merge boolean")
    got = {(r.u, r.v) for r in name_links(pairs).collect()}
    assert got == {("T\u0001A", "T\u0001a"), ("P\u0001b", "P\u0001a")}
