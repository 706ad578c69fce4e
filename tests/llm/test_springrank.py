import random

import numpy as np
import pytest

from loomgraph.llm.springrank import judgments, spring_rank


def solve(items, games, alpha):
    at = {x: i for i, x in enumerate(items)}
    m, b = np.eye(len(items)) * alpha, np.zeros(len(items))
    for x, y, won in games:
        i, j = at[x], at[y]
        m[i, i] += 1
        m[j, j] += 1
        m[i, j] -= 1
        m[j, i] -= 1
        b[i] += won
        b[j] -= won
    return dict(zip(items, np.linalg.solve(m, b)))


@pytest.mark.parametrize("hot", [[], ["i0", "i3"]])
def test_against_a_dense_solution(spark, hot):
    rnd = random.Random(4)
    items = [f"i{k}" for k in range(25)] + ["alone"]
    games = [("i0" if rnd.random() < 0.3 else f"i{rnd.randrange(25)}", f"i{rnd.randrange(25)}", rnd.choice([0, 1, 1])) for _ in range(300)]
    games = [g for g in games if g[0] != g[1]]
    got = spring_rank(spark.createDataFrame([(i,) for i in items + items[:2] + [None]], "id string"), spark.createDataFrame(games + [("i1", "stranger", 1)], "a string, b string, won int"), tolerance=1e-8, hot=hot)
    want = solve(items, games, 1.0)
    rows = {r.id: r.strength for r in got.collect()}
    assert rows.keys() == want.keys() and rows["alone"] == 0
    assert all(rows[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_judgments(spark):
    schema = "comparison_id long, hyp_a string, hyp_b string, winner string, winner_id string, loser_id string, is_draw boolean"
    rows = [(1, "a", "b", "A", "a", "b", False), (1, "a", "b", "A", "a", "b", False), (2, "a", "b", "draw", None, None, True), (3, "a", "a", "A", "a", "a", False), (4, "a", "c", "B", "c", "a", None), (5, None, "c", "draw", None, None, None), (None, "a", "b", "B", "b", "a", False), (None, "a", "b", "B", "b", "a", False)]
    got = sorted(tuple(r) for r in judgments(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "b", 0), ("a", "b", 1), ("b", "a", 1), ("b", "a", 1), ("c", "a", 1)]


def test_nothing_compared(spark):
    got = spring_rank(spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([], "a string, b string, won int"))
    assert sorted(tuple(r) for r in got.collect()) == [("x", 0.0, 0), ("y", 0.0, 0)]


def test_no_silent_end(spark):
    games = spark.createDataFrame([(f"i{k}", f"i{k + 1}", 1) for k in range(30)], "a string, b string, won int")
    items = spark.createDataFrame([(f"i{k}",) for k in range(31)], "id string")
    with pytest.raises(RuntimeError, match="not converged"):
        spring_rank(items, games, alpha=0.001, most=2, hot=[])
