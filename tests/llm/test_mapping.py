import pytest

from loomgraph.llm.mapping import deletions, edit_distance, map_values

TERMS = [(1, "b", "superlinear_memory_growth", "memory use rises faster than input length"), (2, "b", "vanishing_error_signal", "training signal fades in early layers"), (3, "b", "over_smoothing_of_node_features", "graph vertices become indistinguishable with depth"), (4, "r", "USES", "employs as a component"), (5, "r", "HAS_LIMITATION", "suffers from the weakness"), (6, "r", "CITES", None)]
WANT = {
    ("b", "Superlinear Memory Growth"): 1, ("b", "superliner memroy growth"): 1, ("b", "SUPERLINEARMEMORYGROWTH"): 1, ("b", "s.m.g."): 1, ("b", "super. mem. growth"): 1, ("b", "Memory rises faster"): 1, ("b", "signal, vanishing error"): 2, ("b", "OSNF"): 3,
    ("b", "mainly vanishing eror signal (sec. 3)"): 2, ("b", "memory of the first author"): 0, ("b", "???"): 0, ("b", "coffee"): 0, ("r", "uss"): 4, ("r", "rel:uses?"): 4, ("r", "has limitaton"): 5, ("r", "see also"): 0, ("r", "component employs"): 4, ("r", "uses" * 30): 0, ("x", "anything"): 0,
}


def test_repairs(spark):
    rows = [(f, i, v) for i, (f, v) in enumerate(WANT)] + [("r", 100, "USES"), ("r", 101, None), ("r", 102, " ​"), ("b", 103, "coffee"), (None, 104, "x")]
    values = spark.createDataFrame(rows, "field string, row_id long, value string")
    terms = spark.createDataFrame(TERMS, "term_id int, field string, term string, gloss string")
    got = {(r.field, r.value): r.term_id for r in map_values(values, terms).collect()}
    assert got == WANT
    assert map_values(values, terms).count() == len(WANT) + 1
    assert map_values(values.limit(0), terms).count() == 0


def test_parts_between_semicolons_and_long_tokens(spark):
    want = {"over smoothing; see sec. 3": 3, "see sec. 3; superlinear memory growth": 1, "coffee; tea": 0, ";;": 0, "x" * 5000 + "; vanishing eror signal": 2, "superlinearmemorygrowth" + "y" * 60: 0}
    values = spark.createDataFrame([("b", i, v) for i, v in enumerate(want)], "field string, row_id long, value string")
    terms = spark.createDataFrame(TERMS, "term_id int, field string, term string, gloss string")
    assert {r.value: r.term_id for r in map_values(values, terms).collect()} == want


@pytest.mark.parametrize("a,b,d", [("uses", "uss", 1), ("ab", "ba", 1), ("abc", "abc", 0), ("kitten", "sitting", 3), ("", "ab", 2)])
def test_edit_distance(a, b, d):
    assert edit_distance(a, b, 3) == d and edit_distance(a, b, max(0, d - 1)) == d


def test_deletions(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(deletions(F.lit("abc"), F.lit(1)), deletions(F.lit("abc"), F.lit(2)), deletions(F.lit("a"), F.lit(2))).first()
    assert set(r[0]) == {"abc", "ab", "ac", "bc"} and set(r[1]) == {"abc", "ab", "ac", "bc", "a", "b", "c"} and set(r[2]) == {"a", ""}
