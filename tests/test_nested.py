import json

from loomgraph.operators.nested import apply_schema, decode, flatten, read_table, write_tables


def rows(spark, payloads):
    raw = spark.createDataFrame(list(enumerate(payloads)), "raw_id long, payload string")
    return [tuple(r) for r in flatten(raw.withColumn("tag", raw.raw_id)).select("raw_id", "tag", "paper_pos", "child_pos", "key_text").orderBy("raw_id", "paper_pos", "tag", "child_pos").collect()]


def test_shapes(spark):
    paper = {"arxiv_id": "1", "entities": [{"name": "a"}, {"name": None}, {}], "relations": {"source_name": "s"}, "novelty": "survey"}
    groups = {"title": "t", "entities": {"techniques": [{"name": "x"}], "problems": None, "datasets": [{"name": "y"}]}, "novelty": [{"classification": "c"}], "relations": []}
    want = [("entity", 0, 0, "a"), ("entity", 0, 1, ""), ("entity", 0, 2, ""), ("novelty", 0, 0, "survey"), ("paper", 0, 0, "1"), ("relation", 0, 0, "s")]
    for payload in (json.dumps(paper), json.dumps({"run": {"output": {"papers": [paper]}}}), json.dumps(json.dumps([paper])), "[" + json.dumps(paper, indent=2) + "]"):
        assert [r[1:] for r in rows(spark, [payload])] == want
    both = rows(spark, [json.dumps(paper) + "\n" + json.dumps(groups)])
    assert [r[1:] for r in both if r[2] == 1] == [("entity", 1, 0, "x"), ("entity", 1, 1, "y"), ("novelty", 1, 0, "c"), ("paper", 1, 1, "")]


def test_unreadable_null_and_empty(spark):
    bad = ['{"title": "a", "entities": [', "<html>", "", "  ", '{"title": NaN}', '"[{\\"title\\": 1"', '{"a":1} x', None, "[]", "{}", '{"title": null, "novelty": {}, "entities": null}']
    got = rows(spark, bad)
    assert [r[0] for r in got if r[1] == "unreadable"] == list(range(7))
    assert [r for r in got if r[1] != "unreadable"] == [(10, "paper", 0, 0, "")]


def test_very_deep_and_very_long(spark):
    deep = "[" * 400 + json.dumps({"title": "t", "entities": [{"name": "n" * 200_000}]}) + "]" * 400
    got = rows(spark, [deep, "[" * 100_000])
    assert [r[1] for r in got] == ["entity", "paper", "unreadable"] and len(got[0][4]) == 200_000


def test_tables_keep_links(spark, tmp_path):
    raw = spark.createDataFrame([(7, json.dumps([{"title": "p", "year": 2020, "entities": [{"name": "😀", "type": "T"}], "relations": [{"source": "a", "confidence": "0.5"}]}]))], "raw_id long, payload string")
    write_tables(flatten(raw), str(tmp_path / "t"))
    e = read_table(spark, str(tmp_path / "t"), "entity").first()
    p = read_table(spark, str(tmp_path / "t"), "paper").first()
    assert (e.parent_pk, e.name, p.pk, p.year) == (p.pk, "\U0001f600", "7/0", "2020")
    assert apply_schema(flatten(raw), "relation").first().confidence == "0.5"
    assert flatten(raw.limit(0)).count() == 0


def test_decode():
    assert decode('1 2 "x"') == [1, 2, "x"] and decode('{"a":1}{"b":2}') == [{"a": 1}, {"b": 2}] and decode("12x") is None


def test_strings_in_strings_however_deep(spark):
    payload = json.dumps({"title": "t", "entities": [{"name": "a"}]})
    for _ in range(12):
        payload = json.dumps(payload)
    assert [r[1:] for r in rows(spark, [payload])] == [("entity", 0, 0, "a"), ("paper", 0, 0, "")]


def test_papers_in_papers_and_children_in_strings(spark):
    inner = {"title": "B", "entities": [{"name": "b"}]}
    outer = {"title": "A", "abstract": json.dumps(inner), "related": {"more": [inner]}, "entities": json.dumps([{"name": "a"}]), "relations": [json.dumps({"source": "s"}), "plain"]}
    assert [r[1:] for r in rows(spark, [json.dumps(outer)])] == [("entity", 0, 0, "a"), ("paper", 0, 0, ""), ("relation", 0, 0, "s"), ("relation", 0, 1, "plain"), ("entity", 1, 0, "b"), ("paper", 1, 1, "")]


def test_children_without_names_and_null_groups(spark):
    paper = {"title": "t", "entities": [{"bottleneck_class": None}, {"x": None}, {"techniques": [{"mathematical_structure": None}], "problems": None}], "relations": {"all": None}, "novelty": {"reasoning": None}}
    assert [r[1:] for r in rows(spark, [json.dumps(paper)])] == [("entity", 0, 0, ""), ("entity", 0, 1, ""), ("entity", 0, 2, ""), ("novelty", 0, 0, ""), ("paper", 0, 0, "")]


def test_keys_written_twice(spark):
    payload = '{"title": "a", "title": "t", "entities": [{"name": "x"}], "entities": {"name": "y"}, "novelty": null, "novelty": {"classification": "c"}}'
    assert [r[1:] for r in rows(spark, [payload])] == [("entity", 0, 0, "x"), ("entity", 0, 1, "y"), ("novelty", 0, 0, "c"), ("paper", 0, 0, "")]
