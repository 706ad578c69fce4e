from pyspark.sql import functions as F

from loomgraph.llm.ledger import CanonicalLedger, duplicates, entity_keys, in_batches


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, name string, type string, key string")


ROWS = [(5, "Graph Net", "Technique", "x"), (2, "technique.", "GRAPH-NET", "x"), (9, "graph​net", "technique", None), (1, "Other", None, "x"), (7, "other", "", "y"), (8, None, "Technique", "y"), (4, " ​", "Technique", "y"), (3, "...", "T", ""), (6, "!?", "t", ""), (9, "graph​net", "technique", None)]


def test_batches_give_what_one_pass_gives(spark, tmp_path):
    rows = entity_keys(entities(spark, ROWS))
    for n in (1, 3):
        ledger = in_batches(rows, CanonicalLedger(spark, str(tmp_path / f"l{n}"), 4), n)
        got = sorted(tuple(r) for r in duplicates(rows, ledger).collect())
        assert got == [(1, 7), (2, 5), (2, 9), (2, 9), (3, 6)]
        assert {r.keep_id: r.copies for r in ledger.rows().collect()} == {2: 4, 1: 2, 3: 2}
        again = CanonicalLedger.open(spark, str(tmp_path / f"l{n}"), 4)
        assert again.version == n and again.rows().count() == 3
        hot = sorted(tuple(r) for r in duplicates(rows, again, share=2, floor=3).collect())
        assert hot == got


def test_untouched_buckets_keep_their_version(spark, tmp_path):
    ledger = CanonicalLedger(spark, str(tmp_path / "l"), 16)
    ledger.update(spark.range(40).select(F.col("id").cast("string").alias("key"), "id"))
    before = dict(ledger.at)
    ledger.update(spark.createDataFrame([("1", 100)], "key string, id long"))
    assert sum(ledger.at[b] != before[b] for b in before) == 1
    assert ledger.rows().filter("copies = 2").first().keep_id == 1


def test_empty(spark, tmp_path):
    rows = entity_keys(entities(spark, []))
    ledger = in_batches(rows, CanonicalLedger(spark, str(tmp_path / "l")), 3)
    assert duplicates(rows, ledger).count() == 0
