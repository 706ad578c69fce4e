import duckdb
import pytest

from loomgraph import registry

#: A few queries of each module against their SQL; the driver compares them all.
NAMES = ["p4_found", "edge_counts", "relation_clean", "enrich_metadata", "neighborhood", "shared_papers", "resolve_entities", "activation_wave", "falsify_path", "elo_points", "vector_search", "scan_citations_batch", "event_sessions"]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    import os

    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = tables.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(repr([dict(zip(names, r))[c] for c in cols]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
