"""Registered queries against their check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from evigraph.queries import evaluation
from evigraph.sources import star
from evigraph.sources.star import TABLES

KEYS = [
    "experiment_search", "gap_matrix", "khop_neighbors", "numeric_range_filter", "graph_snapshot_edges", "tokenize", "clean_snippet", "key_sections",
    "chunk_blocks_mixed", "content_dedup", "dictionary_tagger", "best_matches", "hybrid_search", "resolve_batch", "fact_versions", "review_candidates",
    "doc_discovery", "rag_answer", "entity_match", "new_entity_timeline",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_check(spark, con, sf_dir, key):
    df = entry.queries()[key](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:2] == ["id", "name"]


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_relation_match_reads_the_edges_once(spark, sf_dir):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(evaluation.relation_counts(spark, sf_dir)) == scans(star.edges(spark, sf_dir))
