"""Registered queries on a few own rows of the star tables: the whole job must come out."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from evigraph.plans import structured_search as S
from evigraph.sources.star import TABLES, edges, node_names

ROWS = {
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "FRANCE", 3), (1, "PERU", 1)]),
    "customer": ("c_custkey long, c_name string, c_mktsegment string, c_nationkey long", [(1, "Customer#1", "BUILDING", 0), (2, "Customer#2", "MACHINERY", 1)]),
    "supplier": ("s_suppkey long, s_name string", [(1, "Supplier#1")]),
    "part": ("p_partkey long, p_name string, p_type string, p_size long", [(1, "red ring", "STEEL", 1), (2, "blue bolt", "TIN", 2)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_totalprice double",
        [(1, 1, "1997-01-01", "1-URGENT", 10.0), (2, 2, "1998-01-01", "5-LOW", 20.0)],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string",
        [(1, 1, 1, 1, 5.0, 0.1, "A", "F"), (1, 2, 1, 2, 5.0, 0.1, "A", "F"), (2, 1, 1, 1, 5.0, 0.0, "N", "O")],
    ),
    "documents": (
        "doc_id long, text string, lang string, source string, n_chars long",
        [(1, "Supplier#1 told FRANCE of a red ring and of copper leaching tests", "en", "web", 64), (2, "Nothing of note", "en", "web", 15)],
    ),
    "labels": ("doc_id long, quality long, toxic long", [(1, 1, 0)]),
    "benchmark": ("item_id long, text string", [(0, "red ring and copper leaching tests. FRANCE told Supplier"), (1, "zzz qqq"), (4, "Patent of tests")]),
}


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def checked(d, key):
    con = duckdb.connect()
    for t in TABLES:
        if t in ROWS:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    return sorted((dict(zip(names, r, strict=True)) for r in cur.fetchall()), key=repr)


def test_highlighted_are_nodes_of_every_type_but_publications(spark, tiny):
    rows = entry.queries()["highlight_entities"](spark, tiny).collect()
    got = {(r.id, r.mentions) for r in rows}
    assert {("eq_1", 1), ("fac_0", 1), ("fac_1", 0), ("expert_1", 0), ("exp_1", 0), ("mat_1", 1)} <= got
    assert not any(r.type == "publication" for r in rows)
    assert sorted((r.asDict() for r in rows), key=repr) == checked(tiny, "highlight_entities")


def test_induced_subgraph_holds_its_edges(spark, tiny):
    rows = entry.queries()["induced_subgraph"](spark, tiny).collect()
    assert {(r.id, r.degree) for r in rows if r.id is not None} == {("exp_1", 11), ("fac_0", 1)}
    assert [(r.source, r.target, r.type) for r in rows if r.id is None] == [("exp_1", "fac_0", "AT_FACILITY")]
    assert sorted((r.asDict() for r in rows), key=repr) == checked(tiny, "induced_subgraph")


def test_exported_answers_have_chains_and_external_sources(spark, tiny):
    rows = {r.qset_id: r for r in entry.queries()["answers_export"](spark, tiny).collect()}
    assert set(rows) == {0, 1, 4}
    found = json.loads(rows[0].json)
    assert [c["doc_id"] for c in found["citations"]] == [1] and found["query_expansions"] == ["red ring and copper leaching tests"]
    (chain,) = found["experiment_chains"]
    assert (chain["experiment_id"], chain["publication"]) == ("exp_1", {"id": "pub_1", "name": "Document 1"})
    assert [[i["id"] for i in s["items"]] for s in chain["steps"]] == [["mat_1", "mat_2"], ["proc_STEEL", "proc_TIN"], ["eq_1"], ["prop_AF", "concl_1"]]
    external = found["external_sources"]
    assert [len(external["scholar"]), len(external["patents"])] == [2, 1] and "leaching" in external["keywords"] and "message" not in external
    text = rows[0].markdown
    assert "- **Document 1 · Order 1:** red ring, blue bolt → STEEL, TIN → Supplier#1 → flag AF, Supplier#1 told FRANCE" in text
    assert text.index("## Ответ") < text.index("1. **Document 1**") < text.index("S1. **red ring") < text.index("S2. **Patent of tests**") < text.index("P1. **zzz qqq**")
    empty = json.loads(rows[1].json)
    assert empty["experiment_chains"] == [] == empty["external_sources"]["scholar"] and "не найдены" in empty["external_sources"]["message"]
    assert "### Внешние источники" in rows[1].markdown


def test_answer_lines_derive_only_the_edges_they_name(spark, tiny):
    n = node_names(spark, tiny)
    lines = S.experiment_lines(n, edges(spark, tiny), n.filter("type = 'experiment'"))
    got = {r.experiment_id: r.line for r in lines.collect()}
    assert "Материал: red ring, blue bolt;" in got["exp_1"] and "Источник: Document 1. Команда: BUILDING." in got["exp_1"]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "MEASURES_PROPERTY" not in plan and "VALIDATED_BY" not in plan


def test_dictionary_tagger_does_not_read_order_lines_for_a_discount(spark, tiny):
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in read(entry.queries()["dictionary_tagger"](spark, tiny))
    got = sorted((r.asDict() for r in entry.queries()["dictionary_tagger"](spark, tiny).collect()), key=repr)
    assert got == checked(tiny, "dictionary_tagger")
