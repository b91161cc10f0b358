"""The planted-case graph: expected answers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.model import EDGES_SCHEMA
from evigraph.operators import curation as C
from evigraph.operators import graph as G
from evigraph.plans import structured_search as S
from evigraph.sources import nodelink, star

import datetime

EXPERIMENTS = [
    ("e1", "m1", "p1", "c2", 2.5, "RU", "k1"), ("e2", "m1", "p1", None, 4.0, "INTL", "k2"), ("e3", "m2", "p1", None, None, "RU", "k3"),
    ("e4", "m2", "p2", "c2", None, "RU", "k4"), ("e5", "m2", "p1", None, None, "INTL", "k5"),
]
NAMES = {"m1": ("material", "nickel matte"), "m2": ("material", "copper matte"), "m3": ("material", "oxide ore"), "p1": ("process", "smelting"),
         "p2": ("process", "heap leaching"), "c1": ("condition", "cold climate"), "c2": ("condition", "temperate climate")}


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(e, "experiment", f"experiment {e}", "2020-01-01", country, {} if flow is None else {"flow_m3_h": flow}) for e, _, _, _, flow, country, _ in EXPERIMENTS]
    nodes += [(i, t, n, None, None, {}) for i, (t, n) in NAMES.items()]
    nodes += [(k, "conclusion", f"recovery of {m} by {p} rises with flow, case {e}", None, None, {}) for e, m, p, _, _, _, k in EXPERIMENTS]
    links = []
    for e, m, p, c, _, _, k in EXPERIMENTS:
        links += [(e, m, "USES_MATERIAL"), (e, p, "USES_PROCESS"), (e, k, "PRODUCES_CONCLUSION")]
        links += [(e, c, "AT_CONDITION")] if c else []
    links.append(("k1", "k2", "CONTRADICTS"))
    return (
        spark.createDataFrame(nodes, "id string, type string, name string, date string, country string, attrs_num map<string,double>"),
        spark.createDataFrame([(*x, {}) for x in links], EDGES_SCHEMA),
    )


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_counts_and_degree(graph):
    n, e = graph
    assert G.graph_counts(n, e).first().asDict() == {"nodes": 17, "edges": 18}
    deg = {r.id: r.degree for r in G.node_degree(n, e).collect()}
    assert (deg["p1"], deg["m1"], deg["c2"], deg["k1"], deg["m3"]) == (4, 2, 2, 2, 0)


def test_gap_matrix(graph):
    cells = {(r.x_id, r.y_id): r["count"] for r in G.gap_matrix(*graph).collect()}
    assert len(cells) == 6 and {k for k, v in cells.items() if v} == {("m1", "c2"), ("m2", "c2")}
    gaps = G.gaps_only(*graph)
    assert gaps.count() == 4 and G.ghost_links(gaps).count() == 8
    with pytest.raises(ValueError):
        G.gap_matrix(*graph, "material", "regime")


def test_search(graph):
    n, e = graph
    assert ids(G.experiment_search(n, e, {"material": "Matte"})) == ["e1", "e2", "e3", "e4", "e5"]
    assert ids(G.experiment_search(n, e, {"material": "matte"}, numeric_filters=[("flow_m3_h", "<=", 3)])) == ["e1"]
    assert ids(G.experiment_search(n, e, {"material": "matte"}, numeric_filters=[("flow_m3_h", "~", 3)])) == []
    assert ids(G.experiment_search(n, e, {"material": ["nickel", "copper matte"], "condition": "the temperate climate zone"})) == ["e1", "e4"]
    assert ids(G.experiment_search(n, e, country="ru")) == ["e1", "e3", "e4"]


def test_khop_is_symmetric(spark, graph):
    n, e = graph
    seeds = n.select(F.col("id").alias("seed_id"))
    near = {(r.seed_id, r.node_id): r.hop for r in G.khop_neighbors(n, e, seeds, 2).collect()}
    assert sorted(t for s, t in near if s == "c2" and near[s, t] <= 1) == ["c2", "e1", "e4"]
    assert len([t for s, t in near if s == "c2"]) == 9
    assert all(near[t, s] == h for (s, t), h in near.items())
    assert G.khop_neighbors(n, e, spark.createDataFrame([("zz",)], "seed_id string"), 1).count() == 0


def test_contradictions_chains_review(spark, graph):
    n, e = graph
    assert [(r.a_id, r.b_id) for r in G.contradictions(n, e, spark.createDataFrame([("k2",)], "id string")).collect()] == [("k1", "k2")]
    assert G.chain_step_edges(n, e).count() == 8
    assert [(r.a_id, r.b_id) for r in C.review_candidates(n, e).collect()] == [("k3", "k5")]
    flagged = C.needs_review_pairs(n, e, (0.2, 0.99)).collect()
    assert [(r.source, r.target) for r in flagged] == [("k3", "k5")] and 0.2 <= flagged[0].similarity <= 0.99


def test_structured_questions(spark, graph):
    n, e = graph
    q = spark.createDataFrame([(1, "what about nickel matte"), (2, "nothing here"), (3, "heap leaching of oxide ore"), (4, "copper matte and smelting, foreign works"), (5, "foreign works only"), (6, "flow <= 3"), (7, "flow 2-5")], "question_id long, text string")
    parts = S.hybrid_search(n, e, q, S.SearchSettings(datetime.date(2026, 1, 1), synonyms={"zz": "yy"}, attr_terms=(("flow", "flow_m3_h"),)))
    got = {}
    for r in parts["matched"].collect():
        got.setdefault(r.question_id, []).append(r.experiment_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["e1", "e2"], 4: ["e5"], 5: ["e2", "e5"], 6: ["e1"], 7: ["e1", "e2"]}
    gaps = {r.question_id: r.gap for r in parts["gaps"].collect()}
    assert gaps == {2: None, 3: "материал=oxide ore, процесс=heap leaching"}
    lines = [r.line for r in parts["lines"].filter("question_id = 1").orderBy("part", "key").collect()]
    assert len(lines) == 4 and lines[0].startswith("[e1] (RU, достоверность: ?) Материал: nickel matte; Процесс: smelting") and lines[2].startswith("⚠")


def test_node_link_round_trip(spark, graph, tmp_path):
    doc = {
        "directed": True, "multigraph": True, "graph": {},
        "nodes": [{"id": "e1", "type": "experiment", "name": "E", "date": "2020", "flow_m3_h": 2.5, "effect": "up", "sources": ["a", "b"]}, {"id": "m1", "type": "material", "name": "M"}],
        "links": [{"source": "e1", "target": "m1", "key": "USES_MATERIAL", "type": "USES_MATERIAL", "note": "x"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    n, e = nodelink.load_node_link(spark, str(tmp_path / "g.json"))
    row = {r.id: r for r in n.collect()}["e1"]
    assert row.attrs_num == {"flow_m3_h": 2.5} and row.attrs_str == {"effect": "up"} and row.sources == ["a", "b"]
    assert e.first().attrs_str == {"note": "x"}
    nodelink.save_graph(n, e, str(tmp_path / "stored"))
    n2, e2 = nodelink.load_graph(spark, str(tmp_path / "stored"))
    assert ids(n2) == ["e1", "m1"] and e2.count() == 1


def test_snapshot_keeps_uploads_on_disk(spark, graph, tmp_path):
    n, e = graph
    serving = spark.createDataFrame([("u1", "publication", "U", True), ("old", "topic", "O", False)], "id string, type string, name string, has_chunks boolean")
    nodes, kept = nodelink.graph_snapshot(n.select("id", "type", "name"), e.select("source", "target", "type"), serving)
    assert nodes.count() == 18 and kept.count() == 18
    nodelink.write_snapshot(nodes, kept, str(tmp_path / "s"))
    again, edges2 = nodelink.graph_snapshot(n.filter("type <> 'conclusion'").select("id", "type", "name"), e.select("source", "target", "type"), serving.limit(0))
    nodelink.write_snapshot(again, edges2, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "nodes")).filter("origin = 'upload'").count() == 1
    assert spark.read.parquet(str(tmp_path / "s" / "nodes")).count() == 13


def test_gap_cells_over_blocks_equal_the_grid(spark, monkeypatch):
    monkeypatch.setattr(G, "AXIS_BLOCK", 2)
    rows = [(f"m{i}", "material", f"M{i}") for i in range(5)] + [(f"c{i}", "condition", f"C{i}") for i in range(7)] + [(f"e{i}", "experiment", "E") for i in range(6)]
    links = [(f"e{i}", f"m{i % 4}", "USES_MATERIAL") for i in range(6)] + [(f"e{i}", f"c{i * j % 6}", "AT_CONDITION") for i in range(6) for j in (1, 2)]
    links = sorted(set(links)) + [("e1", None, "AT_CONDITION"), ("other", "m1", "USES_MATERIAL")]
    n = spark.createDataFrame(rows, "id string, type string, name string")
    e = spark.createDataFrame(links, "source string, target string, type string")
    want = {}
    for i in range(5):
        for c in range(7):
            exps = {s for s, t, _ in links if t == f"m{i}" and s != "other"} & {s for s, t, _ in links if t == f"c{c}"}
            want[f"m{i}", f"c{c}"] = len(exps)
    got = {(r.x_id, r.y_id): r["count"] for r in G.gap_matrix(n, e).collect()}
    assert got == want
    assert {(r.x_id, r.y_id) for r in G.gaps_only(n, e).collect()} == {k for k, v in want.items() if not v}
    assert G.gap_matrix(n.filter("type <> 'condition'"), e).isEmpty()


def test_khop_derives_the_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    nodes = spark.range(6).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    line = spark.range(5).select(*[F.concat(F.lit("n"), (F.col("id") + k).cast("string")).alias(c) for k, c in ((0, "source"), (1, "target"))], F.lit("R").alias("type"))
    edges = line.mapInPandas(count, line.schema)
    got = {r.node_id: r.hop for r in G.khop_neighbors(nodes, edges, nodes.limit(1).select(F.lit("n2").alias("seed_id")), 3).collect()}
    assert got == {"n2": 0, "n1": 1, "n3": 1, "n0": 2, "n4": 2, "n5": 3} and made.value == 5


def test_only_edges_to_accepted_names_are_stored(spark, graph, monkeypatch):
    n, e = graph
    stored, cut = [], S.cut_lineage

    def spy(df):
        out = cut(df)
        if out.columns == ["experiment_id", "relation", "lname"]:
            stored.extend(tuple(r) for r in out.collect())
        return out

    monkeypatch.setattr(S, "cut_lineage", spy)
    asked, found = S.prepare(n, spark.createDataFrame([(1, "what about nickel matte")], "question_id long, text string"), S.SearchSettings(datetime.date(2026, 1, 1)))
    got = S.matched_experiments(n, e.unionByName(e.filter("target = 'm1' AND source = 'e1'").withColumn("type", F.lit("USES_PROCESS"))), asked, found)
    assert sorted(r.experiment_id for r in got.collect()) == ["e1", "e2"]
    assert sorted(stored) == [("e1", "USES_MATERIAL", "nickel matte"), ("e2", "USES_MATERIAL", "nickel matte")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_and_names_equal_their_views_without_texts_in_the_distinct(spark, sf_dir):
    want, got = star.view(spark, sf_dir, "g_edges"), star.edges(spark, sf_dir)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "hashpartitioning(l_orderkey" in plan_of(got.filter("type = 'USES_MATERIAL'"))
    names = star.node_names(spark, sf_dir)
    want = star.view(spark, sf_dir, "g_nodes").select(*names.columns)
    assert names.exceptAll(want).isEmpty() and want.exceptAll(names).isEmpty()
    assert "l_discount" not in plan_of(names)


def test_review_reads_only_edges_between_conclusions(spark, graph):
    n, e = graph
    back = spark.createDataFrame([("k5", "k3", "TAGGED_AS")], "source string, target string, type string")
    joined = e.select("source", "target", "type").unionByName(back)
    assert C.review_candidates(n, joined).count() == 0
    assert C.review_candidates(n, e.filter("type <> 'PRODUCES_CONCLUSION'")).count() == 0
    ids_in = G.id_range(n.filter("type = 'conclusion'"), "id")
    assert set(ids(n.filter("type = 'conclusion'"))) <= set(ids(n.filter(ids_in(F.col("id")))))
    assert not [i for i in ids(n.filter(ids_in(F.col("id")))) if i.startswith("e")]
    assert n.filter(G.id_range(n.filter("false"), "id")(F.col("id"))).isEmpty()


def test_detail_reads_only_edges_at_experiments(spark, graph):
    n, e = graph
    exps = G.entities_by_type(n, "experiment")
    got, plain = ({(r.experiment_id, r.relation, r.node_id) for r in G.experiment_detail(n, e, exps, ranged).collect()} for ranged in (True, False))
    assert got == plain
    known, own = set(ids(n)), set(ids(exps))
    links = [(r.source, r.type, r.target) for r in e.collect()]
    assert got == {(s, t, x) for s, t, x in links if s in own and x in known} | {(x, "incoming::" + t, s) for s, t, x in links if x in own and s in known}
    assert ">= e1" in plan_of(G.experiment_detail(n, e, exps, ranged=True))


def test_validation_neither_sorts_edges_nor_interprets_a_lambda(spark, graph):
    n, e = graph
    odd = spark.createDataFrame([("e1", "e2", "USES_MATERIAL"), ("k1", "e2", "ODD")], "source string, target string, type string")
    checked = C.validate_relations(n, odd)
    assert {r.type: len(r.issues) for r in checked.collect()} == {"USES_MATERIAL": 1, "ODD": 1} and not checked.filter("accepted").count()
    assert "lambda" not in plan_of(checked) and "SortMergeJoin" not in plan_of(checked)


def test_induced_degrees_are_counted_before_the_set_is_asked_for(spark, graph):
    n, e = graph
    inside, _ = G.induced_subgraph(n, e, n.filter("type = 'experiment'"))
    want = {r.id: r.degree for r in G.node_degree(n, e).collect()}
    got = {r.id: r.degree for r in inside.collect()}
    assert got == {i: want[i] for i in ids(G.entities_by_type(n, "experiment"))}
    assert plan_of(G.induced_subgraph(n, e, n.filter("type = 'experiment'"))[0]).count("LeftSemi") == 1


def test_chain_steps_do_not_travel(spark, graph):
    n, e = graph
    got = {(r.step_no, r.step, r.kind) for r in G.experiment_chains(n, e).collect()}
    assert got == {(0, "material", None), (1, "process", None), (3, "result", "conclusion")}
    # The plan is printed from the result down: the names of the steps are made above the first shuffle only.
    plan = plan_of(G.experiment_chains(n, e))
    assert "THEN equipment" in plan[: plan.index("Exchange")] and "THEN equipment" not in plan[plan.index("Exchange") :]
