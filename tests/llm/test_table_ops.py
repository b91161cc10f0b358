"""Operators over whole tables, against brute force, and the pipeline."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evigraph.llm import decontamination, jaccard_join, url_reputation, vector_search
from evigraph.llm.graph import components

DOCS = "doc_id long, text string, n int, kind string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "l") for i, t in rows], DOCS)


# --- near duplicates --------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def noisy_groups(seed, groups=12, copies=12, words=60):
    """Groups of edited copies with shared passages, short texts near the boundary of sizes, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 9, 12, 20, words, 3 * words]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [None, "", " ", "a b", "A B", "a b c d", rows[0], rows[0].upper(), "x " * 30_000, "x " * 30_000 + "y"]
    return list(enumerate(rows))


@pytest.mark.parametrize("changed", [{}, {"SHORT_LIST": 3, "PIVOTS": 1, "BLOCK": 4, "LOCAL_DF": 2}])
def test_groups_equal_brute_force(spark, monkeypatch, changed):
    for name, value in changed.items():  # long lists, blocks and frequent shingles on a small table
        monkeypatch.setattr(jaccard_join, name, value)
    rows = noisy_groups(len(changed))
    got = jaccard_join.jaccard_groups(docs_of(spark, [*rows, (None, "null id null id null id")])).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and len(got) == len(rows) + 1
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t)) for i, t in rows}


@pytest.mark.parametrize("boundary", [0, 9, 64])
def test_small_sets_by_subsets_and_large_by_lists_meet(spark, monkeypatch, boundary):
    order = jaccard_join.fit_order
    monkeypatch.setattr(jaccard_join, "fit_order", lambda d: (order(d)[0], boundary))
    rows = noisy_groups(7, groups=10, copies=8, words=12)
    got = jaccard_join.jaccard_groups(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q w e r t y u"), (2, "z x c v b n m"), (3, "Z x c v b n m"), (None, "a b c d e f g"), (4, None)]
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (None, None), (4, 4)}
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (2, "q w e r t y u"), (4, "")]
    assert jaccard_join.jaccard_groups(docs.limit(0)).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1100)] + [(2000, 2000)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_components_of_long_chains(spark, monkeypatch):
    """Chains of versions, in order and shuffled, take few rounds."""
    from evigraph.llm import graph

    cuts = []
    monkeypatch.setattr(graph, "stored", lambda df, store=graph.stored: cuts.append(1) or store(df))
    n = 10_000
    other = list(range(50_000, 50_000 + n))
    random.Random(5).shuffle(other)
    links = [(i, i + 1) for i in range(n)] + list(zip(other[:-1], other[1:], strict=True))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | dict.fromkeys(other, 50_000)
    assert len(cuts) / 4 < 15  # three tables a round, and one to put the moves together


def test_a_repeated_id_links_by_each_of_its_texts(spark):
    rng = random.Random(6)
    a, b = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(2))
    near = b.rsplit(" ", 2)[0] + " q r"
    got = jaccard_join.jaccard_groups(docs_of(spark, [(2, a), (2, b), (5, near), (7, "else " * 20)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2, 2), (5, 2), (7, 7)}


def test_the_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        a, b = rng.choice(pool, rng.integers(1, 300), replace=False), rng.choice(pool, rng.integers(1, 300), replace=False)
        bound = jaccard_join.overlap_bound(jaccard_join.signature(np.sort(a)), jaccard_join.signature(np.sort(b)))
        assert bound >= len(np.intersect1d(a, b))


# --- leaks ------------------------------------------------------------------------------------------


def plain_alignment(x, y):
    """Textbook Smith-Waterman over two word lists."""
    best, row = 0.0, [0.0] * (len(x) + 1)
    for w in y:
        new = [0.0]
        for j, v in enumerate(x, 1):
            new.append(max(0.0, row[j - 1] + (1 if v == w else -decontamination.MISMATCH), row[j] - decontamination.GAP, new[j - 1] - decontamination.GAP))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(3)
    windows = [rng.integers(2, 9, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    items = [rng.integers(2, 9, rng.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    got = decontamination.local_scores(windows, items)
    assert np.allclose(got, [plain_alignment(x.tolist(), y.tolist()) for x, y in zip(windows, items, strict=True)])


def test_edited_copies_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60)))) for k in range(30)]
    rows, leaked = [], set()
    for k, (item, text) in enumerate(items):
        for q, rate in enumerate((0, 0.1, 0.2)):
            t = [w for w in (rng.choice([word(), w, w]) if rng.random() < rate * 1.5 else w for w in text.split()) if rng.random() > rate / 5]
            rows.append((k * 10 + q, " ".join([word() for _ in range(50)] + t + [word() for _ in range(50)])))
            leaked.add((k * 10 + q, item))
    rows += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(200)] + [(5000, None), (5001, ""), (None, items[0][1]), (0, rows[0][1])]
    bench = spark.createDataFrame([*items, (items[0][0], items[0][1]), (99, None), (98, "two words"), (None, "x y z")], "item_id long, text string")
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(docs, bench).collect()}
    assert set(got) <= leaked and len(got) >= 0.9 * len(leaked)
    assert all(got[(k * 10, k)] == 1.0 for k in range(30))
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 5000, 5001, *range(1000, 1200)}
    assert decontamination.find_leaks(docs.limit(0), bench).collect() == [] and decontamination.find_leaks(docs, bench.limit(0)).collect() == []


# --- urls -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_urls_equal_the_sql(spark, d):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(url_reputation.CHECK).fetchall()
    got = url_reputation.op5_url_reputation(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_urls_rules_reputation_and_edge_rows(spark):
    urls = [
        (1, None), (2, "no scheme"), (3, "http://WWW.Example.COM/en/x?y"), (4, "https://blog.example.com/en/"), (5, "http://a.net/fr/1#t"), (6, "http://com"), (7, "http://notexample.com/en/"),
        (8, "x://h.org/a://b"), (9, "http://bad.org/1"), (9, "http://bad.org/1"), *[(100 + i, f"http://bad.org/{i}") for i in range(50)], *[(200 + i, f"http://good.org/{i}") for i in range(50)],
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, host string")
    labels = spark.createDataFrame([*[(100 + i, 0, 0) for i in range(50)], *[(200 + i, 1, 0) for i in range(50)], (200, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages, url_reputation.page_outcomes(labels)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (3, 4, 5)] == [("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("blog.example.com", "/en/", "example.com/en/", "block"), ("a.net", "/fr/1", "net/fr/", "block")]
    assert (got[1].host, got[2].path, got[6].rule, got[7].rule, got[8].host) == ("", "", None, "com/", "h.org")
    assert got[9].verdict == "block" and got[210].verdict == "allow"
    none = url_reputation.filter_urls(pages, url_reputation.page_outcomes(labels.limit(0)))
    assert none.count() == len(urls) and none.filter("rule IS NULL AND verdict = 'block'").isEmpty()
    assert url_reputation.filter_urls(pages.limit(0), url_reputation.page_outcomes(labels)).collect() == []


# --- vectors ----------------------------------------------------------------------------------------


def brute_nearest(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            scored = sorted((-float((v * q).sum()), j) for j, v in zip(ids, x, strict=True) if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    got = vector_search.op6_vector_search(spark, d).toPandas()
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = brute_nearest([r.vec_id for r in rows], [np.array(r.embedding, float) for r in rows], 20)
    found = got.groupby("query_id").vec_id.apply(set)
    assert set(found.index) == set(want) and np.mean([len(found[i] & set(w)) / 20 for i, w in want.items()]) >= 0.9


def test_recall_with_many_lists_hot_vectors_and_other_norms(spark, monkeypatch):
    for name, value in {"LIST_SIZE": 40, "BLOCK": 64, "QUERY_BLOCK": 16}.items():
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 16)) * rng.uniform(0.3, 2, (2400, 1))
    x[:800] = x[0]  # one vector holds a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    want = brute_nearest(range(2400), x, 20)
    assert np.mean([len(set(g.vec_id) & set(want[i])) / 20 for i, g in got.groupby("query_id")]) >= 0.9 and got.groupby("query_id").size().eq(20).all()
    own = x[0] @ x[0]
    tied = got[(got.query_id == 40) & np.isclose(got.score, own)]
    assert tied.vec_id.is_monotonic_increasing


def test_recall_does_not_fall_with_the_number_of_lists(spark, monkeypatch):
    for name, value in {"LIST_SIZE": 10, "PER_CENTROID": 8}.items():
        monkeypatch.setattr(vector_search, name, value, raising=False)
    x = np.random.default_rng(7).normal(size=(10_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(table, F.col("vec_id") % 200 == 0).toPandas()
    found = got.groupby("query_id").vec_id.apply(set)
    score = x[::200] @ x.T
    score[np.arange(50), np.arange(0, 10_000, 200)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(found[200 * i] & set(w)) / 20 for i, w in enumerate(want)]) >= 0.97


def test_no_most_of_lists_read():
    d = np.array([np.linspace(1, 1.14, 500), np.linspace(1, 9, 500)])
    chosen = vector_search.chosen_lists(np.arange(500) + np.zeros((2, 1), int), d)
    assert len(chosen[0]) == 500 and len(chosen[1]) == 50


def test_vectors_of_edge_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (20, [0.5, 0.5], "x"), (20, [0.5, 0.5], "x"), (1, [2.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [None, 1.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [float("inf"), 1.0], "x"), (7, [1.0], "x"), (None, [1.0, 1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = vector_search.nearest(table, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2.0), (0, 2, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 0, 0.5)]
    assert vector_search.nearest(table.limit(0), F.lit(True)).collect() == []


# --- pipeline and registration ----------------------------------------------------------------------


def test_pipeline_keeps_what_it_should(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["toxicity"](spark, docs, d)
    scores = {r.doc_id: r.predicted for r in entry.queries()["op9_toxicity"](spark, d).collect()}
    left = {r.doc_id for r in one.collect()}
    assert left == {i for i in texts if not scores[i]} and one.columns == docs.columns
    two = stage["jaccard_join"](spark, docs, d)
    groups = brute_components([(i, texts[i]) for i in texts if i < 300])
    kept = {r.doc_id for r in two.filter("doc_id < 300").collect()}
    assert kept <= set(groups) and all(groups[i] == i for i in kept)
    three = stage["decontamination"](spark, docs, d)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    held = {i for i, t in texts.items() if any(x in " ".join(t.split()) for x in items)}
    assert held and not held & {r.doc_id for r in three.select("doc_id").collect()} and three.count() >= len(texts) - len(held) - 5
    rows = corpus_pipeline.run(spark, d)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and 0 < rows.count() < len(texts)


def test_every_numbered_operator_is_registered():
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names



def test_later_lists_return_only_what_comes_before_the_kth(spark):
    x = np.eye(4)[[0, 0, 0, 1]] * np.array([[1.0], [2.0], [2.0], [9.0]])
    members = pa.table({"id": [5, 6, 7, 8], "v": [r.tobytes() for r in x]})
    q = np.eye(4)[0].tobytes()
    queries = pa.table({"id": [1, 2, 3], "v": [q, q, q], "floor": [-np.inf, 2.0, 2.0], "floor_id": [-1, 7, 6]})
    got = vector_search.best_of_block(3)((0, 0, 0), queries, members).to_pylist()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(1, 6, 2.0), (1, 7, 2.0), (1, 5, 1.0), (2, 6, 2.0)]
