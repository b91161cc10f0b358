"""The stored index against brute force, through additions, deletions and compaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import chunk_index as X
from evigraph.operators import retrieval as R

CHUNKS = "chunk_id string, doc_id long, chunk_no int, location string, text string, embedding array<double>"


def vectors(seed, n, first=0, centres=12):
    """Clustered unit vectors with copies, a zero vector and ties."""
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(7).normal(size=(centres, 16))
    v = base[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1], v[2] = 0, v[0]
    return [(f"c{first + i}", (first + i) // 5, i % 5, "p", "t", x.tolist()) for i, x in enumerate(v)]


def brute(rows, asked, least, pool=None):
    best = {}
    for q, x in asked:
        for c, d, *_, v in rows:
            s = round(float(np.dot(x, v)), 9)
            if s >= least:
                best[q, c, d] = max(s, best.get((q, c, d), -2))
    if pool is None:
        return {(q, c, round(s, 8)) for (q, c, _), s in best.items()}
    out = set()
    for q in {q for q, _ in asked}:
        some = sorted(((-s, c) for (p, c, _), s in best.items() if p == q))[:pool]
        out |= {(q, c, round(-s, 8)) for s, c in some}
    return out


def rows_of(df):
    return {(r["qset_id"], r["chunk_id"], round(r["score"], 8)) for r in df.collect()}


@pytest.fixture
def asked(spark):
    rows = [(i % 9, x[5]) for i, x in enumerate(vectors(3, 18))]
    return rows, spark.createDataFrame(rows, "qset_id int, embedding array<double>")


def same(index, rows, asked):
    plain, table = asked
    assert rows_of(X.search(index, table, 0.8)) == brute(rows, plain, 0.8)
    assert rows_of(X.indexed_topk(index, table, 7, 0.25)) == brute(rows, plain, 0.25, 7)


def test_index_equals_brute_force_after_every_change(spark, tmp_path, asked):
    path = str(tmp_path / "index")
    rows = vectors(1, 600)
    X.create_index(path, spark.createDataFrame(rows, CHUNKS), None, cell_rows=30)
    more = vectors(2, 150, first=600, centres=3)
    index = X.add_chunks(path, spark.createDataFrame(more + rows[:20], CHUNKS), None)
    rows += more
    same(index, rows, asked)
    gone = [(3,), (4,), (121,), (9999,)]
    index = X.delete_documents(path, spark.createDataFrame(gone, "doc_id long"))
    rows = [r for r in rows if (r[1],) not in gone]
    same(index, rows, asked)
    back = [(f"n{i}", 3, i, "p", "t", r[5]) for i, r in enumerate(more[:4])]
    index = X.add_chunks(path, spark.createDataFrame(back, CHUNKS), None)
    rows += back
    same(index, rows, asked)
    index = X.compact(path, spark, cell_rows=40)
    assert index.path.endswith("gen-1") and not index.deletes
    same(index, rows, asked)
    keep = lambda r: r.filter("chunk_no < 2")
    assert rows_of(X.indexed_topk(index, asked[1], 5, 0.25, keep)) == brute([r for r in rows if r[2] < 2], asked[0], 0.25, 5)


def test_cells_out_of_reach_are_not_read(spark, tmp_path):
    rows = vectors(1, 600)
    index = X.create_index(str(tmp_path / "i"), spark.createDataFrame(rows, CHUNKS), None, cell_rows=30)
    one = spark.createDataFrame([(0, rows[10][5])], "qset_id int, embedding array<double>")
    cells = X._cells(index)
    read = X._bounds(index, one, cells, 0.9, None).count()
    assert 0 < read <= len(cells) / 2


def test_texts_are_embedded_once(spark, tmp_path):
    path, calls = str(tmp_path / "i"), spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    chunks = spark.createDataFrame([(f"c{i}", i, 0, "p", "x" * i) for i in range(20)], "chunk_id string, doc_id long, chunk_no int, location string, text string")
    with_vectors = lambda df: df.withColumn("embedding", embed("text"))
    X.create_index(path, chunks, with_vectors)
    assert calls.value == 20
    index = X.add_chunks(path, chunks.union(spark.createDataFrame([("n", 99, 0, "p", "yy")], chunks.schema)), with_vectors)
    X.search(index, spark.createDataFrame([(0, [1.0, 0.0])], "qset_id int, embedding array<double>"), 0.5, 3).collect()
    assert calls.value == 21


def test_an_empty_index(spark, tmp_path, asked):
    index = X.create_index(str(tmp_path / "i"), spark.createDataFrame([], CHUNKS), None)
    assert X.search(index, asked[1], 0.1).collect() == []
    assert R.top_scores(X.search(index, asked[1], 0.1, 5), 5).collect() == []


def test_the_fitting_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    one, many = (sorted(v[0] for v in X._sample(rows.repartition(n), 2000, 20_000)) for n in (1, 40))
    assert one == many and 1700 < len(one) < 2300
    assert len(X._sample(rows, 20_000, 20_000)) == 20_000


def test_the_sample_is_fitted_off_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(X, "_sample")  # the driver's way to the vectors
    rows = spark.range(40).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit("").alias("location"),
        F.lit("").alias("text"), F.array(F.cos("id"), F.sin("id")).alias("embedding"),
    )
    index = X.create_index(str(tmp_path / "i"), rows, None, cell_rows=10)
    cells = X._cells(index)
    assert len(X._centroids(spark, index.path)) == 4 and cells["rows"].sum() == 40
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qset_id long, embedding array<double>")
    assert [r.chunk_id for r in X.indexed_topk(index, asked, 1, 0.5).collect()] == ["c0"]
