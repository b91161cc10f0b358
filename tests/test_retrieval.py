import random

import numpy as np
from pyspark.sql import functions as F

from evigraph.operators import retrieval as R
from evigraph.operators.embedding import embed_text
from evigraph.streaming.ingest import stream_ingest


def vectors(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def test_both_scoring_ways_agree_with_numpy(spark):
    c, q = vectors(300, 1), vectors(9, 2)
    chunks = spark.createDataFrame([(i, i // 3, v) for i, v in enumerate(c)], "chunk_id long, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(i // 3, i % 3, v) for i, v in enumerate(q)], "qset_id long, variant_no long, embedding array<double>")
    scores = (np.array(c) @ np.array(q).T).reshape(300, 3, 3).max(axis=2)
    want = {(s, i) for s in range(3) for i in sorted(range(300), key=lambda i: (-round(scores[i, s], 9), i))[:20] if scores[i, s] >= 0.2}
    for values, tile, cells in ((R.QUERY_VALUES, R.TILE_ROWS, R.CELLS), (20, 70, 100)):
        pool = R.top_scores(R.score_chunks(chunks, asked, 0.2, 20, query_values=values, tile_rows=tile, cells=cells), 20)
        assert {(r.qset_id, r.chunk_id) for r in pool.collect()} == want


def test_literal_tokens_are_looked_for_in_the_spaced_text(spark):
    rows = [("go south today", 0.0), ("made of os and pt", 1.0), ("at 300 мг/л", 1.0), ("at 300мг/л", 1.0), ("300 apples, мг/л", 0.0), (None, 0.0)]
    hard = {0: "os", 1: "os", 2: "300мг/л", 3: "300мг/л", 4: "300мг/л", 5: "os"}
    df = spark.createDataFrame([(t, [hard[i]], []) for i, (t, _) in enumerate(rows)], "t string, hard array<string>, terms array<string>")
    got = {r.t: r.s for r in df.select("t", R.lexical_score(F.col("hard"), F.col("terms"), F.col("t")).alias("s")).collect()}
    assert got == dict(rows)


def test_signals_and_boost(spark):
    q = spark.createDataFrame([(1, 0, "Очистка SO₂ при 300  мг/л на ПВП, код AD-171")], "qset_id long, variant_no long, text string")
    s = R.query_signals(q).first()
    assert set(s.hard) == {"so2", "300мг/л", "300", "пвп", "ad", "171"}
    assert s.terms == ["очистка"]
    t = spark.createDataFrame([("a", "очистки газа, so2 до 300мг/л"), ("b", "ничего")], "chunk_id string, text string")
    pool = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.55)], "qset_id long, chunk_id string, doc_id long, score double")
    hits = R.lexical_rerank(pool, R.query_signals(q), t, 2).orderBy("rank").collect()
    assert [(h.chunk_id, h.score) for h in hits] == [("a", 0.5), ("b", 0.55)]


def test_hash_vectors_are_unit_and_order_free(spark):
    df = spark.createDataFrame([(1, "nickel matte slag"), (2, "slag, MATTE: nickel"), (3, "")], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in embed_text(df).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-12 and not v[3].any()


def test_confidence_and_refusal(spark):
    cited = spark.createDataFrame([(1, 1, 10, 0.6, "x"), (1, 2, 11, 0.7, "y"), (2, 1, 10, 0.46, "z"), (3, 1, 10, 0.44, "z")], "qset_id long, index long, doc_id long, score double, excerpt string")
    qs = spark.range(1, 5).select(F.col("id").alias("qset_id"))
    assert [r.confidence for r in R.answer_confidence(cited, qs).orderBy("qset_id").collect()] == ["высокая", "средняя", "низкая", "нет данных"]
    a = R.extractive_answer(cited, qs).orderBy("qset_id").collect()
    assert a[0].answer.endswith("[1] x\n\n[2] y") and not a[3].grounded and a[3].answer == R.NOT_FOUND_ANSWER


def test_attach_state_equals_replay(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(50):
        state = [False, "", "abstract"]
        for seq in range(rng.randrange(1, 12)):
            a = rng.choice(["activate", "detach_auto", "attach_manual", "delete", "noop"])
            rows.append((doc, seq, a))
            if a == "activate":
                state = [True, "auto", "full"]
            elif a == "attach_manual":
                state[:2] = [True, "manual"]
            elif a == "delete":
                state = [False, "", "abstract"]
            elif a == "detach_auto" and state[1] == "auto":
                state[:2] = [False, ""]
        want[doc] = tuple(state)
    got = R.attach_state(spark.createDataFrame(rows, "doc_id long, seq long, action string")).collect()
    assert {r.doc_id: (r.attached, r.attach_source, r.index_mode) for r in got} == want


def test_stream_drops_copies_within_and_across_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string, added_at timestamp"

    def land(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.col("t").cast("timestamp").alias("added_at")).coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        docs = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        return stream_ingest(docs, out, str(tmp_path / "state"), "\n")

    land([(1, "one\ntwo", "2024-01-01 00:00:00"), (2, "one\ntwo", "2024-01-01 00:10:00"), (3, "three", "2024-01-01 00:20:00")], "a")
    assert run().select("content_hash").distinct().count() == 2
    land([(4, "one\ntwo", "2024-06-01 00:00:00"), (5, "four", "2024-06-01 00:00:00")], "b")  # long after the watermark
    got = run()
    assert got.select("content_hash").distinct().count() == 3 and got.count() == 3
    assert run().count() == 3


def test_a_group_that_one_side_lacks_has_no_scores(spark):
    """Its chunks have text ids; a filter may take all chunks of a cell, a block of questions may ask for none."""
    chunks = spark.createDataFrame([("a", 1, [1.0, 0.0])], "chunk_id string, doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qset_id long, embedding array<double>")
    assert R.score_chunks(chunks.limit(0), queries, 0.5).count() == 0 == R.score_chunks(chunks, queries.limit(0), 0.5).count()
    assert [tuple(r) for r in R.score_chunks(chunks, queries, 0.5).collect()] == [(1, "a", 1, 1.0)]
