"""Incremental ingest over several runs, typed attributes and the file listing."""

import json

from pyspark.sql import functions as F

from evigraph.operators.extraction import parse_extractions
from evigraph.queries.incremental import stream
from evigraph.sources.files import corpus_files
from evigraph.sources.nodelink import load_node_link
from evigraph.streaming.ingest import daily_counts, daily_counts_stream, stream_ingest

SCHEMA = "doc_id long, text string, added_at timestamp"


def ingest(spark, folder, out):
    docs = spark.readStream.schema(SCHEMA).parquet(folder)
    return {r.doc_id for r in stream_ingest(docs, out, f"{out}/state", "\n").select("doc_id").distinct().collect()}


def add(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.col("t").cast("timestamp").alias("added_at")).coalesce(1).write.mode("append").parquet(folder)


def test_late_documents_and_copies_over_two_runs(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, [(1, "first text\nof one", "2024-06-01"), (2, "first text\nof one", "2024-06-02")])
    assert ingest(spark, folder, out) == {1}
    add(spark, folder, [(3, "an older document", "2020-01-01"), (4, "first text\nof one", "2019-01-01"), (5, "newest", "2030-01-01")])
    assert ingest(spark, folder, out) == {1, 3, 5}
    add(spark, folder, [(6, "older than all", "1999-01-01")])
    assert ingest(spark, folder, out) == {1, 3, 5, 6}


def test_an_empty_stream_has_an_empty_table(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert ingest(spark, folder, out) == set()
    add(spark, folder, [(1, "first text", "2024-06-01")])
    assert ingest(spark, folder, out) == {1}


def test_streams_read_a_table_in_one_file_or_a_folder(spark, tmp_path):
    rows = spark.range(6).select("id", (F.col("id") * 2).alias("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "folders" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "files").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "files" / "documents.parquet")
    for kind in ("folders", "files"):
        run = stream(spark, str(tmp_path / kind), "documents").writeStream.format("memory").queryName(f"read_{kind}").trigger(availableNow=True).start()
        run.awaitTermination()
        assert spark.table(f"read_{kind}").count() == 6


ATTRIBUTES = {"date": "2020", "year": 2021, "grade": "12", "note": "NaN", "t_c": 5, "x": 1.5, "none": None, "list": [1, 2], "flag": True}
TEXTS = {"date": "2020", "grade": "12", "note": "NaN", "list": "[1,2]", "flag": "true"}


def test_attributes_keep_their_json_type(spark):
    raw = json.dumps({"entities": [{"tmp_id": "e1", "type": "material", "name": "m", "attrs": ATTRIBUTES}, {"tmp_id": "e2", "type": "material", "name": "n"}], "relations": []})
    got = {r.tmp_id: r for r in parse_extractions(spark.createDataFrame([(1, 0, raw)], "doc_id long, chunk_no long, raw string"))[0].collect()}
    one = got["e1"]
    assert one.attrs_num == {"t_c": 5.0, "x": 1.5} | {k: float(ATTRIBUTES[k]) for k in ("year",) if k in one.attrs_num}
    assert one.attrs_str == TEXTS | {k: "2021" for k in ("year",) if k in one.attrs_str} and ("year" in one.attrs_num) != ("year" in one.attrs_str)
    assert got["e2"].attrs_num == {} and got["e2"].attrs_str == {}


def test_node_link_attributes_keep_their_json_type(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "material", "name": "m"} | {k: v for k, v in ATTRIBUTES.items() if k != "date"}], "links": []}))
    node = load_node_link(spark, str(tmp_path / "g.json"))[0].first()
    assert node.attrs_num == {"year": 2021.0, "t_c": 5.0, "x": 1.5} and node.attrs_str == {k: v for k, v in TEXTS.items() if k != "date"}


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "b.bin").write_text("abcd")
    rows = corpus_files(spark, str(tmp_path), ["txt"]).select("path", "size").collect()
    assert len(rows) == 1 and rows[0].path.endswith("a.txt") and rows[0]["size"] == 3


def count_days(spark, folder, out, **args):
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(folder)
    rows = daily_counts_stream(events, out, f"{out}-state", **args).collect()
    return {(str(r.day.date()), r.event_type): r.n for r in rows}


def add_events(spark, folder, rows):
    spark.createDataFrame(rows, "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(folder)


def test_late_events_count_and_batches_are_compacted(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "daily")
    want = {}
    for batch, days in enumerate([["2024-06-20", "2024-06-20"], ["2024-06-10"], ["2020-01-01", "2024-06-20"], ["2024-06-21"]]):
        add_events(spark, folder, [(f"{day} 10:00:00", "view") for day in days] + [(None, "view")])
        for day in days:
            want[day, "view"] = want.get((day, "view"), 0) + 1
        assert count_days(spark, folder, out, compact_after=2) == want
    folded = {p.name for p in (tmp_path / "daily").iterdir() if p.name.startswith("upto=")}
    assert folded == {"upto=1"} or folded == {"upto=1", "upto=3"}
    assert sum(r.n for r in daily_counts(spark, out).collect()) == 6


def test_no_batches_give_no_days(spark, tmp_path):
    assert daily_counts(spark, str(tmp_path / "none")).collect() == []
