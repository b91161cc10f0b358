"""Incremental ingest queries (T rows of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigraph.queries.checksql import chunks_sql
from evigraph.queries.registry import query
from evigraph.session import ensure_checkpoint_dir
from evigraph.sources.star import table
from evigraph.streaming.ingest import daily_counts_stream, new_entity_timeline, stream_ingest


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream(spark, d, name):
    """A table as a stream, be it one file or a folder of files."""
    schema = table(spark, d, name).schema
    # A pattern, as a stream's path without one must be a folder.
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{{{name}}}.parquet")


@query(
    "stream_ingest", "blocks",
    f"""WITH {chunks_sql('blocks')}, h AS (SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS content_hash FROM blocks GROUP BY doc_id)
    SELECT content_hash, max(n) AS n_chunks FROM (SELECT doc_id, content_hash, count(*) AS n FROM chunks JOIN h USING (doc_id) GROUP BY ALL) GROUP BY content_hash""",
)
def _(spark, d):
    docs = stream(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("added_at"))
    out = scratch(spark, "ingest")
    chunks = stream_ingest(docs, out, f"{out}/state", "\n")
    return chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("daily_event_stream", "", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    out = scratch(spark, "daily")
    ev = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return daily_counts_stream(ev, f"{out}/table", f"{out}/state").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "new_entity_timeline", "",
    """WITH f AS (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1, 2), c AS (SELECT day, count(*) AS new_entities FROM f GROUP BY day)
    SELECT CAST(day AS VARCHAR) AS day, new_entities, CAST(sum(new_entities) OVER (ORDER BY day) AS BIGINT) AS total FROM c""",
)
def _(spark, d):
    seen = table(spark, d, "events").select(F.struct("user_id", "event_type").alias("entity"), F.col("ts").cast("date").alias("day"))
    return new_entity_timeline(seen).withColumn("day", F.col("day").cast("string"))
