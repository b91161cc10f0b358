"""Incremental ingest and daily timelines as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.operators.documents import chunk_documents, content_hash, with_blocks
from evigraph.session import cut_lineage


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored_hashes(spark: SparkSession, out: str) -> DataFrame | None:
    """Content hashes of documents ingested before, read from the output itself; None before the first batch."""
    return spark.read.parquet(f"{out}/documents") if folder_exists(spark, f"{out}/documents") else None


def ingest_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Chunk the new contents of one micro-batch and append them.

    Of copies inside the batch the earliest stays; contents stored by other batches are anti-joined,
    however old the documents are. The folder of a batch is overwritten, so a batch that is retried
    after a failure is written once.
    """
    known = stored_hashes(batch.sparkSession, out)
    one = F.min_by(F.struct(*batch.columns), F.struct("added_at", "doc_id"))
    fresh = batch.groupBy("content_hash").agg(one.alias("d")).select("d.*")
    if known is not None:
        fresh = fresh.join(known.filter(F.col("batch_id") != batch_id).select("content_hash"), "content_hash", "left_anti")
    # Computed once: documents and chunks agree even if the source is read twice.
    fresh = cut_lineage(fresh)
    kept = fresh.select("doc_id", "content_hash", "added_at")
    chunks = chunk_documents(fresh).join(kept.select("doc_id", "content_hash"), "doc_id")
    chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch_id={batch_id}")
    kept.write.mode("overwrite").parquet(f"{out}/documents/batch_id={batch_id}")


def stream_ingest(docs: DataFrame, out: str, checkpoint: str, separator: str) -> DataFrame:
    """Run all available input of a stream ``docs(doc_id, text, added_at)``; returns the chunk table.

    No watermark: a document is new if its content is not stored yet, whenever it was added.
    """
    spark = docs.sparkSession
    blocks = with_blocks(docs, separator)
    hashed = blocks.withColumn("content_hash", content_hash(blocks))
    run = (
        hashed.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    if folder_exists(spark, f"{out}/chunks"):
        return spark.read.parquet(f"{out}/chunks")
    # Nothing came yet: no batch has written a folder that tells the columns.
    none = spark.createDataFrame([], hashed.schema)
    return chunk_documents(none).join(none.select("doc_id", "content_hash"), "doc_id").withColumn("batch_id", F.lit(0))


COMPACT_AFTER = 64  # folders of batches that a reader opens at most, but for the newest run's
DAILY_SCHEMA = "day timestamp, event_type string, n long"


def _complete(spark: SparkSession, out: str, name: str) -> list[int]:
    """Numbers N of the finished folders ``name=N`` under ``out``, ascending."""
    if not folder_exists(spark, out):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    found = [e.getPath().getName().split("=") for e in entries]
    numbers = [int(parts[1]) for parts in found if parts[0] == name]
    return sorted(n for n in numbers if folder_exists(spark, f"{out}/{name}={n}/_SUCCESS"))


def _daily_parts(spark: SparkSession, out: str) -> tuple[list[str], list[int]]:
    """Folders that together hold every counted event once, and the batches after the last compaction."""
    folded = _complete(spark, out, "upto")[-1:]
    recent = [n for n in _complete(spark, out, "batch") if not folded or n > folded[0]]
    return [f"{out}/upto={n}" for n in folded] + [f"{out}/batch={n}" for n in recent], recent


def daily_counts(spark: SparkSession, out: str) -> DataFrame:
    """(day, event_type, n) of all batches under ``out``."""
    parts, _ = _daily_parts(spark, out)
    rows = spark.read.schema(DAILY_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], DAILY_SCHEMA)
    return rows.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def compact_daily(spark: SparkSession, out: str) -> None:
    """Fold all batches but the last, which a failed run may write again, into one table.

    The fold is a folder of its own that readers take once it is finished; nothing they read is changed.
    """
    parts, recent = _daily_parts(spark, out)
    if len(recent) < 2:
        return
    rows = spark.read.schema(DAILY_SCHEMA).parquet(*[part for part in parts if part != f"{out}/batch={recent[-1]}"])
    totals = rows.groupBy("day", "event_type").agg(F.sum("n").alias("n"))
    totals.write.mode("overwrite").parquet(f"{out}/upto={recent[-2]}")


def daily_counts_stream(events: DataFrame, out: str, checkpoint: str, compact_after: int = COMPACT_AFTER) -> DataFrame:
    """(day, event_type, n) kept up to date by a stream of events ``(ts, event_type)``; returns the current table.

    Counts add up, so a batch only appends its own counts per day: an event counts however late it is, no state is
    kept, and a batch costs what its own events cost. A retried batch overwrites its folder. Events without a time
    belong to no day.
    """
    spark = events.sparkSession

    def keep(df: DataFrame, batch_id: int) -> None:
        dated = df.filter("ts IS NOT NULL")
        counts = dated.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run = events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if len(_daily_parts(spark, out)[1]) > compact_after:
        compact_daily(spark, out)
    return daily_counts(spark, out)


def new_entity_timeline(sightings: DataFrame) -> DataFrame:
    """(day, new_entities, total): entities by the day they first appear, with a running total.

    ``sightings(entity, day)``. The running total sorts one row per day.
    """
    first = sightings.groupBy("entity").agg(F.min("day").alias("day"))
    per_day = first.groupBy("day").agg(F.count(F.lit(1)).alias("new_entities"))
    return per_day.withColumn("total", F.sum("new_entities").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)))
