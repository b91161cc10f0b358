"""A stored, updatable index of chunk texts and vectors: Parquet clustered by cells, with exact pruning.

Layout below the index folder, one folder per generation (a compaction starts a new one)::

    current                       the generations, one row each; the highest counts
    gen-G/centroids               cell, centroid
    gen-G/shape                   an empty table with the columns of a chunk row
    gen-G/rows/batch=B/cell=C     chunk rows with their vectors and distance to the centroid
    gen-G/cells/batch=B           cell, rows, radius: what the batch added to each cell
    gen-G/deleted/batch=B         doc_id: rows of this document in batches up to B are gone
    gen-G/log                     batch, kind: a batch counts once its row is here

New chunks are embedded once, go to their nearest cell and widen its radius if they must; deletions are rows as
well. Nothing is rewritten until ``compact``. A batch that was not finished is overwritten by the next one.

A query vector q can score at most ``q.c + |q| r`` in a cell with centroid c and radius r, so cells below the
threshold are never read: they are partitions, and the scan prunes them. For the best ``pool`` the nearest cells are
read first; the rest only where their bound reaches the query's present pool-th score. Both are exact.

The centroids (``MAX_CELLS`` at most) are fitted in one task on a sample of about ``SAMPLE_VALUES`` vector components;
they and the cells' statistics are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evigraph.operators import retrieval as R
from evigraph.operators.embedding import embed_text
from evigraph.session import cut_lineage, cut_to_table

MAX_CELLS = 4096
CELL_ROWS = 2000  # chunks per cell that the number of cells aims at
SAMPLE_VALUES = 8_000_000
ROUNDS = 8
SLACK = 1e-8  # scores are rounded; bounds must not fall short by that
FIRST_CELLS = 2
FILE_ROWS = 20_000  # chunks of one file of a cell, about
COLUMNS = ["chunk_id", "doc_id", "chunk_no", "location", "text", "embedding"]

Embed = Callable[[DataFrame], DataFrame]


class ChunkIndex(NamedTuple):
    spark: SparkSession
    path: str  # of the generation
    last: int  # last batch that counts
    deletes: bool


def open_index(spark: SparkSession, path: str) -> ChunkIndex:
    generation = spark.read.parquet(f"{path}/current").agg(F.max("generation")).first()[0]
    at = f"{path}/gen-{generation}"
    last, deletes = spark.read.parquet(f"{at}/log").agg(F.max("batch"), F.max(F.col("kind") == "deleted")).first()
    return ChunkIndex(spark, at, last, deletes)


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Plain k-means on the sample."""
    rng = np.random.default_rng(1)
    centroids = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(sample, centroids)[0]
        order = np.argsort(owner, kind="stable")
        some, first = np.unique(owner[order], return_index=True)
        centroids[some] = np.add.reduceat(sample[order], first) / np.bincount(owner, minlength=n)[some, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner, distance, norms = np.empty(len(x), np.int64), np.empty(len(x)), (centroids**2).sum(1)
    for a in range(0, len(x), 4096):
        some = x[a : a + 4096]
        own = (norms - 2 * some @ centroids.T).argmin(1)
        owner[a : a + 4096], distance[a : a + 4096] = own, np.sqrt(((some - centroids[own]) ** 2).sum(1))
    return owner, distance


def _embedded(chunks: DataFrame, embed: Embed | None) -> DataFrame:
    """Chunks with vectors, as a table: what asks for vectors reads no texts. Filtered after the cut, as a filter on its
    result would run the embedder twice."""
    rows = (embed(chunks) if embed else chunks).select(*COLUMNS[:5], F.col("embedding").cast("array<double>").alias("embedding"))
    return cut_to_table(rows).filter("embedding IS NOT NULL")


def _dealt(rows: DataFrame, taken: int, total: int) -> DataFrame:
    """(h, chunk_id, embedding) of about ``taken`` of ``total`` rows, by a threshold on the hash of their ids.

    Sorting for the first ``taken`` would send that many rows of every partition to one place.
    """
    dealt = F.xxhash64("chunk_id")
    below = -(1 << 63) + (taken << 64) // max(total, 1)
    some = rows if taken >= total else rows.filter(dealt < F.lit(below))
    return some.select(dealt.alias("h"), "chunk_id", "embedding")


def _in_order(dealt: pd.DataFrame) -> pd.Series:
    return dealt.sort_values(["h", "chunk_id"])["embedding"]


def _sample(rows: DataFrame, taken: int, total: int) -> pd.Series:
    """Vectors of ``_dealt`` rows in the order of the fit."""
    return _in_order(_dealt(rows, taken, total).toPandas())


def _fitted(rows: DataFrame, total: int, width: int, cell_rows: int) -> DataFrame:
    """(cell, centroid), fitted in a task: the sample never reaches the driver."""
    spark, schema = rows.sparkSession, "cell int, centroid array<double>"
    if not total:
        return spark.createDataFrame([(0, [0.0] * width)], schema).coalesce(1)

    def fit(dealt: pd.DataFrame) -> pd.DataFrame:
        sample = np.stack(_in_order(dealt).to_numpy()).astype(np.float64)
        centroids = _fit(sample, int(max(1, min(MAX_CELLS, total // cell_rows, len(sample)))))
        return pd.DataFrame({"cell": np.arange(len(centroids), dtype=np.int32), "centroid": list(centroids)})

    return _dealt(rows, max(1, SAMPLE_VALUES // width), total).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, schema)


def create_index(path: str, chunks: DataFrame, embed: Embed | None = embed_text, cell_rows: int = CELL_ROWS) -> ChunkIndex:
    """Embed ``chunks(chunk_id, doc_id, chunk_no, location, text)`` and write them as a new generation of ``path``.

    With ``embed=None`` the chunks carry their vectors. Vectors have one length; null ones take no part.
    """
    spark = chunks.sparkSession
    rows = _embedded(chunks, embed)
    total, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    generation = _next_generation(spark, path)
    at = f"{path}/gen-{generation}"
    _fitted(rows, total, max(width or 1, 1), cell_rows).write.mode("overwrite").parquet(f"{at}/centroids")
    rows.limit(0).withColumn("distance", F.lit(0.0)).write.mode("overwrite").parquet(f"{at}/shape")
    _append(spark, at, 0, rows)
    spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").parquet(f"{path}/current")
    return open_index(spark, path)


def _next_generation(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(f"{path}/current").agg(F.max("generation")).first()[0] + 1 if there else 0


def _append(spark: SparkSession, at: str, batch: int, rows: DataFrame) -> None:
    shared = spark.sparkContext.broadcast(_centroids(spark, at))

    @F.pandas_udf("cell int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        found = _nearest(np.stack(vectors.to_numpy()).astype(np.float64), shared.value) if len(vectors) else (np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"cell": found[0].astype(np.int32), "distance": found[1]})

    placed = rows.select(*COLUMNS, nearest("embedding").alias("at")).select(*COLUMNS, "at.cell", "at.distance")
    # A cell that holds a large share of all chunks is many files. The parts only steer where rows are written.
    parts = spark.createDataFrame([(r.cell, -(-r.n // FILE_ROWS)) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()], "cell int, parts long")
    part = F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = placed.join(F.broadcast(parts), "cell", "left").select(*COLUMNS, "distance", "cell", part)
    dealt.repartition("cell", "part").drop("part").write.mode("overwrite").partitionBy("cell").parquet(f"{at}/rows/batch={batch}")
    # From the rows as they were written: a vector between two cells may fall to the other one when it is placed again.
    schema = spark.read.parquet(f"{at}/shape").schema.add("cell", IntegerType())
    stats = spark.read.schema(schema).parquet(f"{at}/rows/batch={batch}").groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{at}/cells/batch={batch}")
    _commit(spark, at, batch, "rows")


def _commit(spark: SparkSession, at: str, batch: int, kind: str) -> None:
    spark.createDataFrame([(batch, kind)], "batch int, kind string").coalesce(1).write.mode("append").parquet(f"{at}/log")


def _centroids(spark: SparkSession, at: str) -> np.ndarray:
    rows = spark.read.parquet(f"{at}/centroids").orderBy("cell").toPandas()
    return np.stack(rows["centroid"].to_numpy()).astype(np.float64)


def add_chunks(path: str, chunks: DataFrame, embed: Embed | None = embed_text) -> ChunkIndex:
    """Append chunks; those whose chunk_id is in the index already are left out (delete their document first)."""
    index = open_index(chunks.sparkSession, path)
    new = chunks.join(stored_chunks(index).select("chunk_id"), "chunk_id", "left_anti")
    rows = _embedded(new, embed)
    if not rows.isEmpty():
        _append(index.spark, index.path, index.last + 1, rows)
    return open_index(index.spark, path)


def delete_documents(path: str, docs: DataFrame) -> ChunkIndex:
    """Remove all chunks of the documents in ``docs(doc_id)``; chunks added later count again."""
    index = open_index(docs.sparkSession, path)
    docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{index.path}/deleted/batch={index.last + 1}")
    _commit(index.spark, index.path, index.last + 1, "deleted")
    return open_index(index.spark, path)


def compact(path: str, spark: SparkSession, cell_rows: int = CELL_ROWS) -> ChunkIndex:
    """Write the living chunks as a new generation with new cells; vectors are taken over."""
    return create_index(path, stored_chunks(open_index(spark, path)), None, cell_rows)


def stored_chunks(index: ChunkIndex) -> DataFrame:
    """All living chunks with their vectors, batch and cell."""
    # Without rows the clustered folder holds no file that tells its columns.
    shape = index.spark.read.parquet(f"{index.path}/shape").schema.add("batch", IntegerType()).add("cell", IntegerType())
    rows = index.spark.read.schema(shape).parquet(f"{index.path}/rows").filter(F.col("batch") <= index.last)
    if not index.deletes:
        return rows
    gone = index.spark.read.parquet(f"{index.path}/deleted").filter(F.col("batch") <= index.last).groupBy("doc_id").agg(F.max("batch").alias("until"))
    return rows.join(gone, "doc_id", "left").filter(F.col("until").isNull() | (F.col("batch") > F.col("until"))).drop("until")


def _cells(index: ChunkIndex) -> pd.DataFrame:
    """cell, rows, radius over all batches: ``MAX_CELLS`` rows at most."""
    rows = index.spark.read.parquet(f"{index.path}/cells").filter(F.col("batch") <= index.last)
    return rows.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).orderBy("cell").toPandas()


def _bounds(index: ChunkIndex, queries: DataFrame, cells: pd.DataFrame, min_score: float, pool: int | None) -> DataFrame:
    """(qset_id, cell, bound, near): cells that can hold a score of ``min_score``; near ones are read first."""
    own, radius, sizes = cells["cell"].to_numpy(), cells["radius"].to_numpy(), cells["rows"].to_numpy()
    shared = index.spark.sparkContext.broadcast((_centroids(index.spark, index.path)[own] if len(own) else np.zeros((0, 1)), own, radius, sizes))

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, own, radius, sizes = shared.value
        for part in parts:
            for a in range(0, len(part) if len(own) else 0, 512):
                some = part.iloc[a : a + 512]
                q = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                like = q @ centroids.T
                bound = like + np.linalg.norm(q, axis=1)[:, None] * radius + SLACK
                order = np.argsort(-like, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                near = np.zeros(like.shape, bool)
                np.put_along_axis(near, order, (before < (pool or 0)) | (np.arange(len(own)) < FIRST_CELLS), axis=1)
                i, j = np.nonzero(bound >= min_score)
                yield pd.DataFrame({"qset_id": some["qset_id"].to_numpy()[i], "cell": own[j], "bound": bound[i, j], "near": near[i, j]})

    kind = queries.schema["qset_id"].dataType.simpleString()
    found = queries.select("qset_id", "embedding").mapInPandas(reach, f"qset_id {kind}, cell int, bound double, near boolean")
    return found.groupBy("qset_id", "cell").agg(F.max("bound").alias("bound"), F.max("near").alias("near"))


def _score_cells(index: ChunkIndex, pairs: DataFrame, queries: DataFrame, cells: pd.DataFrame, min_score: float, pool: int | None, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of question sets with the chunks of the cells they are paired with; other cells are not read."""
    pairs = cut_lineage(pairs.select("qset_id", "cell"))
    asked = [r[0] for r in pairs.select("cell").distinct().collect()]  # MAX_CELLS at most
    sizes = cells[cells["cell"].isin(asked)]
    parts = index.spark.createDataFrame([(int(c), int(-(-n // R.TILE_ROWS))) for c, n in zip(sizes["cell"], sizes["rows"], strict=True)], "cell int, parts int")
    values = queries.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    blocks = F.lit(int(-(-values // R.QUERY_VALUES)) or 1)
    rows = only(stored_chunks(index).filter(F.col("cell").isin(asked))).select("chunk_id", "doc_id", "embedding", "cell")
    dealt = rows.join(parts, "cell").select("chunk_id", "doc_id", "embedding", "cell", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    wanted = pairs.join(parts, "cell").join(queries.select("qset_id", "embedding"), "qset_id")
    wanted = wanted.select("qset_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qset_id"), blocks).cast("int").alias("block"))
    schema = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((queries, "qset_id"), (rows, "chunk_id"), (rows, "doc_id"))) + ", score double"
    keys = ["cell", "part", "block"]
    return dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(lambda left, right: R.score_group(left, right, min_score, pool, R.CELLS), schema)


def search(index: ChunkIndex, queries: DataFrame, min_score: float, pool: int | None = None, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(qset_id, chunk_id, doc_id, score) as ``retrieval.score_chunks`` gives it over the chunks that ``only`` keeps.

    With ``pool`` all entries that can be among a set's best ``pool`` are returned, and few others.
    """
    queries = cut_lineage(queries.select("qset_id", "embedding"))
    cells = _cells(index)
    bounds = cut_lineage(_bounds(index, queries, cells, min_score, pool))
    if pool is None:
        return _score_cells(index, bounds, queries, cells, min_score, None, only)
    first = cut_lineage(R.top_scores(_score_cells(index, bounds.filter("near"), queries, cells, min_score, pool, only), pool).drop("rank"))
    reached = first.groupBy("qset_id").agg(F.when(F.count("*") >= pool, F.min("score")).alias("kth"))
    rest = bounds.filter(~F.col("near")).join(reached, "qset_id", "left").filter(F.col("bound") >= F.coalesce("kth", F.lit(min_score)))
    return first.unionByName(_score_cells(index, rest, queries, cells, min_score, pool, only))


def indexed_topk(index: ChunkIndex, queries: DataFrame, k: int, min_score: float, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    return R.top_scores(search(index, queries, min_score, k, only), k)
