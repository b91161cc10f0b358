"""Approximate nearest neighbours with balanced posting lists.

Largest inner product is a nearest-neighbour search after one more coordinate, ``sqrt(M^2 - |x|^2)`` for
vectors (``M`` the largest norm) and 0 for queries.

* Centroids are fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest hash of their id) with a
  penalty on large clusters, so posting lists are balanced. Every vector is indexed.
* A vector at the boundary of several clusters is written into each of their lists: up to ``COPIES`` lists whose
  centroids are nearly as close as the nearest.
* Vectors find their lists by a neighbour graph of the centroids in memory (best first, many vectors at a time).
* A query is compared with every centroid and reads all lists whose centroid distance is within ``RATIO`` of its
  nearest centroid's: ``LEAST`` lists and a ``SHARE`` of all lists at least, and no most, so that recall does not
  fall with their number. What is read grows with the table.

Lists and the queries that read them meet in an equi join by list; both sides are dealt in blocks of bounded
size, so a list that a third of all vectors (or queries) fall into is many tasks. The ``FIRST`` nearest lists of a
query are read first and each block returns its best ``k`` a query; blocks of all its other lists return only what
comes before the query's ``k``-th of these, so that the rows found grow with the queries, not with the lists. The centroids (``CENTROIDS`` at most) are the only broadcast.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows that repeat an id are one, the smallest vector. A query with fewer than
``k`` found (and more candidates in the table) is searched again in all lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.tables import read
from evigraph.session import cut_lineage

K = 20
LIST_SIZE = 400          # vectors per list that the number of centroids aims at
CENTROIDS = 4096
SAMPLE, PER_CENTROID = 131_072, 32  # sample vectors, and how many of them a centroid is fitted on at least
ROUNDS, BALANCE = 12, 0.1
DEGREE, BEAM = 24, 48    # of the graph; candidates kept while a vector searches it for its lists
COPIES, SPREAD = 4, 1.25  # lists a vector may be in, and how much farther their centroids may be
LEAST, SHARE, RATIO = 16, 0.1, 1.15
FIRST = 4                # lists of a query that are read before the others
BLOCK, QUERY_BLOCK = 4096, 2048
BATCH = 512


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), one row per id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).scalar()
    return rows.filter(F.size("v") == length).groupBy("vec_id").agg(F.min("v").alias("v"))


# --- centroids and their graph ----------------------------------------------------------------------


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0))


def fit_centroids(x: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Balanced k-means: a cluster's distance grows with its size in the round before."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    size = np.full(n, len(x) / n)
    for _ in range(ROUNDS):
        owner = np.empty(len(x), np.int64)
        for a in range(0, len(x), 4096):
            d = distances(x[a : a + 4096], c)
            owner[a : a + 4096] = (d + BALANCE * d.min(1).mean() * np.minimum(size / size.mean(), 10)).argmin(1)
        size = np.bincount(owner, minlength=n).astype(float)
        order = np.argsort(owner, kind="stable")
        some = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], np.searchsorted(owner[order], some))
        c[some] = sums / size[some, None]
        empty = np.flatnonzero(size == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def neighbour_graph(c: np.ndarray) -> np.ndarray:
    """The nearest centroids of each, and a few random ones that keep the graph connected."""
    near = min(DEGREE, len(c) - 1)
    graph = np.empty((len(c), near + 4), np.int64)
    for a in range(0, len(c), 512):
        d = distances(c[a : a + 512], c)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        graph[a : a + 512, :near] = np.argpartition(d, max(near - 1, 0), axis=1)[:, :near] if near else 0
    graph[:, near:] = np.random.default_rng(5).integers(0, len(c), (len(c), 4))
    return graph


def search_graph(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids of each row of ``q`` (up to ``beam``), nearest first, and their distances."""
    n, beam = len(q), min(beam, len(c))
    rows = np.arange(n)
    d = np.full((n, len(c)), np.inf)
    fresh = np.full((n, len(c)), np.inf)  # found, not yet expanded
    entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(np.int64))
    d[:, entry] = fresh[:, entry] = distances(q, c[entry])
    active = rows
    while len(active):
        best = fresh[active].argmin(1)
        value = fresh[active, best]
        worst = np.partition(d[active], beam - 1, axis=1)[:, beam - 1]
        going = np.isfinite(value) & (value <= worst)
        active, best = active[going], best[going]
        if not len(active):
            break
        fresh[active, best] = np.inf
        new = graph[best]
        at = active[:, None]
        unseen = np.isinf(d[at, new])
        found = np.sqrt(((q[active][:, None, :] - c[new]) ** 2).sum(2))
        r, k = np.nonzero(unseen)
        d[active[r], new[r, k]] = fresh[active[r], new[r, k]] = found[r, k]
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    return order, d[rows[:, None], order]


def all_centroids(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All centroids of each row of ``q``, nearest first, and their distances."""
    d = distances(q, c)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, 1)


def posting_lists(order: np.ndarray, d: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Lists of each vector: its nearest centroid, and others nearly as close."""
    close = (d <= SPREAD * d[:, :1]) & (np.arange(d.shape[1]) < COPIES)
    return [o[k] for o, k in zip(order, close, strict=True)]


def chosen_lists(order: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """Lists that a query reads: distance-ratio pruning, with a least number. ``order`` holds all lists."""
    least = max(LEAST, SHARE * d.shape[1])
    read_ = (d <= RATIO * d[:, :1]) | (np.arange(d.shape[1]) < least)
    return [o[k & np.isfinite(x)] for o, k, x in zip(order, read_, d, strict=True)]


# --- the search -------------------------------------------------------------------------------------


def fit_index(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Centroids, graph and largest norm; None for an empty table."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return None
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = np.stack(sample.column("v").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1))
    x = np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]])
    lists = max(1, min(CENTROIDS, n // LIST_SIZE, len(x) // PER_CENTROID))
    c = fit_centroids(x, lists)
    return c, neighbour_graph(c), float(top)


def _assign(rows: DataFrame, index: tuple, asking: bool, everywhere: bool = False) -> DataFrame:
    """id, list, v (bytes) with a row for each list that a vector is in, or that a query reads (and ``near``, if read first)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # CENTROIDS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, graph, top = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                extra = np.zeros(len(v)) if asking else np.sqrt(np.maximum(top - (v**2).sum(1), 0))
                x = np.hstack([v, extra[:, None]])
                order, d = all_centroids(x, c) if asking else search_graph(x, c, graph, BEAM)
                lists = list(order) if everywhere else chosen_lists(order, d) if asking else posting_lists(order, d, c)
                at = np.repeat(np.arange(len(v)), [len(x) for x in lists])
                data = pa.array([x.tobytes() for x in v], pa.binary())
                near = np.concatenate([np.arange(len(x)) < FIRST for x in lists])
                columns = [part.column("vec_id").take(pa.array(at)), pa.array(np.concatenate(lists).astype(np.int32)), data.take(pa.array(at)), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "list", "v", "near"])

    found = rows.select("vec_id", "v").mapInArrow(run, "id long, list int, v binary, near boolean")
    return found if asking else found.drop("near")


def best_of_block(k: int):
    def run(key: tuple, queries: pa.Table, members: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and members.num_rows:
            ids = members.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = np.stack([np.frombuffer(b) for b in members.column("v").to_pylist()])[order]
            q_ids = queries.column("id").to_numpy()
            q = np.stack([np.frombuffer(b) for b in queries.column("v").to_pylist()])
            floors, floor_ids = queries.column("floor").to_numpy(), queries.column("floor_id").to_numpy()
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                s[q_ids[a : a + 256, None] == ids] = -np.inf
                keep = min(k, len(ids))
                least = np.maximum(np.partition(s, len(ids) - keep, axis=1)[:, len(ids) - keep], floors[a : a + 256])
                for i, (row, low) in enumerate(zip(s, least, strict=True)):
                    at = np.flatnonzero((row >= low - 1e-9 * max(1.0, abs(low))) & (row > -np.inf))
                    exact = (x[at] * q[a + i]).sum(1)  # the same value for equal vectors, whatever the block
                    best = np.argsort(-exact, kind="stable")[:keep]
                    at, exact = at[best], exact[best]
                    before = (exact > floors[a + i]) | ((exact == floors[a + i]) & (ids[at] < floor_ids[a + i]))
                    out.append((np.full(before.sum(), q_ids[a + i]), ids[at[before]], exact[before]))
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        parts = [np.concatenate(p) for p in zip(*(out or none), strict=True)]
        return pa.table(parts, ["query_id", "vec_id", "score"])

    return run


def _searched(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each block of the lists that each query reads, as far as they come before (floor, floor_id)."""
    asked = queries.groupBy("list").agg(F.count("*").alias("q"))
    blocks = sizes.join(asked, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = queries.join(blocks, "list").withColumn("qb", mine("q_blocks")).withColumn("b", every("blocks"))
    p = postings.join(blocks, "list").withColumn("b", mine("blocks")).withColumn("qb", every("q_blocks"))
    keys = ("list", "b", "qb")
    cols = [*keys, "id", "v"]
    return q.select(*cols, "floor", "floor_id").groupBy(*keys).cogroup(p.select(cols).groupBy(*keys)).applyInArrow(best_of_block(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector that fulfils ``is_query`` (a condition on vec_id)."""
    rows = cut_lineage(usable(vectors))
    index = fit_index(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    postings = cut_lineage(_assign(rows, index, asking=False))
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"))
    asking = rows.filter(is_query)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(asked: DataFrame) -> DataFrame:
        """Top ``k`` over all lists that ``asked`` reads."""
        none = {"floor": F.lit(float("-inf")), "floor_id": F.lit(-1).cast("long")}
        first = cut_lineage(ranked(_searched(asked.filter("near").withColumns(none), postings, sizes, k)))
        kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
        rest = asked.filter("NOT near").join(kth, "id", "left").withColumns({c: F.coalesce(c, none[c]) for c in none})
        return cut_lineage(ranked(first.drop("rank").unionByName(_searched(rest, postings, sizes, k))))

    best = searched(_assign(asking, index, asking=True))
    wanted = min(k, rows.count() - 1)
    short = cut_lineage(
        asking.join(best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found")), "vec_id", "left")
        .filter(F.coalesce("found", F.lit(0)) < wanted).select("vec_id", "v")
    )
    if short.isEmpty():
        return best
    again = searched(_assign(short, index, asking=True, everywhere=True))
    return best.join(short, best["query_id"] == short["vec_id"], "left_anti").union(again)


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_vector_search": op6_vector_search}
