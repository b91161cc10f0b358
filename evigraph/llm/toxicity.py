"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words (between ASCII marks and white space), hashed to ``DIM`` places. The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: beside the additive weights, every pair of terms has an
interaction through the ``K`` factors of its terms, so an insult beside a mention of a group weighs
otherwise than either of them alone.

The model is fitted on a bounded sample: ``SAMPLE`` labelled documents a class, those with the smallest hash of
their id; a histogram of the hashes leaves little more than the sample to rank. Only their hashed terms come to the driver. Terms
in fewer than ``MIN_SHARE`` of the sample have no weight. Scoring is one pass over whole texts without a
shuffle; the model (``DIM`` x (``K`` + 1) floats at most) is broadcast in its kept rows.

Defined results: a null or wordless text has the score of the intercept; several labels of a document
count as the highest; without labels of both classes every score is the share of toxic labels (0.5
without labels). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm import words as wd
from evigraph.llm.tables import fold_of, read

DIM = 1 << 18
K = 8
SAMPLE = {1: 4_000, 0: 12_000}  # documents a class
BIN_BITS = 16  # of the hashes that choose them
MIN_SHARE, MIN_DOCS = 0.0025, 5
EPOCHS, BATCH, RATE, L2 = 10, 256, 0.1, 1e-3
THRESHOLD = 0.5


class Machine(NamedTuple):
    bias: float
    row: np.ndarray      # place to row of weights, 0 for terms without weight
    weight: np.ndarray
    factors: np.ndarray


def term_sets(texts: pa.Array, hasher: wd.WordHasher, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each text's terms, and where each text's start."""
    found, starts = hasher(pc.utf8_lower(texts))
    place = (found % np.uint64(dim)).astype(np.int64)
    keys = np.sort(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * dim + place)
    keys = keys[np.diff(keys, prepend=-1) != 0]
    return keys % dim, np.searchsorted(keys, np.arange(len(starts)) * dim)


def sampled_ids(labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of the ``sample`` documents a class with the smallest (hash, id).

    A histogram of the hashes, combined map-side, tells the range that holds them: at most 2^16 counts a class are
    summed up in one task, and only the rows of that range, the sample and a part of one bin, are ranked.
    """
    labelled = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_h", F.xxhash64("doc_id")).withColumn("_bin", F.shiftright("_h", 64 - BIN_BITS))
    )
    limit = F.when(F.col("toxic") == 1, sample[1]).otherwise(sample[0])
    upto = W.partitionBy("toxic").orderBy("_bin")
    last = (
        labelled.groupBy("toxic", "_bin").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(upto) - F.col("n")).filter(F.col("before") < limit)
        .groupBy("toxic").agg(F.max("_bin").alias("_last"))
    )
    order = W.partitionBy("toxic").orderBy("_h", "doc_id")
    near = labelled.join(F.broadcast(last), "toxic").filter("_bin <= _last")  # two rows
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).select("doc_id", "toxic")


def sampled_terms(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> list[tuple[int, np.ndarray]]:
    """(label, places) of the sampled labelled documents; the fold to learn from is the caller's choice of ``labels``."""
    chosen = sampled_ids(labels, sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher(wd.MARKS)
        for batch in wd.pieces(batches):
            places, starts = term_sets(batch.column("text"), hasher)
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), places.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "terms"])

    # The chosen ids are at most the sum of SAMPLE.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = rows.mapInArrow(terms, "doc_id long, toxic int, terms array<int>").toArrow()
    if not got.num_rows:
        return []
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    lists, label = got.column("terms").combine_chunks(), got.column("toxic").to_numpy()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    return [(int(y), flat[a:b]) for y, a, b in zip(label, at[:-1] - at[0], at[1:] - at[0], strict=True)]


def fit(sample: list[tuple[int, np.ndarray]], dim: int = DIM, k: int = K, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, minibatches in a seeded order."""
    y = np.array([label for label, _ in sample], np.float32)
    places = [p for _, p in sample]
    docs_of = np.bincount(np.concatenate(places), minlength=dim) if places else np.zeros(dim, np.int64)
    kept = np.flatnonzero(docs_of >= max(MIN_DOCS, MIN_SHARE * len(sample)))
    row = np.zeros(dim, np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept) + 1, np.float32), rng.normal(0, 0.02, (len(kept) + 1, k)).astype(np.float32)
    v[0] = 0
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias, sum_b = float(np.log(share / (1 - share))), 1e-3
    if len(set(y.tolist())) < 2:
        return Machine(bias, row, w, np.zeros_like(v))
    sum_w, sum_v = np.full_like(w, 1e-3), np.full_like(v, 1e-3)
    terms = [r[r > 0] for r in (row[p] for p in places)]
    usable = np.array([i for i, t in enumerate(terms) if len(t)], np.int64)
    for _ in range(EPOCHS if len(usable) else 0):
        order = rng.permutation(usable)
        for chosen in np.split(order, range(BATCH, len(order), BATCH)):
            rows = [terms[i] for i in chosen]
            n = np.array([len(t) for t in rows])
            j, starts = np.concatenate(rows), np.cumsum(n) - n
            vj = v[j]
            total = np.add.reduceat(vj, starts)
            z = bias + np.add.reduceat(w[j], starts) + 0.5 * (total**2 - np.add.reduceat(vj**2, starts)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)).astype(np.float32)
            gj = np.repeat(g, n)
            used, at = np.unique(j, return_inverse=True)
            dw = np.bincount(at, gj, len(used)) + L2 * w[used]
            dv = np.stack([np.bincount(at, gj * (np.repeat(total[:, c], n) - vj[:, c]), len(used)) for c in range(k)], 1) + L2 * v[used]
            sum_w[used] += dw**2
            w[used] -= RATE * dw / np.sqrt(sum_w[used])
            sum_v[used] += dv**2
            v[used] -= 0.3 * RATE * dv / np.sqrt(sum_v[used])
            sum_b += float(g.sum()) ** 2
            bias -= RATE * float(g.sum()) / sum_b**0.5
    w[0], v[0] = 0, 0
    return Machine(bias, row, w, v)


def margins(machine: Machine, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Value of the machine before the sigmoid for each text."""
    row = machine.row[places]
    used = row > 0
    starts = np.concatenate([[0], np.cumsum(used)])[starts]
    row = row[used]
    z = np.full(len(starts) - 1, machine.bias)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        at = starts[some]
        vj = machine.factors[row]
        total = np.add.reduceat(vj, at, dtype=np.float64)
        z[some] += np.add.reduceat(machine.weight[row], at, dtype=np.float64) + 0.5 * (total**2 - np.add.reduceat(vj.astype(np.float64) ** 2, at)).sum(1)
    return z


def machine_of(parts: tuple) -> Machine:
    """Broadcasts hold plain tuples: workers need no copy of this package."""
    return Machine(*parts)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(sampled_terms(docs, labels))


def score_documents(docs: DataFrame, machine: Machine, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` (with text) and the score in column ``name``, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))
    kept = [f for f in docs.schema.fields if f.name != name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher(wd.MARKS)
        for batch in wd.pieces(batches):
            z = margins(machine_of(shared.value), *term_sets(batch.column("text"), hasher))
            columns = [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name])

    return docs.select([f.name for f in kept]).mapInArrow(score, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; learned from the labels of ``docs``."""
    machine = train(docs, learning_labels(labels))
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, machine, name).filter(F.col(name) < threshold).select(docs.columns)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents to learn from: fold 0 of 5 is held out."""
    return labels.filter(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, learning_labels(read(spark, sf_dir, "labels")))
    # Ids beside the text only pass through; columns are dropped before, so Python gets id and text.
    found = score_documents(docs, machine)
    score = F.col("toxic_score")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
