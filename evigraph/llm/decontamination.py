"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of all test items are looked for in all texts (a bit map of fixed size spares the other
   n-grams; the join decides) and get their document frequency. Seeds of an item are its rarer half,
   and every n-gram below a small share of the documents, so each item keeps seeds and phrases of
   function words do not ask for alignments.
2. Stretches of texts around seeds become passages; equal passages are one. Passages and items meet on
   seeds in an equi join.
3. Around the diagonals of their seeds, passage and item are aligned word by word (match 1, mismatch and
   gap -0.5). The score is the best local alignment divided by the item's words: 1 for a whole copy,
   and well above the threshold for copies with changed, added or missing words.

Hot cases: a passage that thousands of documents share is aligned once; frequencies combine before the
shuffle; a task holds one piece of text or the seeds of one passage.

Defined results: null texts have no words; items with fewer than ``N`` words have no seeds and match
nothing; repeated rows of an item or a document give one row per pair. Words are lower-cased runs of
letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import words as wd
from evigraph.llm.tables import read
from evigraph.session import cut_lineage

N = 3
MAP_WORDS = 1 << 20      # 64-bit words of a bit map, 8 MB
RARE_SHARE = 1e-4        # an n-gram in no more of the documents is a seed in any case
MISMATCH, GAP = 0.5, 0.5
THRESHOLD = 0.5          # of an item's words
LEAST_WORDS = 6          # matched words, or the whole item if it is shorter
MASK = np.uint64((1 << 63) - 1)


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, words (hashes, as bytes), n_words, grams array<long> for every item that has seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher(wd.MARKS)
        for batch in wd.pieces(batches):
            found, starts = hasher(pc.utf8_lower(batch.column("text")))
            grams, begin = wd.ngram_hashes(found, starts, N)
            rows = [found[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(begin.astype(np.int32), (grams & MASK).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, pa.binary()), pa.array(np.diff(starts).astype(np.int32)), lists], ["item_id", "words", "n_words", "grams"])

    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.min("text").alias("text"))
    return rows.mapInArrow(run, "item_id long, words binary, n_words int, grams array<long>").filter(F.size("grams") > 0)


def bit_map(grams: DataFrame) -> np.ndarray:
    """Map of a column of n-grams: at most ``MAP_WORDS`` rows come to the driver."""
    place = F.col("gram").bitwiseAND(MAP_WORDS * 64 - 1)
    rows = grams.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(gram & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(MAP_WORDS, np.int64)
    if rows.num_rows:
        bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def _hits(batch: pa.RecordBatch, hasher: wd.WordHasher, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their starts, and the n-grams in the map: text, first word, n-gram."""
    found, starts = hasher(pc.utf8_lower(batch.column("text")))
    grams, begin = wd.ngram_hashes(found, starts, N)
    grams = (grams & MASK).astype(np.int64)
    place = grams & (MAP_WORDS * 64 - 1)
    at = np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
    text = np.searchsorted(begin, at, side="right") - 1
    return found, starts, text, starts[text] + at - begin[text], grams[at]


def gram_frequencies(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """gram, df: in how many rows of ``docs`` an n-gram of the map occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher(wd.MARKS)
        for batch in wd.pieces(batches):
            _, _, text, _, gram = _hits(batch, hasher, shared.value)
            order = np.lexsort((text, gram))
            text, gram = text[order], gram[order]
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
            grams, n = np.unique(gram[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "df"])

    return docs.select("text").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def choose_seeds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """gram, item_id, places (array of word positions in the item)."""
    grams = items.select("item_id", F.posexplode("grams").alias("place", "gram"))
    frequency = gram_frequencies(docs, bit_map(grams.select("gram").distinct()))
    known = grams.groupBy("gram", "item_id").agg(F.collect_list("place").alias("places")).join(frequency, "gram")
    known = cut_lineage(known)
    rows = docs.agg(F.count(F.lit(1))).scalar()
    half = known.groupBy("item_id").agg(F.percentile("df", F.lit(0.5)).alias("half"))
    return known.join(half, "item_id").filter(F.col("df") <= F.greatest(F.col("half"), rows * RARE_SHARE)).select("gram", "item_id", "places")


def seeded_passages(docs: DataFrame, bits: np.ndarray, reach: int) -> DataFrame:
    """doc_id, name, words, grams, at: stretches of texts with seeds, ``reach`` words to either side."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = wd.WordHasher(wd.MARKS)
        for batch in wd.pieces(batches):
            found, starts, text, word, gram = _hits(batch, hasher, shared.value)
            if not len(gram):
                continue
            apart = np.flatnonzero((np.diff(text) != 0) | (np.diff(word) > reach)) + 1
            first, last = np.concatenate([[0], apart]), np.concatenate([apart, [len(gram)]]) - 1
            owner = text[first]
            low = np.maximum(word[first] - reach, starts[owner])
            high = np.minimum(word[last] + N + reach, starts[owner + 1])
            rows = [found[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            cuts = np.append(first, len(gram)).astype(np.int32)
            at = (word - np.repeat(low, last - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array([xxhash.xxh3_64_intdigest(r) >> 1 for r in rows], pa.int64()), pa.array(rows, pa.binary()),
                 pa.ListArray.from_arrays(cuts, gram), pa.ListArray.from_arrays(cuts, at)],
                ["doc_id", "name", "words", "grams", "at"],
            )

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, name long, words binary, grams array<long>, at array<int>")


def local_scores(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each window with its item, all together: one step per item word."""
    wide, deep = max(map(len, windows)), max(map(len, items))
    w, t = np.zeros((len(windows), wide), np.uint64), np.ones((len(items), deep), np.uint64)
    for i, (x, y) in enumerate(zip(windows, items, strict=True)):
        w[i, : len(x)], t[i, : len(y)] = x, y
    best = np.zeros(len(windows), np.float32)
    row = np.zeros((len(windows), wide + 1), np.float32)
    slope = GAP * np.arange(wide + 1, dtype=np.float32)
    for i in range(deep):
        step = np.where(w == t[:, i : i + 1], np.float32(1), np.float32(-MISMATCH))
        new = np.maximum(row - GAP, 0)
        np.maximum(new[:, 1:], row[:, :-1] + step, out=new[:, 1:])
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the window
        np.maximum(best, row.max(axis=1), out=best)
    return best


def seed_windows(diagonals: np.ndarray, n_item: int, n_passage: int) -> list[tuple[int, int]]:
    """Ranges of the passage around the diagonals; long ones in overlapping steps that hold any alignment."""
    slack = n_item // 2 + 8
    found: list[list[int]] = []
    for d in np.unique(diagonals).tolist():
        low, high = max(0, d - slack), min(n_passage, d + n_item + slack)
        if found and low <= found[-1][1]:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    span = 3 * n_item
    return [(a, min(a + 2 * span, high)) for low, high in found for a in range(low, max(low + 1, high - span), span)]


def aligned(pairs: DataFrame) -> DataFrame:
    """name, item_id, score, matched of (name, item_id, words, item_words, diagonals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs: list[tuple[int, np.ndarray, np.ndarray]] = []
            for k, (words, item, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "diagonals")), strict=True)):
                passage, item = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                jobs += [(k, passage[a:b], item) for a, b in seed_windows(np.array(diagonals), len(item), len(passage))]
            jobs.sort(key=lambda j: (len(j[1]), len(j[2])))
            best = np.zeros(batch.num_rows, np.float32)
            for at in range(0, len(jobs), 128):
                part = jobs[at : at + 128]
                scores = local_scores([j[1] for j in part], [j[2] for j in part])
                np.maximum.at(best, [j[0] for j in part], scores)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("item_id"), pa.array(best.astype(np.float64))], ["name", "item_id", "aligned"])

    return pairs.mapInArrow(run, "name long, item_id long, aligned double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (share of the item's words, 0 to 1) of all pairs at or above ``threshold``."""
    items = cut_lineage(item_grams(benchmark))
    seeds = cut_lineage(choose_seeds(items, docs))
    reach = items.agg(F.max("n_words")).first()[0] or 0
    found = cut_lineage(seeded_passages(docs, bit_map(seeds.select("gram").distinct()), 2 * reach))
    passages = found.groupBy("name").agg(F.min(F.struct("words", "grams", "at")).alias("p")).select("name", "p.*")
    hits = passages.select("name", F.explode(F.arrays_zip("grams", "at")).alias("h")).select("name", F.col("h.grams").alias("gram"), F.col("h.at").alias("at"))
    diagonals = hits.join(seeds, "gram").select("name", "item_id", F.explode(F.transform("places", lambda p: F.col("at") - p)).alias("d"))
    pairs = diagonals.groupBy("name", "item_id").agg(F.collect_set("d").alias("diagonals"))
    whole = pairs.join(passages.select("name", "words"), "name").join(items.select("item_id", F.col("words").alias("item_words"), "n_words"), "item_id")
    scored = aligned(whole.select("name", "item_id", "words", "item_words", "diagonals")).join(items.select("item_id", "n_words"), "item_id")
    least = F.least(F.lit(float(LEAST_WORDS)), F.col("n_words").cast("double"))
    leaks = scored.withColumn("score", F.col("aligned") / F.col("n_words")).filter((F.col("score") >= threshold) & (F.col("aligned") >= least))
    return found.select("doc_id", "name").join(leaks, "name").groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null id stay."""
    gone = cut_lineage(find_leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
