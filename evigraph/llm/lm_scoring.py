"""Language-model scores from a log-frequency Bloom filter.

Training: every token pair (the word before, the word) of the training texts is counted; a text ends with an
end token, which is also what the first word follows. A count is quantised to the number ``j`` of thresholds
``ceil(BASE ** i)`` it reaches, and the entries (pair, 1) .. (pair, j) go into a Bloom filter. The filter has
at most ``FILTER_BITS`` bits whatever the corpus; it is built in segments by the hash of the pair, each from
all its pairs, and only its bits come to the driver to be broadcast.

Scoring probes (pair, 1), (pair, 2), .. until one is missing; the threshold passed last is the pair's count,
never more than the true one but for a false positive. The probability interpolates with the unigram:
``(count + t(h) P1(w)) / (c(h) + t(h))`` as Witten and Bell do, with the number of distinct followers
``t(h) = c(h) ** beta``, ``beta`` being the one exponent for which these add up to the corpus' number of
distinct pairs. ``P1`` is the add-0.1 unigram that also gives the base score; its counts are exact: blocks of
documents ask for the counts of their distinct words, segments of the vocabulary answer.

When a segment's share of bits can't hold its entries at ``ENTRY_BITS``, its lowest thresholds are not stored
(its ``floor``). Pairs that such a segment holds at its floor or not at all are asked for like the words: blocks send
them with their own counts, segments answer with the quantised totals. So every pair has the count it would have in
a filter without a limit, and the size of the broadcast stays fixed. Segments follow the bytes of text, which bounds
what one task holds.

Tasks combine counts before the shuffle and send a word or pair once, so hot words cost nothing; words and
pairs are 64-bit hashes. Defined results: a null text is empty and has one token, the end; a row with a null
id is not learned from and is held out; repeated rows count as often as they occur. Without training texts
N and V are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import words as wd
from evigraph.llm.tables import fold_of, read, shuffle_partitions

FILTER_BITS = 1 << 29      # 64 MB
ENTRY_BITS, MOST_BITS = 8, 12
BASE = 1.5
PROBES = 4                 # bits of an entry, all in one word of the filter
PIECE_BYTES = 8 << 20      # of text counted at a time
BLOCK_BYTES = 6 << 20      # of text scored at a time
SEGMENT_BYTES = 24 << 20   # of text a segment of words and pairs stands for at most
END = np.uint64(0x5851F42D4C957F2D)
LOW = np.uint64((1 << 48) - 1)
THRESHOLDS = np.unique(np.ceil(BASE ** np.arange(100)).astype(np.int64))


class Filter(NamedTuple):
    words: np.ndarray     # 64 bits each, segments one after another
    starts: np.ndarray    # first word of each segment
    sizes: np.ndarray     # words of each segment
    floors: np.ndarray    # first stored threshold


class Model(NamedTuple):
    filter: Filter
    tokens: int
    distinct: int
    beta: float


def token_sequence(texts: pa.Array, hasher: wd.WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and its end token, and where each text starts."""
    found, starts = hasher(texts)
    out = np.full(len(found) + len(starts) - 1, END, np.uint64)
    out[np.arange(len(found)) + np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = found
    return out, starts + np.arange(len(starts))


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[END], tokens[:-1]])
    return wd.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Six bytes a key (its segment is known), then the counts."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + counts.astype("<u4").tobytes()


def packed_ones_first(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Like ``packed``, but counts of one are not written."""
    more = counts > 1
    head = np.array([(~more).sum()], "<i8").tobytes()
    return head + packed(keys[~more], counts[:0]) + packed(keys[more], counts[more])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
    return wide.view("<u8").ravel().astype(np.uint64), np.frombuffer(blob, "<u4", n, 6 * n).astype(np.int64)


def unpacked_ones_first(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ones = int(np.frombuffer(blob, "<i8", 1)[0])
    wide = np.zeros((ones, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * ones, 8).reshape(ones, 6)
    keys, counts = unpacked(blob[8 + 6 * ones :])
    return np.concatenate([wide.view("<u8").ravel().astype(np.uint64), keys]), np.concatenate([np.ones(ones, np.int64), counts])


def packed_by_count(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Like ``packed_ones_first``, with the keys of count zero in front."""
    none = counts == 0
    return np.array([none.sum()], "<i8").tobytes() + packed(keys[none], counts[:0]) + packed_ones_first(keys[~none], counts[~none])


def unpacked_by_count(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    none = int(np.frombuffer(blob, "<i8", 1)[0])
    wide = np.zeros((none, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * none, 8).reshape(none, 6)
    keys, counts = unpacked_ones_first(blob[8 + 6 * none :])
    return np.concatenate([wide.view("<u8").ravel().astype(np.uint64), keys]), np.concatenate([np.zeros(none, np.int64), counts])


def dealt(keys: np.ndarray, counts: np.ndarray, segments: int, pack) -> Iterator[tuple[int, bytes]]:
    """(segment, blob) of ascending keys; segments ascend with them."""
    seg = segment_of(keys, segments)
    cuts = np.flatnonzero(np.diff(seg)) + 1
    for part in np.split(np.arange(len(keys)), cuts):
        if len(part):
            yield int(seg[part[0]]), pack(keys[part], counts[part])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


# --- training ---------------------------------------------------------------------------------------


def count_pieces(texts: DataFrame, segments: int) -> DataFrame:
    """segment, kind (0 words, 1 pairs), blob of counts of one piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher()
        for batch in wd.pieces(batches, limit=PIECE_BYTES):
            tokens, _ = token_sequence(batch.column("text"), hasher)
            rows: list[tuple[int, int, bytes]] = []
            for kind, found, pack in ((0, tokens, packed), (1, pair_hashes(tokens), packed_ones_first)):
                keys, counts = np.unique(found, return_counts=True)
                rows += [(s, kind, blob) for s, blob in dealt(keys, counts, segments, pack)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()))], ["segment", "kind", "blob"])

    return texts.select("text").mapInArrow(run, "segment int, kind int, blob binary")


def entry_words(low: np.ndarray, level, size) -> tuple[np.ndarray, np.ndarray]:
    """Word inside a segment of ``size`` words and mask of the entry (key, level): all its bits lie in one word."""
    g = wd.mix(low * np.uint64(0xD1342543DE82EF95) + np.asarray(level, np.uint64))
    mask = np.zeros(len(g), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    return ((g >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64), mask


def build_segment(low: np.ndarray, counts: np.ndarray, share: int) -> tuple[bytes, int, int]:
    """Words, their number and floor of one segment that may use ``share`` bits."""
    classes = np.searchsorted(THRESHOLDS, counts, side="right")
    held = np.bincount(classes, minlength=len(THRESHOLDS) + 1)
    at_least = np.cumsum(held[::-1])[::-1]  # pairs of a class or more; index is the class
    entries = np.cumsum(at_least[:0:-1])[::-1]  # entries if stored from class i + 1 on
    fits = np.flatnonzero(entries * ENTRY_BITS <= max(share, 64))
    floor = int(fits[0]) + 1 if len(fits) else len(THRESHOLDS) + 1
    n = int(entries[floor - 1]) if floor <= len(entries) else 0
    words = np.zeros(max(1, min(share, n * MOST_BITS) // 64), np.uint64)
    for level in range(floor, int(classes.max(initial=0)) + 1):
        at, mask = entry_words(low[classes >= level], level, len(words))
        np.bitwise_or.at(words, at, mask)
    return words.tobytes(), len(words), floor


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def segments_for(spark: SparkSession, size: int) -> int:
    return max(shuffle_partitions(spark), -(-size // SEGMENT_BYTES))


def fit_model(texts: DataFrame, filter_bits: int = FILTER_BITS) -> Model:
    """Model of all rows of ``texts`` (text)."""
    segments = segments_for(texts.sparkSession, text_bytes(texts))
    share = max(64, filter_bits // segments)

    def merge(table: pa.Table) -> pa.Table:
        kind, blobs, segment = table.column("kind").to_pylist(), table.column("blob").to_pylist(), table.column("segment")[0].as_py()
        words = [unpacked(b) for k, b in zip(kind, blobs, strict=True) if k == 0]
        pairs = [unpacked_ones_first(b) for k, b in zip(kind, blobs, strict=True) if k == 1]
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, of_word = summed(*[np.concatenate(x) for x in zip(none, *words, strict=True)])
        low, of_pair = summed(*[np.concatenate(x) for x in zip(none, *pairs, strict=True)])
        size_class = np.log2(np.maximum(of_word, 1)).astype(np.int64)
        data, size, floor = build_segment(low, of_pair, share)
        return pa.table(
            [[segment], [len(of_word)], [len(low)], [np.bincount(size_class, minlength=64).tolist()], [np.bincount(size_class, of_word, minlength=64).astype(np.int64).tolist()], [data], [size], [floor]],
            ["segment", "words", "pairs", "n_class", "sum_class", "data", "size", "floor"],
        )

    schema = "segment long, words long, pairs long, n_class array<long>, sum_class array<long>, data binary, size long, floor long"
    # At most FILTER_BITS and a few numbers per segment.
    rows = count_pieces(texts, segments).groupBy("segment").applyInArrow(merge, schema).toArrow().to_pylist()
    sizes, floors = np.ones(segments, np.int64), np.ones(segments, np.int64)
    data = {r["segment"]: r["data"] for r in rows}
    for r in rows:
        sizes[r["segment"]], floors[r["segment"]] = r["size"], r["floor"]
    words = np.frombuffer(b"".join(data.pop(s, bytes(8)) for s in range(segments)), np.uint64)
    n_class = np.sum([r["n_class"] for r in rows], axis=0) if rows else np.zeros(64)
    sum_class = np.sum([r["sum_class"] for r in rows], axis=0) if rows else np.zeros(64)
    return Model(
        Filter(words, np.cumsum(sizes) - sizes, sizes, floors), int(np.sum(sum_class)), sum(r["words"] for r in rows),
        follower_exponent(n_class, sum_class, sum(r["pairs"] for r in rows)),
    )


def follower_exponent(n_class: np.ndarray, sum_class: np.ndarray, pairs: int) -> float:
    """The exponent for which the words' ``count ** beta`` add up to the number of distinct pairs."""
    used = n_class > 0
    n, mean = n_class[used], sum_class[used] / n_class[used]
    low, high = 0.0, 1.0
    for _ in range(50):
        beta = (low + high) / 2
        low, high = (beta, high) if (n * mean**beta).sum() < pairs else (low, beta)
    return (low + high) / 2


# --- scoring ----------------------------------------------------------------------------------------


def probe_counts(f: Filter, pairs: np.ndarray) -> np.ndarray:
    """Quantised count of each pair: probes of rising thresholds until one is missing."""
    seg, low = segment_of(pairs, len(f.sizes)), pairs & LOW
    count = np.zeros(len(pairs), np.int64)
    level = f.floors[seg]
    left = np.flatnonzero(level <= len(THRESHOLDS))
    while len(left):
        s = seg[left]
        at, mask = entry_words(low[left], level[left], f.sizes[s])
        at += f.starts[s]
        left = left[(f.words[at] & mask) == mask]
        count[left] = THRESHOLDS[level[left] - 1]
        level[left] += 1
        left = left[level[left] <= len(THRESHOLDS)]
    return count


def unheld_pairs(f: Filter, tokens: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, of segments with a raised floor that are not held above it, and how often each is learned here.

    Those at the floor belong to them, because a single false entry may have lifted them there.
    """
    pairs, at = np.unique(pair_hashes(tokens), return_inverse=True)
    floors = f.floors[segment_of(pairs, len(f.sizes))]
    asked = floors > 1
    least = np.append(THRESHOLDS, THRESHOLDS[-1])[floors[asked] - 1]
    asked[asked] = probe_counts(f, pairs[asked]) <= least
    return pairs[asked], np.bincount(at[learned], minlength=len(pairs))[asked]


def quantised(counts: np.ndarray) -> np.ndarray:
    """Number of thresholds reached, as a byte."""
    return np.searchsorted(THRESHOLDS, counts, side="right").astype(np.uint8)


def ordered_words(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, ascending, and the place of each token among them."""
    return np.unique(tokens, return_inverse=True)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text, learned).

    ``learned`` rows are those the model was fitted on; their words are the counts of the base score.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tuple(model.filter), *model[1:]))  # FILTER_BITS at most
    size = text_bytes(docs)
    segments = segments_for(spark, size)
    blocks = max(1, -(-size // BLOCK_BYTES))
    full = bool((model.filter.floors > 1).any())
    dealt_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "learned", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        tokens, starts = token_sequence(pa.concat_arrays(table.column("text").chunks), wd.WordHasher())
        learned = np.repeat(table.column("learned").to_numpy(), np.diff(starts))
        keys, at = ordered_words(tokens)
        counts = np.bincount(at[learned], minlength=len(keys))
        rows = [(s, 0, blob) for s, blob in dealt(keys, counts, segments, packed)]
        if full:
            rows += [(s, 1, blob) for s, blob in dealt(*unheld_pairs(Filter(*shared.value[0]), tokens, learned), segments, packed_by_count)]
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            ["segment", "kind", "block", "blob"],
        )

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        parts = [(unpacked_by_count if kind else unpacked)(b) for b in table.column("blob").to_pylist()]
        keys, totals = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        reply = quantised(totals) if kind else totals.astype("<u8")
        # Pairs come in order of their counts and go back in order of what is sent of their hashes.
        replies = [reply[np.searchsorted(keys, np.sort(p[0]) if kind else p[0])].tobytes() for p in parts]
        return pa.table([table.column("block"), table.column("segment"), table.column("kind"), pa.array(replies, pa.binary())], ["block", "segment", "kind", "blob"])

    def replied(replies: pa.Table, kind: int, dtype: str) -> np.ndarray:
        mine = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("segment")
        return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(b, dtype) for b in mine.column("blob").to_pylist()]])

    def score(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = shared.value
        m = Model(Filter(*parts[0]), *parts[1:])
        tokens, starts = token_sequence(pa.concat_arrays(table.column("text").chunks), wd.WordHasher())
        keys, at = ordered_words(tokens)
        totals = replied(replies, 0, "<u8").astype(np.float64)
        count = totals[at]
        unigram = (count + 0.1) / (m.tokens + 0.1 * (m.distinct + 1))
        before = np.concatenate([[0.0], count[:-1]])
        before[starts[:-1]] = totals[np.searchsorted(keys, END)]
        follows = np.where(before > 0, before**m.beta, 1.0)
        hashes = pair_hashes(tokens)
        pairs = probe_counts(m.filter, hashes)
        if full:
            asked, _ = unheld_pairs(m.filter, tokens, np.zeros(len(tokens), bool))
            exact = np.zeros(len(asked), np.int64)
            exact[np.lexsort((asked & LOW, segment_of(asked, segments)))] = np.concatenate([[0], THRESHOLDS])[replied(replies, 1, "u1")]
            place = np.searchsorted(asked, hashes)
            known = np.flatnonzero(place < len(asked))
            known = known[asked[place[known]] == hashes[known]]
            pairs[known] = exact[place[known]]
        pairs = np.minimum(pairs, before)
        log_p = np.log10((pairs + follows * unigram) / (before + follows))
        first = starts[:-1]
        n = len(first)
        return pa.table(
            [table.column("doc_id"), table.column("learned"), pa.array(np.diff(starts)), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(n, m.tokens)),
             pa.array(np.add.reduceat(np.log10(unigram), first)), pa.array(np.add.reduceat(log_p, first))],
            ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = dealt_docs.groupBy("block").applyInArrow(ask, "segment int, kind int, block long, blob binary")
    answered = asked.groupBy("segment", "kind").applyInArrow(answer, "block long, segment int, kind int, blob binary")
    out = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt_docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, out)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold_of(F.col("doc_id"), 10) != 0, F.lit(False)).alias("learned"))
    model = fit_model(docs.filter("learned"))
    found = score_documents(docs, model)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
