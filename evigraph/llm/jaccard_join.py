"""N-gram Jaccard join by a size-aware heavy-light split, and the groups its links make.

A document is the set of its distinct 5-word shingles (64-bit hashes). Copies of one set are one class.
All sets share one order of the shingles: rare ones first, frequent ones last. Two sets that reach the
threshold share k shingles among the first ``size - overlap + k`` of each, so:

* small sets enumerate the fixed-size subsets (two shingles) of that prefix as keys and meet on equal subsets;
* large sets enter the single shingles of their prefix (k = 1) into inverted lists and meet on the lists.
  Small sets close to the boundary enter the lists as well, so pairs across the boundary meet;
* the boundary is the size with the least cost, entries plus meetings, counted over all sets.

Keys are dealt to segments by their hash. Short lists yield their pairs, long lists the pairs of a few
pivots; both are filtered by size. A pair survives if an upper bound of its overlap (histograms of the
two sets) allows the threshold, and links if the exact sets do. Long lists that still hold several
components afterwards compare the members of different components, block by block, with the same bound
and the same exact check: nothing is capped, and no list yields the pairs inside a component.

Frequent shingles only steer the order; any order gives the same links. Skew: copies collapse to a class
before the index, keys are hashes and every task adds a set once a key, so a group with a third of all
rows costs each task one set. Lineage is cut by reliable checkpoints.

Defined results: null texts and texts without words have an empty set and no links, also with each
other. A text with fewer than five words has one shingle, the whole sequence. Rows with a null id have no
component. Rows that repeat an id are one node; ``n_shingles`` is that of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import words as wd
from evigraph.llm.graph import components
from evigraph.llm.tables import read, shuffle_partitions
from evigraph.session import cut_lineage

N = 5
PERCENT = 80
SLOTS = 1 << 22       # places of the order table: one byte each
LOCAL_DF = 3          # a shingle in so many sets of a task's piece is reported as frequent
SHORT_LIST = 32       # lists up to this length yield all their pairs of fitting size
PIVOTS = 2            # of each size class in longer lists
BLOCK = 4096          # members of a block of a long list
PIECE_BYTES = 16 << 20  # of text whose sets are counted and indexed together
SEGMENT_BYTES = 24 << 20  # of text a segment of the index stands for: one is held by a task
SMALL = 64            # sizes up to which subsets are considered at all
SIZE_STEP = 1.05      # ratio between size classes
MAP_WORDS = 1 << 20   # 64-bit words of the map of documents whose sets are fetched
DOC, SIGNATURE, PAIR, LIST = range(4)
OUT = "kind int, list long, a long, b long, n int, data binary"


def need(size: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of ``size`` with any partner."""
    return -(-percent * size // 100)


def piece_sets(texts: pa.Array, hasher: wd.WordHasher) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each text, and a hash of each set (0 if empty)."""
    grams, begin = wd.ngram_hashes(*hasher(texts), N, short=True)
    grams &= np.uint64((1 << 63) - 1)  # so that they are longs as well
    sets, names = [], np.zeros(len(begin) - 1, np.int64)
    for i, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        s = np.sort(grams[x:y])
        s = s[np.diff(s, prepend=np.uint64(1 << 63)) != 0]
        sets.append(s)
        if len(s):
            names[i] = _name(s)
    return sets, names


def _name(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def distinct_sets(sets: list[np.ndarray], names: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    seen = set()
    for s, name in zip(sets, names.tolist(), strict=True):
        if len(s) and name not in seen:
            seen.add(name)
            yield name, s


# --- the order of shingles, and the boundary --------------------------------------------------------


def _pair_keys(prefix: np.ndarray) -> np.ndarray:
    """Keys of all two-element subsets of the prefix, whatever its order."""
    i, j = np.triu_indices(len(prefix), 1)
    low, high = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
    return wd.mix(low * np.uint64(0x9E3779B97F4A7C15) + high) & np.uint64((1 << 63) - 1)


def frequent_and_costs(docs: DataFrame) -> DataFrame:
    """(shingle, n) of shingles frequent in a piece, and rows of counts for the boundary (negative sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher()
        for batch in wd.pieces(batches, limit=PIECE_BYTES):
            sets = list(distinct_sets(*piece_sets(batch.column("text"), hasher)))
            if not sets:
                continue
            shingles, n = np.unique(np.concatenate([s for _, s in sets]), return_counts=True)
            often = n >= LOCAL_DF
            keys, values = [shingles[often].astype(np.int64)], [n[often]]
            for size in range(4, SMALL + 1):  # smaller sets can only link to copies
                these = [s for _, s in sets if len(s) == size]
                if these:
                    over = size - need(size)
                    single = np.concatenate([s[: over + 1] for s in these])
                    paired = np.concatenate([_pair_keys(s[: over + 2]) for s in these])
                    for which, k in ((0, single), (1, paired)):
                        met = np.unique(k, return_counts=True)[1]
                        keys.append(np.array([-(2 * size + which)])), values.append(np.array([(met * met).sum()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values).astype(np.int64))], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def fit_order(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Order table (level by slot; 0 is rare) and the boundary, the largest size that enumerates subsets."""
    counted = cut_lineage(frequent_and_costs(docs))
    slot = F.shiftright("shingle", 63 - SLOTS.bit_length() + 1).cast("int")
    level = F.greatest(F.lit(1), F.floor(F.log2("n")) - 2).cast("int")
    # At most one row a slot, so at most SLOTS small rows.
    rows = counted.filter("shingle >= 0").groupBy(slot.alias("slot")).agg(F.max(level).alias("level")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    if rows.num_rows:
        table[rows.column("slot").to_numpy()] = np.minimum(rows.column("level").to_numpy(), 255)
    costs = {-r["shingle"]: r["n"] for r in counted.filter("shingle < 0").collect()}  # two rows a size up to SMALL
    best, boundary, total = 0, 0, 0
    for size in range(4, SMALL + 1):
        total += costs.get(2 * size + 1, 0) - costs.get(2 * size, 0)
        if total < best:
            best, boundary = total, size
    return table, boundary


# --- the index --------------------------------------------------------------------------------------


def signature(s: np.ndarray) -> bytes:
    """Histogram of the shingles over a power of two of bins; its elementwise minimum bounds an overlap from above."""
    bins = 64
    while bins < len(s):
        bins *= 2
    while True:
        counts = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bins *= 2


def size_class(size: int) -> int:
    return min(255, int(np.log(size) / np.log(SIZE_STEP)))


CLASS_GAP = int(np.log(100 / PERCENT) / np.log(SIZE_STEP)) + 1


def index_pieces(docs: DataFrame, table: np.ndarray, boundary: int, segments: int) -> DataFrame:
    """Rows dealt to segments: documents, one signature a set, and blobs of (key, set, size class)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # SLOTS bytes
    shift = np.uint64(63 - SLOTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, hasher = shared.value, wd.WordHasher()
        for batch in wd.pieces(batches, limit=PIECE_BYTES):
            sets, names = piece_sets(batch.column("text"), hasher)
            ids = batch.column("doc_id")
            seg = (wd.mix(ids.fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(segments)).astype(np.int32)
            nothing = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg), pa.array(np.full(len(ids), DOC, np.int32)), ids, pa.array(names), pa.array(np.array([len(s) for s in sets], np.int32)), nothing],
                ["segment", "kind", "a", "b", "n", "data"],
            )
            keys, owners, classes, sigs = [], [], [], []
            for name, s in distinct_sets(sets, names):
                size = len(s)
                if size < 4:
                    continue
                sigs.append((name % segments, SIGNATURE, None, name, size, signature(s)))
                level = level_of[s >> shift]
                ordered = s[np.argsort(level, kind="stable")] if level.any() else s
                over = size - need(size)
                own = []
                if size <= boundary:
                    own.append(_pair_keys(ordered[: over + 2]))
                if size >= need(boundary + 1) or size > boundary:
                    own.append(ordered[: over + 1])
                own = np.unique(np.concatenate(own))
                keys.append(own), owners.append(np.full(len(own), name, np.int64)), classes.append(np.full(len(own), size_class(size), np.uint8))
            if not sigs:
                continue
            key, owner, cls = np.concatenate(keys), np.concatenate(owners), np.concatenate(classes)
            # The segment comes from the high bits; six bytes of the mixed key tell keys of a segment apart.
            mixed = wd.mix(key)
            seg = ((mixed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            cuts = np.flatnonzero(np.diff(seg[order])) + 1
            rows = list(sigs)
            for part in np.split(order, cuts):
                low = mixed[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                blob = low.tobytes() + owner[part].astype("<i8").tobytes() + cls[part].tobytes()
                rows.append((int(seg[part[0]]), PAIR, None, None, len(part), blob))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.binary())],
                ["segment", "kind", "a", "b", "n", "data"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "segment int, kind int, a long, b long, n int, data binary")


def _unpacked(blobs: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, owners, classes = [], [], []
    for blob, n in zip(blobs, sizes, strict=True):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
        keys.append(wide.view("<u8").ravel())
        owners.append(np.frombuffer(blob, "<i8", n, 6 * n))
        classes.append(np.frombuffer(blob, np.uint8, n, 14 * n))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(classes)


def _list_pairs(own: np.ndarray, cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """(a, b) arrays of the candidates of all lists, sizes fitting; members of a list are sorted by size class."""
    for length in np.unique(lengths[lengths <= SHORT_LIST]):
        at = starts[lengths == length][:, None] + np.arange(length)
        i, j = np.triu_indices(length, 1)
        a, b = at[:, i].ravel(), at[:, j].ravel()
        fit = cls[b].astype(np.int32) - cls[a] <= CLASS_GAP
        yield np.stack([own[a[fit]], own[b[fit]]])
    for start, length in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist(), strict=True):
        o, c = own[start : start + length], cls[start : start + length].astype(np.int32)
        for value in np.unique(c):
            reach = slice(np.searchsorted(c, value), np.searchsorted(c, value + CLASS_GAP, side="right"))
            for pivot in range(reach.start, min(reach.start + PIVOTS, int(np.searchsorted(c, value, side="right")))):
                others = o[reach][o[reach] != o[pivot]]
                yield np.stack([np.full(len(others), o[pivot]), others])


def merge_segment(table: pa.Table) -> pa.Table:
    """Documents and signatures pass (a set's signature once); lists become pairs, long ones also their members."""
    kind = table.column("kind").to_numpy()
    out: list[pa.Table] = []

    def emit(k: int, lists=None, a=None, b=None, n=None, data=None) -> None:
        size = len(next(x for x in (a, b) if x is not None))
        columns = [pa.array(np.full(size, k, np.int32))]
        columns += [pa.nulls(size, t) if x is None else (x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t)) for x, t in ((lists, pa.int64()), (a, pa.int64()), (b, pa.int64()), (n, pa.int32()), (data, pa.binary()))]
        out.append(pa.table(columns, ["kind", "list", "a", "b", "n", "data"]))

    docs = table.filter(pa.array(kind == DOC))
    emit(DOC, a=docs.column("a"), b=docs.column("b"), n=docs.column("n"))
    sigs = table.filter(pa.array(kind == SIGNATURE))
    once = np.unique(sigs.column("b").to_numpy(), return_index=True)[1]
    sigs = sigs.take(pa.array(once))
    emit(SIGNATURE, a=sigs.column("b"), n=sigs.column("n"), data=sigs.column("data"))
    blobs = table.filter(pa.array(kind == PAIR))
    if blobs.num_rows:
        key, own, cls = _unpacked(blobs.column("data").to_pylist(), blobs.column("n").to_pylist())
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = np.zeros(len(key), bool)
        same[1:] = sorted_key[1:] == sorted_key[:-1]
        same[:-1] |= same[1:]
        order = order[same]  # keys met once leave here
        key, own, cls = key[order], own[order], cls[order]
        order = np.lexsort((own, cls, key))
        key, own, cls = key[order], own[order], cls[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        key, own, cls = key[fresh], own[fresh], cls[fresh]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(key)))
        starts, lengths = starts[lengths > 1], lengths[lengths > 1]
        found = list(_list_pairs(own, cls, starts, lengths))
        if found:
            pairs = np.concatenate(found, axis=1)
            low, high = np.minimum(*pairs), np.maximum(*pairs)
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            fresh = np.ones(len(low), bool)
            fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            emit(PAIR, a=low[fresh], b=high[fresh])
        long_lists = lengths > SHORT_LIST
        if long_lists.any():
            members = [np.sort(own[s : s + n]) for s, n in zip(starts[long_lists].tolist(), lengths[long_lists].tolist(), strict=True)]
            named = {_name(m): m for m in members}
            emit(LIST, lists=np.concatenate([np.full(len(m), k) for k, m in named.items()]), a=np.concatenate(list(named.values())))
    return pa.concat_tables(out)


# --- checks -----------------------------------------------------------------------------------------


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these signatures share more shingles."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def reaches(common: int, size_a: int, size_b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (size_a + size_b - common)


def map_place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MAP_WORDS * 64))


def map_of(ids: DataFrame) -> np.ndarray:
    """Bit map of the ids in column ``d``; at most MAP_WORDS rows come to the driver.

    It only spares rows that nothing asks for, before a shuffle; the join behind it decides.
    """
    words = (
        ids.distinct().withColumn("p", map_place("d"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    ).toArrow()
    bits = np.zeros(MAP_WORDS, np.int64)
    if words.num_rows:
        bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return bits


def asked_signatures(signatures: DataFrame, ids: DataFrame) -> DataFrame:
    """Signatures (a, n, data) of the sets in column ``d`` of ``ids``, and a few others."""
    shared = signatures.sparkSession.sparkContext.broadcast(map_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            asked = (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            yield batch.filter(pa.array(asked)).select(["a", "n", "data"])

    return signatures.select("a", "n", "data", map_place("a").alias("p")).mapInArrow(run, "a long, n int, data binary")


def bounded_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bound allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")]
            keep = [reaches(min(na, nb), na, nb) and reaches(min(overlap_bound(x, y), na, nb), na, nb) for x, y, na, nb in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    pairs = cut_lineage(pairs)
    asked = asked_signatures(signatures, pairs.select(F.explode(F.array("a", "b")).alias("d")))

    def side(x: str) -> DataFrame:
        return asked.select(F.col("a").alias(x), F.col("n").alias("n" + x), F.col("data").alias("s" + x))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """d, a, data: the sets (their names a, six bytes a shingle) of the documents in column ``d`` of ``ids``, and of a few others.

    Rows that repeat an id give each of their sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(map_of(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wd.WordHasher()
        for batch in wd.pieces(batches, limit=PIECE_BYTES):
            p = batch.column("p").to_numpy()
            asked = (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            batch = batch.filter(pa.array(asked))
            found, names = piece_sets(batch.column("text"), hasher)
            data = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(names), pa.array(data, pa.binary())], ["d", "a", "data"])

    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), "text").withColumn("p", map_place("d"))
    return source.select("d", "p", "text").mapInArrow(sets, "d long, a long, data binary").groupBy("d", "a").agg(F.min("data").alias("data"))


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, 6) @ PLACES


def exact_links(pairs: DataFrame, chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that link, by the whole sets. ``chosen``: set (a) and the document that stands for it."""
    named = pairs.join(chosen.select("a", F.col("doc_id").alias("da")), "a").join(chosen.select(F.col("a").alias("b"), F.col("doc_id").alias("db")), "b")
    named = cut_lineage(named.select("a", "b", "da", "db"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                both = np.sort(numbers(x + y))
                keep.append(reaches(int((both[1:] == both[:-1]).sum()), len(x) // 6, len(y) // 6))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    whole = whole_sets(docs, named.select(F.explode(F.array("da", "db")).alias("d")))
    first = named.join(whole.select(F.col("d").alias("db"), F.col("a").alias("b"), F.col("data").alias("sb")), ["db", "b"])
    return first.join(whole.select(F.col("d").alias("da"), "a", F.col("data").alias("sa")), ["da", "a"]).select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


PLACES = (256 ** np.arange(6)).astype(np.int64)


def cross_links(lists: DataFrame, labels: DataFrame, signatures: DataFrame, chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of long lists that lie in different components: enough of them to join those.

    First the signatures tell which members have any possible partner; only their whole sets are fetched.
    """
    labelled = lists.join(labels.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    mixed = labelled.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).filter("low < high")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    at = labelled.join(mixed.select("list", blocks.alias("blocks")), "list").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    spread = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = cut_lineage(spread.select("list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "a", "label"))
    signed = grouped.join(asked_signatures(signatures, grouped.select(F.col("a").alias("d"))), "a")

    def partners(table: pa.Table) -> pa.Table:
        label, n = (table.column(c).to_numpy() for c in ("label", "n"))
        data = table.column("data").to_pylist()
        bins = min(len(d) for d in data)
        folded = np.stack([np.frombuffer(d, np.uint8).astype(np.int32).reshape(-1, bins).sum(0) for d in data])
        some = np.zeros(len(n), bool)
        for k in range(len(n)):
            fit = np.flatnonzero((label != label[k]) & ~(some & some[k]))
            fit = fit[fit > k]
            fit = fit[100 * np.minimum(n[fit], n[k]) >= PERCENT * np.maximum(n[fit], n[k])]
            common = np.minimum(np.minimum(folded[fit], folded[k]).sum(1), np.minimum(n[fit], n[k]))
            fit = fit[100 * common >= PERCENT * (n[fit] + n[k] - common)]
            some[fit] = True
            some[k] |= len(fit) > 0
        return table.filter(pa.array(some)).select(["list", "i", "j", "a", "label"])

    asked = signed.groupBy("list", "i", "j").applyInArrow(partners, "list long, i int, j int, a long, label long")
    asked = cut_lineage(asked.join(chosen.select("a", F.col("doc_id").alias("d")), "a"))
    full = asked.join(whole_sets(docs, asked.select("d")), ["d", "a"]).select("list", "i", "j", "a", "label", "data")

    def link(table: pa.Table) -> pa.Table:
        a, label = table.column("a").to_numpy(), table.column("label").to_numpy().copy()
        sets = [numbers(d) for d in table.column("data").to_pylist()]
        size = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        found: list[tuple[int, int]] = []
        for k in range(len(a)):
            mark = np.zeros(int(flat.max()) + 1, np.int32)
            mark[flat[starts[k] : starts[k] + size[k]]] = 1
            fit = np.flatnonzero((label != label[k]) & (100 * np.minimum(size, size[k]) >= PERCENT * np.maximum(size, size[k])))
            fit = fit[fit > k]
            if not len(fit):
                continue
            cuts = np.cumsum(size[fit]) - size[fit]
            common = np.add.reduceat(mark[flat[np.repeat(starts[fit] - cuts, size[fit]) + np.arange(cuts[-1] + size[fit][-1])]], cuts)
            for m in fit[100 * common >= PERCENT * (size[fit] + size[k] - common)]:
                if label[m] != label[k]:  # joins two components: later links between them say nothing new
                    label[label == label[m]] = label[k]
                    found.append((min(a[k], a[m]), max(a[k], a[m])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return full.groupBy("list", "i", "j").applyInArrow(link, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(shuffle_partitions(docs.sparkSession), -(-size // SEGMENT_BYTES))
    table, boundary = fit_order(docs)
    dealt = index_pieces(docs, table, boundary, segments).repartition(segments, "segment")
    index = cut_lineage(dealt.groupBy("segment").applyInArrow(merge_segment, OUT))
    rows = index.filter(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"))
    signatures = index.filter(F.col("kind") == SIGNATURE).select("a", "n", "data")
    pairs = index.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    lists = index.filter(F.col("kind") == LIST).select("list", "a").distinct()
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    chosen = named.groupBy(F.col("node").alias("a")).agg(F.min("doc_id").alias("doc_id"))
    links = cut_lineage(exact_links(bounded_pairs(pairs, signatures), chosen, docs))
    if not lists.isEmpty():
        links = links.union(cut_lineage(cross_links(lists, components(links), signatures, chosen, docs)))
    # Rows that repeat an id join the classes of their texts.
    same = named.select("doc_id", "node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    twins = named.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    label = components(links.union(twins))
    smallest = chosen.join(label.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    first = smallest.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = smallest.select(F.col("a").alias("node"), "label").join(first, "label").select("node", "component_id")
    return (
        rows.join(of_node, "node", "left")
        .select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows with a null id stay.

    Of rows that repeat an id the one with the smallest text stays.
    """
    groups = cut_lineage(jaccard_groups(docs))
    gone = groups.filter("component_id <> doc_id").select("doc_id")
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    once = docs.join(gone.union(repeated).distinct(), "doc_id", "left_anti")
    if repeated.isEmpty():
        return once.select(docs.columns)
    kept = repeated.join(gone, "doc_id", "left_anti")
    rest = docs.join(kept, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("r")).select("r.*")
    return once.select(docs.columns).union(rest.select(docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
