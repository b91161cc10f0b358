"""Phrase collocation mining with depth-truncated suffix subtrees, built group by group.

The words of all texts are one string over the alphabet of words, cut at pieces and at words that are too rare for
any phrase. Its suffixes, truncated at ``DEPTH`` words, form a tree in which the leaves below a node add up to the
number of occurrences of the node's phrase.

1. **Vertical partitioning.** Suffixes are dealt by their prefix, so that each group holds about ``BUDGET``
   suffixes: one word is the prefix where it begins at most a sixteenth of that, two words where the pair does,
   else the whole suffix. The few words and pairs that are more frequent (at most n / threshold of them, and never
   more than ``MOST_HEAVY``) are counted beforehand and broadcast; so is a bit map of the frequent words, whose size
   is fixed. Both only steer: a false positive costs a row and changes no count.
2. **Subtrees.** A task packs the distinct suffixes of a piece of text with their counts into one block per
   group; blocks, not suffixes, are rows of the shuffle. A group sorts its suffixes word by word, which is the
   subtree in depth-first order, and reads the count of every node from the totals of its leaves. Nodes above the
   prefix of a group are partial and added up afterwards; all others are whole and leave only at ``LEAST`` or more.
3. **Scores.** Frequent phrases are a table. Each candidate asks it for the counts of its parts (one equi join,
   hot parts spread), tells its sub-phrases its own count, and is scored in one aggregation with exact decimals.

Ranks of a language are limited in hashed buckets first, so no task sorts all candidates of a language.

Defined results: null and empty texts have no words; a null language counts as ``und``; repeated rows count each;
an empty table gives no rows. Pieces and words never reach across texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.skew import spread_join
from evigraph.llm import words as wd
from evigraph.llm.tables import read
from evigraph.session import cut_lineage

DEPTH, LEAST, TOP = 4, 30, 2000
SCORE, INSIDE = 2_000_000, 80  # scale of scores; percent of a candidate's count that a longer one takes over
BUDGET, MOST_HEAVY = 1_000_000, 100_000
MAP_BITS = 27
BUCKETS = 32
PIECE_BYTES = 6 << 20

WORD, BLANK, BREAK = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = BREAK
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Tokens(NamedTuple):
    words: pa.BinaryArray  # distinct words of the piece of text
    code: np.ndarray       # per word occurrence
    lang: np.ndarray       # per word occurrence, a number
    langs: list[str]
    joined: np.ndarray     # the next word follows in the same piece


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in wd.pieces(batches, limit=PIECE_BYTES):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).translate(LOWER), np.uint8)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        kind = KINDS[data]
        inside = kind == WORD
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            continue
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        breaks = np.cumsum(kind == BREAK)[begin]
        joined = np.append(breaks[1:] == breaks[:-1], False)
        yield Tokens(coded.dictionary, coded.indices.to_numpy(), langs.indices.to_numpy()[np.searchsorted(ends, begin, side="right")], langs.dictionary.to_pylist(), joined)


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, class and size of equal rows of number columns."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        both = key << 32 | c.astype(np.int64)
        _, first, key, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    if len(columns) == 1:
        _, first, key, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, key, count


# --- counts of words and of heavy pairs -----------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokens(batches):
            first, _, n = distinct(t.lang, t.code)
            langs = pa.array(t.langs, pa.string()).take(pa.array(t.lang[first]))
            yield pa.RecordBatch.from_arrays([langs, t.words.take(pa.array(t.code[first])).cast(pa.string()), pa.array(n)], ["lang", "word", "f"])

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def hashes_of(t: Tokens) -> np.ndarray:
    """``word_hash`` of every word occurrence of a piece of text."""
    first, own, _ = distinct(t.lang, t.code)
    spelled = t.words.take(pa.array(t.code[first])).to_pylist()
    seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in t.langs]
    hashed = [xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(spelled, t.lang[first].tolist(), strict=True)]
    return np.array(hashed, np.uint64)[own]


def frequent_map(frequent: DataFrame) -> np.ndarray:
    """Bit map of ``2 ** MAP_BITS`` bits over the hashes of frequent words."""
    place = frequent.select(F.pmod(word_hash(F.col("lang"), F.col("word")), F.lit(1 << MAP_BITS)).alias("at"))
    parts = place.groupBy(F.expr("at div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("cast(at % 32768 as long)")).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in parts.collect():  # 2 ** (MAP_BITS - 15) rows of 4 KB at most
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def listed(values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    return values[at] == hashes if len(values) else np.zeros(hashes.shape, bool)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return wd.mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def as_unsigned(rows: list) -> np.ndarray:
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def heavy_pairs(docs: DataFrame, heavy: np.ndarray, least: int, words: int) -> np.ndarray:
    """Hashes of all pairs of words with more than ``least`` occurrences, and of some with more than half of it.

    Both words of such a pair are heavy. A piece of text tells only pairs above its share of ``least / 2`` (by its part
    of all ``words``): what goes untold is ``least / 2`` at most, so a pair with more is told of and counted above that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokens(batches):
            hashes = hashes_of(t)
            is_heavy = listed(shared.value, hashes)
            at = np.flatnonzero(t.joined[:-1] & is_heavy[:-1] & is_heavy[1:])
            pairs, n = np.unique(pair_hash(hashes[at], hashes[at + 1]), return_counts=True)
            told = n > least / 2 * (len(t.code) / words)
            pairs, n = pairs[told], n[told]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], ["pair", "f"])

    if not len(heavy):
        return heavy
    found = docs.mapInArrow(count, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))
    return as_unsigned(found.filter(F.col("f") > least / 2).select("pair").collect())


# --- suffixes and their subtrees -------------------------------------------------------------------------


BLOCK = ("words", "codes", "counts", "deep")


class Steering(NamedTuple):
    frequent: np.ndarray
    heavy_words: np.ndarray
    heavy_pairs: np.ndarray
    groups: int


def narrow(numbers: np.ndarray) -> bytes:
    """The width of the smallest integers that hold all numbers, then the numbers, compressed."""
    kind = np.min_scalar_type(int(numbers.max()))
    return zstandard.compress(bytes([kind.itemsize]) + np.ascontiguousarray(numbers, kind).tobytes(), 1)


def widened(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def suffix_blocks(docs: DataFrame, steering: Steering) -> DataFrame:
    """One row per piece of text, group and language: distinct truncated suffixes and their counts.

    ``words`` holds the words of the block, ``codes`` their numbers from 1 in the suffixes, first words first
    (0: no further word), ``deep`` which of them begin with a divided pair; integers are no wider than the block needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(steering))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Steering(*shared.value)
        for t in tokens(batches):
            hashes = hashes_of(t)
            common = marked(s.frequent, hashes)
            goes_on = t.joined & common & np.append(common[1:], False)
            at = np.flatnonzero(goes_on)
            if not len(at):
                continue
            codes = np.full((len(at), DEPTH), -1, np.int32)
            codes[:, 0] = t.code[at]
            alive = np.ones(len(at), bool)
            for d in range(1, DEPTH):
                alive &= goes_on[np.minimum(at + d - 1, len(goes_on) - 1)]
                codes[alive, d] = t.code[at[alive] + d]
            _, front, _ = distinct(codes[:, 0], codes[:, 1])
            _, back, _ = distinct(codes[:, 2] + 1, codes[:, 3] + 1)
            _, whole, _ = distinct(front, back)
            first, _, count = distinct(whole, t.lang[at])
            codes, lang, at = codes[first], t.lang[at[first]], at[first]
            one = hashes[at]
            pair = pair_hash(one, hashes[at + 1])
            heavy = listed(s.heavy_words, one)
            deep = heavy & listed(s.heavy_pairs, pair)
            prefix = np.where(heavy, pair, one)
            for d in range(2, DEPTH):
                longer = deep & (codes[:, d] >= 0)
                prefix[longer] = pair_hash(prefix[longer], hashes[at[longer] + d])
            group = (wd.mix(prefix) % np.uint64(s.groups)).astype(np.int64)
            order = np.lexsort((codes[:, 1], codes[:, 0], lang, group))
            codes, lang, deep, group, count = codes[order], lang[order], deep[order], group[order], count[order]
            new = np.ones(len(order), bool)
            new[1:] = (group[1:] != group[:-1]) | (lang[1:] != lang[:-1])
            cuts = np.append(np.flatnonzero(new), len(order))
            spelled = t.words.to_pylist()
            rows: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                used, own = np.unique(codes[a:b], return_inverse=True)
                shift = int(used[0] < 0)
                text = zstandard.compress(b"\n".join([spelled[c] for c in used[shift:].tolist()]), 1)
                rows.append((int(group[a]), t.langs[lang[a]], text, narrow(own.reshape(-1, DEPTH).T + (1 - shift)), narrow(count[a:b]), narrow(deep[a:b])))
            kinds = (pa.int32(), pa.string(), *[pa.binary()] * 4)
            columns = zip(zip(*rows, strict=True), kinds, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["group", "lang", *BLOCK])

    return docs.mapInArrow(pack, "group int, lang string, " + ", ".join(f"{c} binary" for c in BLOCK))


def subtrees(blocks: list[tuple[bytes, ...]]) -> tuple[list[str], list[int], list[int]]:
    """Phrases of the nodes of a group's subtrees in one language, their numbers of words and their leaf totals."""
    lists = [zstandard.decompress(b[0]).split(b"\n") for b in blocks]
    coded = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
    names = [w.decode() for w in coded.dictionary.to_pylist()]
    number = coded.indices.to_numpy()
    base, parts = 0, []
    for ws, (_, codes, _, _) in zip(lists, blocks, strict=True):
        own = np.append(-1, number[base : base + len(ws)])  # 0 answers -1
        parts.append(own[widened(codes)].reshape(DEPTH, -1).T)
        base += len(ws)
    suffix = np.concatenate(parts)
    leaf, deep = (np.concatenate([widened(b[k]) for b in blocks]) for k in (2, 3))
    order = np.lexsort(suffix.T[::-1])
    suffix, leaf, deep = suffix[order], leaf[order], deep[order] > 0
    new = np.zeros(len(suffix), bool)
    new[:1] = True
    phrases: list[str] = []
    depths: list[int] = []
    totals: list[int] = []
    for d in range(1, DEPTH + 1):
        new[1:] |= suffix[1:, d - 1] != suffix[:-1, d - 1]
        if d == 1:
            continue  # counts of words are known
        first = np.flatnonzero(new)
        total = np.add.reduceat(leaf, first)
        # A whole subtree keeps its frequent nodes; below a divided pair the nodes of two and three words are partial.
        kept = (suffix[first, d - 1] >= 0) & ((total >= LEAST) | (deep[first] & (d < DEPTH)))
        for row, n in zip(suffix[first[kept], :d].tolist(), total[kept].tolist(), strict=True):
            phrases.append(" ".join([names[c] for c in row]))
            depths.append(d)
            totals.append(n)
    return phrases, depths, totals


def group_nodes(table: pa.Table) -> pa.Table:
    """All frequent nodes of the subtrees of one group."""
    classes: dict[str, list[tuple[bytes, ...]]] = {}
    for lang, *block in zip(*[table.column(c).to_pylist() for c in ("lang", *BLOCK)], strict=True):
        classes.setdefault(lang, []).append(tuple(block))
    langs, phrases, depths, totals = [], [], [], []
    for lang, blocks in classes.items():
        p, d, n = subtrees(blocks)
        langs += [lang] * len(p)
        phrases += p
        depths += d
        totals += n
    return pa.table([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(depths, pa.int32()), pa.array(totals, pa.int64())], ["lang", "phrase", "m", "f"])


def phrase_counts(docs: DataFrame, budget: int = BUDGET, most_heavy: int = MOST_HEAVY) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of 1 to ``DEPTH`` words with f >= ``LEAST``, and (lang, n)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = cut_lineage(word_counts(docs))
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.filter(F.col("f") >= LEAST)
    words, total = (v or 0 for v in counts.agg(F.sum("f"), F.sum(F.when(F.col("f") >= LEAST, F.col("f")))).first())
    least = max(budget // 16, total // most_heavy)
    heavy = as_unsigned(frequent.filter(F.col("f") > least).select(word_hash(F.col("lang"), F.col("word"))).collect())
    steering = Steering(frequent_map(frequent), heavy, heavy_pairs(docs, heavy, least, words), int(-(-2 * total // budget)) or 1)
    blocks = suffix_blocks(docs, steering)
    nodes = blocks.groupBy("group").applyInArrow(group_nodes, "lang string, phrase string, m int, f long")
    longer = nodes.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= LEAST)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), "f")
    return cut_lineage(single.unionByName(longer)), sizes


# --- scores ------------------------------------------------------------------------------------------------


def wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that no longer candidate takes over."""
    split = F.split("phrase", " ")
    many = phrases.filter("m >= 2").select("lang", "phrase", "m", F.col("f").alias("a"), split.alias("w"))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    asked = cut.select(
        "lang", "phrase", "a", "k",
        F.inline(F.array(F.struct(F.lit(True).alias("left"), piece(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), piece(F.col("k") + 1, F.col("m") - F.col("k")).alias("part")))),
    )
    answers = spread_join(asked, phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    told = answers.select("lang", "phrase", "a", "k", "left", "f", F.lit(None).cast("long").alias("longer"))
    inner = many.filter("m >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("k", "int"), ("left", "boolean"), ("f", "long"))]
    warned = inner.select("lang", piece(F.col("start"), F.col("size")).alias("phrase"), *nothing, F.col("a").alias("longer"))

    def count(k: int, left: bool) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")

    sides = [count(k, left) for k in range(1, DEPTH) for left in (True, False)]
    per = told.unionByName(warned).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *sides)
    rest = per.filter(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * INSIDE))

    def cut_score(k: int) -> Column:
        value = F.expr(f"cast((cast(a AS decimal(20,0)) * {SCORE}) div (cast(l{k} AS decimal(20,0)) + cast(r{k} AS decimal(20,0))) AS long)")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[cut_score(k) for k in range(1, DEPTH)])))
    return rest.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = TOP, budget: int = BUDGET, most_heavy: int = MOST_HEAVY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language of ``docs`` (lang, text)."""
    phrases, sizes = phrase_counts(docs, budget, most_heavy)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    some = scored(phrases).withColumn("bucket", bucket).withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


CHECK = r"""WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
    ws AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pc),
    pl AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM ws WHERE len(w) > 0),
    gr AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM pl, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM gr GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    ca AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
    cu AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM ca),
    cs AS (SELECT cu.lang, cu.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cu
      JOIN f x ON x.lang = cu.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = cu.lang AND y.phrase = array_to_string(w[k + 1 : cu.m], ' ')),
    be AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    su AS (SELECT lang, a, w, m, unnest(generate_series(2, m - 1)) AS s FROM ca WHERE m >= 3),
    so AS (SELECT lang, a, w, s, unnest(generate_series(1, m - s + 1)) AS b FROM su),
    lo AS (SELECT lang, array_to_string(w[b : b + s - 1], ' ') AS phrase, max(a) AS longer FROM so GROUP BY ALL),
    re AS (SELECT be.* FROM be LEFT JOIN lo USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM re JOIN n USING (lang) QUALIFY rank <= 2000"""

QUERIES = {"op11_collocations": op11_collocations}
CHECKS = {"op11_collocations": CHECK}
