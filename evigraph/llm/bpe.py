"""Byte-level BPE encoding and decoding with a pair occurrence index.

Per chunk of texts every distinct word is laid out once in one symbol array. An index maps each
mergeable pair (named by its merge rank) to all its positions in that array. Active ranks are applied
in ascending order from a heap: all occurrences of the pair merge at once, and only the pairs to the
left and right of a merge are looked up again and appended to the lists of their ranks. The ids of a
word are kept for later chunks of the same task (bounded), and texts are put together from words.

The vocabulary file is read once on the driver, by its path, and broadcast: a vocabulary is a fixed
table of a few MB, whatever the corpus. Encoding is a projection: no shuffle. A task holds one chunk of
``CHUNK_CHARS`` characters, or one text if that is longer.

Defined results: a null text is encoded as an empty one; repeated rows are encoded each. A special
token's string in a text becomes that token, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.tables import read

CHUNK_CHARS = 3_000_000
CACHE_WORDS = 500_000
NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
SPACES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


class BpeTables(NamedTuple):
    byte_ids: np.ndarray      # symbol of each byte
    pair_keys: np.ndarray     # left << 32 | right, ascending
    pair_ranks: np.ndarray
    merged: np.ndarray        # symbol by rank
    token_bytes: np.ndarray   # bytes of all tokens, one after another
    token_starts: np.ndarray
    special: dict[str, int]
    class_starts: np.ndarray  # runs of equal character class
    class_values: np.ndarray


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    kinds[list(SPACES)] = SPACE
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    return starts, kinds[starts]


def load_tables(path: str) -> BpeTables:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_ids = np.zeros(256, np.int32)
    for char, byte in alphabet.items():
        byte_ids[byte] = vocab[char]
    left, right, merged = [], [], []
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        left.append(vocab[a]), right.append(vocab[b]), merged.append(vocab[a + b])
    keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
    order = np.argsort(keys, kind="stable")
    spelled = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
    size = max(spelled) + 1
    pieces = [spelled.get(i, b"") for i in range(size)]
    return BpeTables(
        byte_ids, keys[order], order.astype(np.int32), np.array(merged, np.int32), np.frombuffer(b"".join(pieces), np.uint8),
        np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), special, *character_classes(),
    )


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PairIndexEncoder:
    """Encoder of one task."""

    def __init__(self, tables: BpeTables):
        self.t = tables
        self.classes = np.repeat(tables.class_values, np.diff(tables.class_starts, append=0x110000))
        self.forget()

    def forget(self) -> None:
        self.known = {s.encode(): k for k, s in enumerate(self.t.special)}
        self.flat = np.array(list(self.t.special.values()), np.int32)
        self.lengths = np.ones(len(self.known), np.int64)

    # --- words of texts -------------------------------------------------------------------------

    def split(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """Words of all texts, each text followed by one separator word, and the separators' positions."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kind[edges] = EDGE
        marks = [(m, len(s)) for s in self.t.special for m in _occurrences(joined, s)]
        for at, n in marks:
            kind[at : at + n] = EDGE
        first = np.ones(len(points), bool)  # first character of a run
        first[1:] = kind[1:] != kind[:-1]
        blank = points == 0x20
        start = first.copy()
        start[1:] &= ~(blank[:-1] & (kind[1:] != SPACE) & (kind[1:] != EDGE))  # a blank leads the run after it
        space = kind == SPACE
        start[:-1] |= space[:-1] & ~space[1:] & (kind[1:] != EDGE)  # the last white space before a run stands alone
        start[edges] = True
        start[edges[:-1] + 1] = True
        for at, n in marks:
            start[at] = True
            start[at + 1 : at + n] = False
            start[at + n] = True
        for at in np.flatnonzero(start & (points == 0x27) & (kind == OTHER)):
            if first[at] and kind[at] == OTHER:
                tail = joined[at + 1 : at + 3]
                n = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
                if n:
                    start[at + 1 : at + 1 + n] = False
                    start[at + 1 + n] = True
        sizes = np.ones(len(points), np.int32)
        for limit in (0x80, 0x800, 0x10000):
            sizes += points >= limit
        begins = np.flatnonzero(start)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.append(begins, len(points))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
        return words, np.searchsorted(begins, edges)

    # --- merges ---------------------------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.t.pair_keys, key), len(self.t.pair_keys) - 1)
        return np.where(self.t.pair_keys[at] == key, self.t.pair_ranks[at], NONE)

    def learn(self, words: list[bytes]) -> None:
        """Encode new distinct words together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.t.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)  # of the pair that starts here
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Append positions to the lists of their ranks."""
            positions = positions[rank[positions] != NONE]
            if not len(positions):
                return
            order = positions[np.argsort(rank[positions], kind="stable")]
            found = rank[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(order, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        note(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.sort(np.concatenate(lists))
            at = at[np.diff(at, prepend=-1) > 0]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:  # overlapping occurrences (a a a): every second of a chain, from its left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[at]
            following = after[gone]
            symbol[at] = self.t.merged[r]
            alive[gone] = False
            after[at] = following
            there = following >= 0
            before[following[there]] = at[there]
            rank[at] = NONE
            right = at[there]
            rank[right] = self.ranks(symbol[right], symbol[after[right]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.ranks(symbol[left], symbol[after[left]])
            note(np.concatenate([right, left]))

        kept = np.add.reduceat(alive, ends - sizes) if n else np.zeros(0, np.int64)
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, symbol[alive]])
        self.lengths = np.concatenate([self.lengths, kept.astype(np.int64)])

    # --- whole texts ----------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more entry than texts)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words, edges = self.split(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        starts = np.cumsum(self.lengths) - self.lengths
        word = number[coded.indices.to_numpy()]
        length = self.lengths[word]
        length[edges] = 0
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[ragged(starts[word], length)], np.concatenate([[0], total[edges]])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        begin = self.t.token_starts[ids]
        length = self.t.token_starts[ids + 1] - begin
        data = self.t.token_bytes[ragged(begin, length)].tobytes()
        at = np.concatenate([[0], np.cumsum(length)])[starts]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _occurrences(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """doc_id and ids array<int> for every row of ``docs`` (doc_id, text).

    With ``digests``: doc_id, n_tokens, and the sha256 of the ids and of the text decoded from them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_tables(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        encoder = PairIndexEncoder(BpeTables(*shared.value))
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                ids, starts = encoder.encode(texts[a:b])
                if not digests:
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.ListArray.from_arrays(starts.astype(np.int32), ids)], ["doc_id", "ids"])
                    continue
                raw = ids.astype("<u4").tobytes()
                cut = (starts * 4).tolist()
                of_ids = [sha256(raw[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                of_text = [sha256(t.encode()).hexdigest() for t in encoder.decode(ids, starts)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(np.diff(starts)), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids). Null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(load_tables(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(BpeTables(*shared.value))
        for batch in batches:
            rows = [r or [] for r in batch.column("ids").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            flat = np.array([i for r in rows for i in r], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.decode(flat, starts), pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_vocabulary(), digests=True)


QUERIES = {"op2_bpe": op2_bpe}
