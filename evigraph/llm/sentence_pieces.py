"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A chunk of texts is one array of characters. It is cut into words wherever no piece of the vocabulary
holds the two characters that meet there, so no merge can ever cross a cut; every distinct word is
encoded once. The symbols of all new words lie in one flat numpy array. A round

1. takes the minimum pair rank of each word (segmented minimum),
2. merges all occurrences of that pair in all words at once, of overlapping ones every second from the left,
3. compacts the arrays: merged symbols close up, words without a pair leave.

Rounds go on until no pair remains. The library merges one occurrence at a time; that is the same unless a
merged symbol can at once take part in a merge of no worse rank. Pieces for which the vocabulary holds such a
merge are known beforehand (the runs of blanks, for one, share one score); a word whose turn it is to make
several of them is finished by a heap in the library's order, in n log n.

The model file is read once on the driver, by its path, and broadcast: a table of a few MB, whatever the
corpus. Encoding is a projection without a shuffle. A task holds one chunk of ``CHUNK_CHARS`` characters, or one
text if that is longer, and a bounded memory of words.

Models with a BPE vocabulary, byte fallback and identity normalisation are supported, others are refused.
Characters outside the vocabulary become their bytes. Defined results: null and empty texts have no ids and
decode to an empty text; repeated rows are encoded each; null ids decode to an empty text; byte ids that form no
character decode to U+FFFD each, ids outside the vocabulary are refused as the library does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.bpe import chunks, ragged
from evigraph.llm.tables import read

CHUNK_CHARS = 1_500_000
CACHE_WORDS = 500_000
NONE = np.iinfo(np.int32).max
BLANK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format
LOST = "�"


class PieceTables(NamedTuple):
    char_points: np.ndarray   # code points that are symbols, ascending
    char_symbols: np.ndarray  # their symbols: piece ids, or numbers after the last piece
    neighbours: np.ndarray    # point << 32 | point of characters that meet inside a piece, ascending
    pair_keys: np.ndarray     # left << 32 | right, ascending
    pair_ranks: np.ndarray    # 0 is merged first; equal scores share a rank
    pair_pieces: np.ndarray
    hasty: np.ndarray         # by rank: a merge of no worse rank may follow at once
    byte_ids: np.ndarray      # id of each byte
    surfaces: np.ndarray      # bytes of all pieces as decoded, one after another
    surface_starts: np.ndarray
    leading: np.ndarray       # by id: starts with the blank that is dropped at the start of a text
    is_byte: np.ndarray


def load_tables(path: str) -> PieceTables:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, spec, kinds = model.normalizer_spec, model.trainer_spec, {p.type for p in model.pieces}
    if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("not a BPE model with byte fallback, identity normalisation and a leading blank")
    size = len(model.pieces)
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
    place = {s: i for i, s in enumerate(scores)}
    symbols = dict(ids)
    for piece in ids:
        for char in piece:
            symbols.setdefault(char, len(symbols) + size)
    keys, ranks, made, meet = [], [], [], set()
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            meet.add(ord(piece[k - 1]) << 32 | ord(piece[k]))
            left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
            if left is not None and right is not None:
                keys.append(left << 32 | right), ranks.append(place[model.pieces[i].score]), made.append(i)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    pair_keys, pair_ranks, pair_pieces = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order], np.array(made, np.int32)[order]
    own = np.full(len(symbols) + size + 1, NONE, np.int64)
    own[list(ids.values())] = [place[model.pieces[i].score] for i in ids.values()]
    hasty = np.zeros(len(scores) + 1, bool)
    for part in (pair_keys >> 32, pair_keys & 0xFFFFFFFF):
        hasty[own[part[(own[part] != NONE) & (pair_ranks <= own[part])]]] = True
    byte_ids = np.zeros(256, np.int32)
    shown = []
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            shown.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            shown.append({NORMAL: p.piece.replace(BLANK, " "), UNKNOWN: spec.unk_surface, CONTROL: ""}[p.type].encode())
    points = np.array(sorted(ord(s) for s in symbols if len(s) == 1), np.int64)
    return PieceTables(
        points, np.array([symbols[chr(c)] for c in points], np.int64), np.array(sorted(meet), np.int64), pair_keys, pair_ranks, pair_pieces, hasty, byte_ids,
        np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in shown])]),
        np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces]), np.array([p.type == BYTE for p in model.pieces]),
    )


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class RoundEncoder:
    """Encoder of one task."""

    def __init__(self, tables: PieceTables):
        self.t = tables
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    # --- words of texts -------------------------------------------------------------------------

    def split(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """Words of all texts and the number of the first word of each text (one more entry than texts)."""
        marked = [(" " + t).replace(" ", BLANK) if t else "" for t in texts]
        edges = np.concatenate([[0], np.cumsum([len(m) for m in marked], dtype=np.int64)])
        joined = "".join(marked)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.ones(len(points), bool)
        if len(points) > 1:
            start[1:] = ~member(self.t.neighbours, points[:-1] << 32 | points[1:])[1]
        start[edges[:-1][np.diff(edges) > 0]] = True
        sizes = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            sizes += points >= limit
        begins = np.flatnonzero(start)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.append(begins, len(points))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
        return words, np.searchsorted(begins, edges)

    # --- merges ---------------------------------------------------------------------------------

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs, ``NONE`` where they form no piece."""
        at, there = member(self.t.pair_keys, left << 32 | right)
        return np.where(there, self.t.pair_ranks[at], NONE), self.t.pair_pieces[at]

    def rounds(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, word after word, and their number per word."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank, made = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self.pairs(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def leave(gone: np.ndarray, result: np.ndarray | None = None) -> None:
            done.append((word[gone], symbol[gone] if result is None else result))

        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(first, append=len(word))
            low = np.minimum.reduceat(rank, first)
            over = low == NONE
            most = rank == np.repeat(low, size)
            haste = ~over & self.t.hasty[np.minimum(low, len(self.t.hasty) - 1)]
            haste[haste] = np.add.reduceat(most, first)[haste] > 1
            for k in np.flatnonzero(haste):
                ready = self.in_order(symbol[first[k] : first[k] + size[k]].tolist())
                done.append((np.full(len(ready), word[first[k]]), np.array(ready, np.int64)))
            leave(np.repeat(over, size))
            stay = np.repeat(~(over | haste), size)
            symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
            if not len(symbol):
                break
            hit = np.flatnonzero(most[stay])
            chained = np.diff(hit, prepend=-2) == 1
            if chained.any():
                n = np.arange(len(hit))
                hit = hit[(n - np.maximum.accumulate(np.where(chained, 0, n))) % 2 == 0]
            symbol[hit] = made[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            rank[at] = NONE
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            changed = changed[changed < len(word) - 1]
            rank[changed] = NONE
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], made[changed] = self.pairs(symbol[changed], symbol[changed + 1])
        words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return flat[order], np.bincount(words, minlength=len(lengths))

    def in_order(self, symbol: list[int]) -> list[int]:
        """One word, one merge at a time: best rank first, then leftmost."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def note(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and after[i] < n]
            a, b = np.array([symbol[i] for i in lefts], np.int64), np.array([symbol[after[i]] for i in lefts], np.int64)
            rank, made = self.pairs(a, b)
            for i, r, m in zip(lefts, rank.tolist(), made.tolist(), strict=True):
                if r != NONE:
                    heapq.heappush(heap, (r, i, m, symbol[i], symbol[after[i]]))

        note(list(range(n - 1)))
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            note([before[i], i])
        return [s for s in symbol if s >= 0]

    def learn(self, words: list[bytes]) -> None:
        """Encode new distinct words together."""
        texts = [w.decode() for w in words]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        at, there = member(self.t.char_points, points)
        symbol = np.where(there, self.t.char_symbols[at], (1 << 22) + points)  # the rest never merges
        symbol, sizes = self.rounds(symbol, np.fromiter(map(len, texts), np.int64, len(texts)))
        size = len(self.t.leading)
        odd = np.flatnonzero(symbol >= size)
        if len(odd):  # symbols that are no pieces: their bytes
            chars = dict(zip(self.t.char_symbols.tolist(), self.t.char_points.tolist(), strict=True))
            spelled = [self.t.byte_ids[np.frombuffer(chr(s - (1 << 22) if s >= 1 << 22 else chars[s]).encode(), np.uint8)] for s in symbol[odd].tolist()]
            width = np.ones(len(symbol), np.int64)
            width[odd] = [len(s) for s in spelled]
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(width)])
            sizes = total[ends] - total[ends - sizes]
            out = np.repeat(symbol, width)
            out[ragged(total[odd], width[odd])] = np.concatenate(spelled)
            symbol = out
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, symbol.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, sizes])

    # --- whole texts ----------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more entry than texts)."""
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words, firsts = self.split(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        word = number[coded.indices.to_numpy()]
        length = self.lengths[word]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[ragged((np.cumsum(self.lengths) - self.lengths)[word], length)], total[firsts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.t.leading)):
            raise ValueError("id outside the vocabulary")
        begin = self.t.surface_starts[ids]
        length = self.t.surface_starts[ids + 1] - begin
        data = self.t.surfaces[ragged(begin, length)].tobytes()
        at = np.concatenate([[0], np.cumsum(length)])
        filled = np.flatnonzero(length)
        place = np.searchsorted(filled, starts[:-1])
        head = filled[np.minimum(place, len(filled) - 1)] if len(filled) else np.zeros(len(place), np.int64)
        drop = (place < len(filled)) & (head < starts[1:])
        drop[drop] = self.t.leading[ids[head[drop]]]
        silent = np.concatenate([[0], np.cumsum(length == 0)])[starts]  # control ids part the bytes around them
        out = []
        for k, (a, b, d) in enumerate(zip(at[starts[:-1]].tolist(), at[starts[1:]].tolist(), drop.tolist(), strict=True)):
            try:
                text = data[a + d : b].decode() if silent[k] == silent[k + 1] else None
            except UnicodeDecodeError:
                text = None
            out.append(self.mend(ids[starts[k] : starts[k + 1]])[int(d) :] if text is None else text)
        return out

    def mend(self, ids: np.ndarray) -> str:
        """Decoded ids of which some bytes form no character."""
        cut = np.flatnonzero(np.diff(self.t.is_byte[ids].astype(np.int8))) + 1
        parts = []
        for run in np.split(ids, cut):
            data = b"".join(self.t.surfaces[self.t.surface_starts[i] : self.t.surface_starts[i + 1]].tobytes() for i in run.tolist())
            k = 0
            while k < len(data):
                for n in range(1, 5):
                    try:
                        parts.append(data[k : k + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append(LOST)
                    n = 1
                k += n
        return "".join(parts)


def encode_documents(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """doc_id and ids array<int> for every row of ``docs`` (doc_id, text).

    With ``digests``: doc_id, n_tokens, and the sha256 of the ids and of the text decoded from them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_tables(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RoundEncoder(PieceTables(*shared.value))
        names = [str(i) for i in range(len(encoder.t.leading))]
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                ids, starts = encoder.encode(texts[a:b])
                if not digests:
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.ListArray.from_arrays(starts.astype(np.int32), ids)], ["doc_id", "ids"])
                    continue
                of_ids = [sha256(",".join([names[i] for i in ids[x:y].tolist()]).encode()).hexdigest() for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                of_text = [sha256(t.encode()).hexdigest() for t in encoder.decode(ids, starts)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(np.diff(starts)), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(load_tables(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RoundEncoder(PieceTables(*shared.value))
        for batch in batches:
            rows = [r or [] for r in batch.column("ids").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            flat = np.array([i for r in rows for i in r], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.decode(flat, starts), pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_model(), digests=True)


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
