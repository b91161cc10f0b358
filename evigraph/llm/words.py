"""Words of Arrow batches as numbers, inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20  # of text worked on at a time


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``; a single longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()  # workers live on between stages


# Bytes outside words: ASCII white space, or everything ASCII but letters and digits.
WHITE = frozenset([0x20, *range(0x09, 0x0E)])
MARKS = frozenset(b for b in range(0x80) if not chr(b).isalnum())
BASE = 0x9E3779B97F4A7C55
BLOCK = 1 << 20


class WordHasher:
    """64-bit hashes of the words of texts, straight from the bytes of an Arrow array.

    A word's hash is a polynomial over a random value of each byte (A-Z as a-z), computed for all words at
    once from prefix sums. Words of one text never reach into the next.
    """

    def __init__(self, outside: frozenset[int] = WHITE):
        self.inside = np.array([b not in outside for b in range(256)])
        values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values = values
        self._powers(BLOCK)

    def _powers(self, n: int) -> None:
        def table(base: int) -> np.ndarray:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        self.up, self.down = table(BASE), table(pow(BASE, -1, 1 << 64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's start (one more entry than texts); null texts have none."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = self.inside[data]
        filled = np.diff(offsets) > 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        out = np.zeros(len(begin), np.uint64)
        at = 0
        while at < len(begin):
            upto = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, side="right")))
            low, high = int(begin[at]), int(end[upto - 1])
            if high - low > len(self.up):
                self._powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[data[low:high]] * self.up[: high - low], out=sums[1:])
            a, b = begin[at:upto] - low, end[at:upto] - low
            out[at:upto] = (sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64)
            at = upto
        return mix(out), np.searchsorted(begin, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads the bits of sums and products."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, starts: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text, and where each text's start.

    With ``short`` a text of 1 to n-1 words has one n-gram, its whole sequence.
    """
    lengths = np.diff(starts)
    counts = np.maximum(lengths - n + 1, (lengths > 0).astype(np.int64) if short else 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(starts[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    size = np.minimum(np.repeat(lengths, counts), n) if short else None
    out = np.zeros(len(first), np.uint64)
    last = max(len(words) - 1, 0)
    for i in range(n):
        step = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + i, last)] + np.uint64(i + 1)) if len(first) else out
        out = step if size is None else np.where(size > i, step, out)
    return out, begin
