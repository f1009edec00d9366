"""64-bit hashes of words and of runs of words, vectorised over the buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, unless one text alone has more.
BYTES = 2 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def rolled(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k words running (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64), seed + 1) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * factors[j]
    return mixed(out, seed)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTERS = mixed(np.arange(256, dtype=np.uint64), 21)
_LETTERS[_SPACE] = 0
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of an odd number; multiplied in, they tell the places of a word's letters apart."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([[1], np.full(2 * n, 0x5851F42D4C957F2D)]).astype(np.uint64))
    return _powers


@dataclass
class Words:
    """The words (runs of anything but space and \\t to \\r) of a stretch of texts: a hash each, and which text each is in.

    first: for each text, the number of its first word among all; one more at the end.
    """

    hashes: np.ndarray
    first: np.ndarray
    text: np.ndarray

    def runs(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Begins and hashes of the runs of k words that lie in one text."""
        hashes = rolled(self.hashes, k, seed)
        begins = np.flatnonzero(self.text[: len(hashes)] == self.text[k - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        return begins, hashes[begins]


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """fold: A to Z count as a to z. Nulls have no words."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low = int(offsets[0])
    raw = np.frombuffer(data, np.uint8)[low : int(offsets[-1])] if data is not None and offsets[-1] > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = inside[edges]  # a text's first letter begins a word, whatever the text before ends with
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64))
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(begins, at, 0))
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat((_FOLDED if fold else _LETTERS)[raw] * _powers_to(int(place.max()) + 1)[place], starts)
    first = np.searchsorted(starts, offsets)
    return Words(mixed(hashes, 5), first, np.repeat(np.arange(len(texts)), np.diff(first)))


def stretches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about `size` bytes at most."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        group, begin = (np.cumsum(lengths) - lengths) // size, 0
        for end in [*np.flatnonzero(np.diff(group)) + 1, len(group)]:
            if end > begin:
                yield batch.slice(begin, int(end) - begin)
            begin = int(end)
