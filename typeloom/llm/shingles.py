"""Sets of hashed word shingles, vectorised over Arrow batches.

Words are maximal runs of characters other than blank and the control characters 9
to 13, with A to Z lower-cased. A shingle is ``k`` words in a row; a text with
fewer words (and at least one) has its whole sequence as its only shingle; a text
without words has none.

Each word is hashed by a polynomial over table values of its bytes, so all words of
a batch come from one running sum. Modulo 2^64 there are long words whose
polynomials agree at any base, so words of more than ``LONG`` bytes get xxhash
instead. All hashes have 64 bits and a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
LONG = 24
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    def __init__(self, k: int, seed: int = 0):
        self.k, self.seed = k, seed
        random = np.random.Generator(np.random.PCG64(seed))
        self.bytes = random.integers(0, 1 << 64, 256, dtype=U, endpoint=False) | U(1)
        self.weights = random.integers(0, 1 << 64, k, dtype=U) | U(1)
        self.short = random.integers(0, 1 << 64, k + 1, dtype=U)
        self.powers = self.inverses = np.ones(1, dtype=U)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            self.powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE, U)]))
            self.inverses = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _INVERSE, U)]))

    def hash_words(self, whole: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of words in an array of UTF-8 bytes; ``ends`` are places of last bytes."""
        self._reach(len(whole) + 1)
        lower = _LOWER[whole]
        sums = np.zeros(len(whole) + 1, dtype=U)
        np.cumsum(self.bytes[lower] * self.powers[: len(whole)], out=sums[1:])
        words = mix((sums[ends + 1] - sums[begins]) * self.inverses[begins])
        long = np.flatnonzero(ends - begins >= LONG)
        if len(long):
            words[long] = [xxhash.xxh3_64_intdigest(lower[a : b + 1].tobytes(), self.seed) for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        return words

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted shingle hashes of each text of an Arrow string array (null: none)."""
        offsets, whole = utf8_of(texts)
        if not len(whole):
            for _ in range(len(texts)):
                yield np.empty(0, U)
            return
        begins, ends = words_of(whole, offsets, _SPACE)
        words = self.hash_words(whole, begins, ends)
        firsts = np.searchsorted(begins, offsets)
        k = self.k
        runs = np.zeros(max(0, len(words) - k + 1), dtype=U)
        for j in range(k):
            runs += words[j : j + len(runs)] * self.weights[j]
        runs = mix(runs)
        for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * self.weights[: b - a]).sum(dtype=U, keepdims=True) + self.short[b - a])
            else:
                yield np.empty(0, U)


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the last one ends), and the bytes of all."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], whole


def words_of(whole: np.ndarray, offsets: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last byte of each word; words end at the bytes that ``spaces`` marks and at ends of texts."""
    word = ~spaces[whole]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(whole))]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def set_digest(hashes: np.ndarray, salt: int) -> int:
    """64 bits of a set as a signed number; independent for different salts."""
    total = mix(hashes ^ U(salt)).sum(dtype=U) if len(hashes) else U(0)
    return int(mix(np.array([total + U(len(hashes))], dtype=U)).view(np.int64)[0])
