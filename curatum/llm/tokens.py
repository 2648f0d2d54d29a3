"""Vectorised word hashing of whole texts.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; its
64-bit hash is a polynomial over per-byte random values, finished by a mixer. All work is
done by numpy on the UTF-8 bytes of a batch of texts, without a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .support import release_memory

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing mixer: a bijection of 64-bit values whose every output bit depends on every input bit."""
    x = np.array(x, dtype=_U)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U) * _U(_R)) | _U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_BYTE = _byte_values()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        tables = []
        for base in (_R, _RINV):
            t = np.full(size, base, dtype=_U)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=_U))
        _powers = (tables[0], tables[1])
    return _powers


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22):
    """Parts of a batch with about ``limit`` bytes in a text column, at least one row each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(sizes) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(sizes)), strict=True):
        yield batch.slice(int(a), int(b - a))
    release_memory()


def _hash_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])  # the byte before each start, the last byte of each word
    before, last = edges[0::2], edges[1::2]
    up, down = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=_U)
        words = mix((sums[last] - sums[before]) * down[before])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    bounds = np.searchsorted(before, np.concatenate(([0], ends)), side="left")
    return words, np.diff(bounds)


def word_hashes(texts: list[bytes], block_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text."""
    words, counts, block, size = [], [], [], 0
    for t in texts:
        block.append(t)
        size += len(t) + 1
        if size >= block_bytes:
            w, c = _hash_block(block)
            words.append(w)
            counts.append(c)
            block, size = [], 0
    if block:
        w, c = _hash_block(block)
        words.append(w)
        counts.append(c)
    if not counts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(counts)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, flattened, and their number per text.

    A text of 1 to k-1 words has one shingle, its whole sequence; a text without words has none.
    """
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    n = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), _U)
        for j in range(k):
            rolled = rolled * _U(_R) + words[j : j + len(rolled)]
        rolled = mix(rolled)
        for i, (s, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
            if c >= k:
                own = np.unique(rolled[s : s + c - k + 1])
            elif c:
                h = _U(c)
                for w in words[s : s + c]:
                    h = h * _U(_R) + w
                own = mix(np.array([h ^ _U(0x5851F42D4C957F2D)], dtype=_U))
            else:
                continue
            parts.append(own)
            sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), sizes
