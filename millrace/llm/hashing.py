"""64-bit hashes of word sequences, computed for whole slices of documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from millrace.llm.arrowio import words_of

_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin."""
    words, at = words_of(text)
    names = words.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return (table[words.indices.to_numpy()] if len(names) else table), at


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of the `size` numbers from each place on; the last size - 1 places are
    unfinished. Windows double in length, so the cost grows with the logarithm of the size."""
    total, done, power = np.zeros(len(h), np.uint64), 0, 1
    block, width = h, 1
    bits = size
    while bits:
        if bits & 1:
            part = np.zeros(len(h), np.uint64)
            part[: len(h) - done] = block[done:] if done else block
            total = total + part * np.uint64(power)
            power = power * pow(_BASE, width, 1 << 64) % (1 << 64)
            done += width
        bits >>= 1
        if bits:
            longer = block.copy()
            longer[:-width] += block[width:] * np.uint64(pow(_BASE, width, 1 << 64))
            block, width = longer, 2 * width
    return mixed(total)


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's `size`-word shingles; with fewer words the whole
    sequence is one; none without words."""
    h, at = word_hashes(text)
    w = window_hashes(h, size)
    none = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(w[a : b - size + 1]))
        elif b > a:
            out.append(mixed(window_hashes(h[a:b], b - a)[:1] + np.uint64(b - a)))
        else:
            out.append(none)
    return out
