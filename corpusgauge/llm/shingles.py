"""Sets of hashed word shingles, computed for a batch of texts at a time."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Text hashed at a time: the arrays are several times as large.
BATCH_BYTES = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_random = np.random.default_rng(20260101)
LETTERS = _random.integers(0, 2**64, 256, np.uint64)
LETTERS[65:91] = LETTERS[97:123]  # A-Z count as a-z
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(STEPS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(STEPS[1])
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def first_powers(n: int, base: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, from a table of a few lengths."""
    return powers(1 << max(n - 1, 1).bit_length(), base)[:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of words up to each text's end.

    Words are runs of bytes other than blank and control gaps, A-Z as a-z.
    """
    texts = pa.concat_arrays([texts])  # offsets from 0
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    size = int(ends[-1])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[:size]
    solid = ~GAP[data]
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    stops = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    total = np.empty(size + 1, np.uint64)
    total[0] = 0
    np.add.accumulate(LETTERS[data] * first_powers(size, MULTIPLIER), out=total[1:])
    back = first_powers(size, pow(MULTIPLIER, -1, 2**64))
    hashes = mixed((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, ends[1:])


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text its distinct k-word shingles as sorted 64-bit hashes; fewer words make one shingle."""
    words, ends = word_hashes(texts)
    begins = np.concatenate(([0], ends[:-1]))
    runs = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        runs += np.roll(words, -j)[: len(runs)] * np.uint64(STEPS[j % 3] + 2 * j)
    runs = mixed(runs)
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= k:
            out.append(np.unique(runs[b : e - k + 1]))
        else:
            whole = sum(int(w) * (STEPS[j % 3] + 2 * j) for j, w in enumerate(words[b:e].tolist())) + (e - b)
            out.append(mixed(np.array([whole % 2**64], np.uint64)) if e > b else np.zeros(0, np.uint64))
    return out
