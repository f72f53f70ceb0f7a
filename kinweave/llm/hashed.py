"""Hashed counts of byte n-grams, the features of the two classifiers."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint32(2654435761)  # fixed value: Knuth's multiplicative hash


def byte_ngrams(data: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Counts of the ``order``-byte runs of ``data`` in ``buckets`` (a power of two) hash buckets."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(buckets, dtype=np.int64)
    code = data[:n].astype(np.uint32)
    for k in range(1, order):
        code = code * np.uint32(257) + data[k : k + n]
    code *= _MULTIPLIER
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    return np.bincount(code >> shift, minlength=buckets)
