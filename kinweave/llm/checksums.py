"""CRC-32C of many byte strings at once, and its masked form used in length-delimited record files.

A checksum is linear, so a string is cut into blocks, all blocks are reduced together by halving, and the blocks
of a string are joined by the operator that appends zero bytes. Tables are derived from the polynomial.
"""

from __future__ import annotations

import functools

import numpy as np

_POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli, bits reversed
_MASK_DELTA = 0xA282EAD8  # fixed value: the constant of the masked form
_BLOCK = 256  # bytes
_LEVELS = 6  # 64 words of four bytes in a block


def _apply_bits(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map whose images of single bits are ``columns``."""
    out = np.zeros_like(values)
    for k in range(32):
        out ^= np.where((values >> np.uint32(k)) & np.uint32(1), columns[k], np.uint32(0))
    return out


@functools.cache
def _zero_columns(power: int) -> np.ndarray:
    """Images of single bits under appending 2**power zero bytes."""
    if power == 0:
        value = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        for _ in range(8):
            value = np.where(value & np.uint32(1), (value >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), value >> np.uint32(1))
        return value.astype(np.uint32)
    half = _zero_columns(power - 1)
    return _apply_bits(half, half)


@functools.cache
def _zero_tables(power: int) -> tuple[np.ndarray, np.ndarray]:
    """The same map as two tables, for the low and the high 16 bits."""
    low = np.arange(1 << 16, dtype=np.uint32)
    return _apply_bits(_zero_columns(power), low), _apply_bits(_zero_columns(power), low << np.uint32(16))


def _append_zeros(values: np.ndarray, power: int) -> np.ndarray:
    low, high = _zero_tables(power)
    halves = np.ascontiguousarray(values).view(np.uint16)
    return low[halves[0::2]] ^ high[halves[1::2]]


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The checksum of each string, as unsigned 32-bit integers."""
    n = len(strings)
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    blocks = -(-lengths // _BLOCK)
    # zero bytes in front of a string do not change its part of the checksum
    data = b"".join(x for s in strings for x in (bytes(-len(s) % _BLOCK), s))
    words = np.frombuffer(data, dtype="<u4")
    part = _append_zeros(words, 2)
    for level in range(_LEVELS):
        part = _append_zeros(part[0::2], level + 2) ^ part[1::2]
    first = np.cumsum(blocks) - blocks
    out = np.zeros(n, dtype=np.uint32)
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    for k in range(int(sizes[0]) if n else 0):
        live = order[: np.searchsorted(-sizes, -k, side="left")]
        out[live] = _append_zeros(out[live], 8) ^ part[first[live] + k]
    # what the all-ones start value has become after the string's length
    start = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for power in range(int(lengths.max()).bit_length() if n else 0):
        has = (lengths >> power) & 1 == 1
        start[has] = _append_zeros(start[has], power)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(checksums: np.ndarray) -> np.ndarray:
    c = checksums.astype(np.uint64)
    turned = ((c >> np.uint64(15)) | (c << np.uint64(17))) & np.uint64(0xFFFFFFFF)
    return ((turned + np.uint64(_MASK_DELTA)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
