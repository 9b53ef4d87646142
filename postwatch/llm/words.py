"""Hashes of the words of many texts at once.

Words are runs of ASCII letters, digits and non-ASCII characters; A to Z are lower-cased.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG_WORD = 64
BASE, SEED = 0x9E3779B97F4A7C15, 0xCBF29CE484222325


def lowered() -> np.ndarray:
    """For each byte: 0 between words, else the byte with A to Z lower-cased."""
    out = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[first: last + 1] = range(first, last + 1)
    out[0x41:0x5B] = range(0x61, 0x7B)
    return out


LOWERED = lowered().tobytes()
#: Words that are hashed together, so that they stay in the cache.
HASHED_AT_ONCE = 16_384


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the n + 1 positions at which texts start among the words.

    Bytes at the same place of many words are hashed together; the few words of more than
    ``LONG_WORD`` bytes are digested one by one.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = np.frombuffer(data.tobytes().translate(LOWERED), np.uint8)
    inside = letters != 0
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= first[1:] | ~inside[:-1]
    stop[:-1] &= first[1:] | ~inside[1:]
    begins, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sizes = ends - begins
    limited = np.minimum(sizes, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(limited, kind="stable")[::-1]
    size, begin = limited[order], begins[order]
    held = np.full(len(order), SEED, np.uint64)
    for at in range(0, len(order), HASHED_AT_ONCE):
        some, where = held[at: at + HASHED_AT_ONCE], begin[at: at + HASHED_AT_ONCE]
        of_size = np.bincount(size[at: at + HASHED_AT_ONCE], minlength=LONG_WORD + 2)
        longer = len(some) - np.cumsum(of_size)  # than 0, 1, ... bytes; the longest come first
        for count in longer[:LONG_WORD][longer[:LONG_WORD] > 0].tolist():
            part, where = some[:count], where[:count]
            part ^= letters.take(where)
            part *= np.uint64(BASE)
            part ^= part >> np.uint64(29)
            where = where + 1
    hashes = np.empty(len(order), np.uint64)
    hashes[order] = held
    for at in np.flatnonzero(sizes > LONG_WORD).tolist():
        whole = hashlib.blake2b(letters[begins[at]: ends[at]].tobytes(), digest_size=8).digest()
        hashes[at] = int.from_bytes(whole, "little")
    hashes |= np.uint64(1)  # 0 stands between texts
    return hashes, np.searchsorted(begins, offsets)
