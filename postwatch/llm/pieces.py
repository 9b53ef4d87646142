"""Cutting text into pre-tokens, many documents at once.

The rule is ``public_tokenizers.PATTERN``. Characters are sorted into four classes by one table, and
the cuts are found by comparing neighbours, so no expression runs per character. A different
pattern is run as it is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
# The endings that the pattern keeps with their apostrophe.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    held = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = "".join(regex.findall(pattern, points))
        held[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return held


def cuts(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte positions in ``data`` at which a pre-token starts, for texts that start at ``offsets``.

    ``data`` is UTF-8; ``offsets`` holds n + 1 ascending positions. No pre-token spans two texts.
    """
    if not data:
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    plain = len(points) == len(data)
    if plain:
        places = None
        starts = offsets[:-1]
    else:
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        places = np.concatenate(([0], np.cumsum(width)))
        starts = np.searchsorted(places, offsets[:-1])
    size = len(points)
    first = np.zeros(size + 1, bool)  # where a text starts, or the last one ends
    first[starts[starts < size]] = True
    first[size] = True
    kind = classes()[points]
    cut = first[:size].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # A run of white space gives its last character away if something follows in the same text:
    # to the next pre-token if it is a blank, else to a pre-token of its own.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:size]) + 1
    cut[after - 1] = True
    cut[after[points[after - 1] == 32]] = False
    # An apostrophe that begins a pre-token takes some endings along and cuts after them.
    marks = np.flatnonzero((points == 39) & cut)
    marks = marks[~first[marks + 1]]
    if len(marks):
        following = points[marks + 1]
        longer = marks + 2 < size
        second = np.where(longer, points[np.minimum(marks + 2, size - 1)], 0)
        second[first[np.minimum(marks + 2, size)]] = 0
        short = np.isin(following, [ord(x) for x in SHORT_ENDINGS])
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            long |= (following == ord(a)) & (second == ord(b))
        for chosen, width in ((short, 2), (long & ~short, 3)):
            found = marks[chosen]
            cut[found + 1] = False
            ends = found + width
            cut[ends[ends < size]] = True
    found = np.flatnonzero(cut)
    return found if plain else places[found]


def pieces(
    data: bytes, offsets: np.ndarray, pattern: str = public_tokenizers.PATTERN
) -> tuple[list[bytes], np.ndarray]:
    """All pre-tokens in order, and the n + 1 positions in that list at which texts start."""
    if pattern == public_tokenizers.PATTERN:
        starts = cuts(data, offsets)
        bounds = [*starts.tolist(), len(data)]
        found = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return found, np.searchsorted(starts, offsets)
    rule, found, counts = regex.compile(pattern), [], [0]
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        found += [x.encode() for x in rule.findall(data[a:b].decode("utf-8"))]
        counts.append(len(found))
    return found, np.asarray(counts)
