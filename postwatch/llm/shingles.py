"""Sets of word n-grams and their MinHash signatures."""

from __future__ import annotations

import math

import numpy as np

from postwatch.llm import common

#: Words of a shingle, and the similarity from which two documents are near duplicates.
SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
#: Share of pairs at just that similarity that must become candidates, and hashes to spend on it.
TARGET_RECALL = 0.999
MOST_HASHES = 96


def bands_for(least: float = LEAST_SIMILARITY, recall: float = TARGET_RECALL,
              most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands that reach the recall within so many hashes.

    A pair of similarity s shares a band of r rows with probability s ** r, so b bands miss it with
    probability (1 - s ** r) ** b. Longer bands give fewer false candidates.
    """
    best = (max(1, most), 1)
    for rows in range(1, most + 1):
        hit = least**rows
        if hit < 1e-9:
            break
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def sets(hashes: np.ndarray, starts: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, given its word hashes.

    A text of fewer words than a shingle has one, of all its words; one without words has none.
    """
    factors = common.mix(np.arange(width, dtype=np.uint64), 77) | np.uint64(1)
    whole = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for place in range(width):
        whole += hashes[place: place + len(whole)] * factors[place]
    whole = common.mix(whole)
    out = []
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if stop - start >= width:
            out.append(np.unique(whole[start: stop - width + 1]))
        elif stop > start:
            mixed = (hashes[start:stop] * factors[: stop - start]).sum(dtype=np.uint64)
            out.append(common.mix(np.array([mixed]), stop - start))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(found: np.ndarray) -> bytes:
    """128 bits that equal sets share, whatever their order."""
    sums = [common.mix(found, seed).sum(dtype=np.uint64) for seed in (101, 202)]
    return np.array(sums, "<u8").tobytes()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        self.bands, self.rows = bands, rows
        number = np.arange(2 * bands * rows, dtype=np.uint64)
        drawn = common.mix(number, seed)
        self.factor = drawn[: bands * rows] | np.uint64(1)
        self.shift = drawn[bands * rows:]

    def lowest(self, found: np.ndarray) -> np.ndarray:
        """The least value of each hash function over a set that is not empty."""
        best = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(found), 1024):
            values = found[start: start + 1024, None] * self.factor
            values += self.shift
            best = np.minimum(best, values.min(0))
        return best

    def band_hashes(self, best: np.ndarray) -> np.ndarray:
        out = np.zeros(self.bands, np.uint64)
        for row in best.reshape(self.bands, self.rows).T:
            out = common.mix(out ^ row, 5)
        return common.mix(out + np.arange(self.bands, dtype=np.uint64), 6)

    @staticmethod
    def short(best: np.ndarray) -> np.ndarray:
        """16 bits of each, by which similarity is estimated."""
        return (best >> np.uint64(48)).astype("<u2")


def components(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. size - 1 is connected with."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label
