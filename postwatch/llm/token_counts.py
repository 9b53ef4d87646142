"""Token counts by merging whole batches of pre-tokens rank by rank.

Pre-tokens that a worker has not seen are laid out as one flat array of symbols with a row number
each. In a round every row applies its own lowest-ranked pair everywhere it occurs, all rows at
once; a row without a mergeable pair is done, and the symbols it has left are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postwatch.llm import common
from postwatch.llm.pieces import pieces

VOCABULARY_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
KEPT_PIECES = 400_000
NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies, by rule.

    Printable Latin characters stand for themselves, the other bytes for code points from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary's merges, by pair of symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: list, special: list[str]):
        letters = byte_letters()
        self.special = [x.encode() for x in special]
        self.symbols = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.symbols[byte] = vocabulary[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.table = common.Lookup((left << 32) | right, np.arange(len(pairs)))
        self.merged = np.append(merged, -1)
        self.known: dict[bytes, int] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where it does not merge."""
        ranks = self.table.find((left << 32) | right)
        return np.where(ranks < 0, NEVER, ranks), self.merged[ranks]

    def count(self, found: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = sizes.copy()
        rows = np.repeat(np.arange(len(found)), sizes)
        symbols = self.symbols[np.frombuffer(b"".join(found), np.uint8)]
        ranks, merged = self.pair(symbols, rows, np.arange(len(symbols)))
        while len(symbols):
            heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            lowest = np.minimum.reduceat(ranks, heads)
            widths = np.diff(np.append(heads, len(rows)))
            out[rows[heads]] = widths
            live = lowest != NEVER
            if not live.all():  # finished rows leave
                stay = np.repeat(live, widths)
                symbols, rows, ranks, merged = (x[stay] for x in (symbols, rows, ranks, merged))
                lowest, widths = lowest[live], widths[live]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, widths)
            # Equal neighbours such as "aaa" overlap: from the left, every other pair merges.
            chained = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(chained):
                position = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), position, 0))
                hit &= (position - begin) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, rows, ranks, merged = (x[keep] for x in (symbols, rows, ranks, merged))
            new = moved[at]
            before = new[new > 0] - 1
            touched = np.unique(np.concatenate((before, new)))
            ranks[touched], merged[touched] = self.pair(symbols, rows, touched)
        return out

    def pair(self, symbols, rows, at) -> tuple[np.ndarray, np.ndarray]:
        following = np.minimum(at + 1, len(symbols) - 1)
        ranks, merged = self.find(symbols[at], symbols[following])
        alone = (following == at) | (rows[following] != rows[at])
        return np.where(alone, NEVER, ranks), merged

    def count_pieces(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        held = list(map(known.get, found))
        if None in held:
            fresh = list({piece for piece, n in zip(found, held, strict=True) if n is None})
            made = dict(zip(fresh, self.count(fresh).tolist(), strict=True))
            held = [made[piece] if n is None else n for piece, n in zip(found, held, strict=True)]
            if len(known) + len(made) > KEPT_PIECES:
                known.clear()
            known.update((piece, n) for piece, n in made.items() if len(piece) <= 64)
        return np.array(held, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """A byte-level BPE vocabulary that every executor has at this path."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [x["content"] for x in spec.get("added_tokens") or []]
    return Merges(spec["model"]["vocab"], spec["model"]["merges"], special)


def segments(data: bytes, offsets: np.ndarray, special: list[bytes]) -> tuple:
    """Texts cut at special strings: their bytes, offsets, the text of each, and strings per text.

    Each special string is one token, found from the left, a longer one first where two start.
    """
    count = len(offsets) - 1
    extra = np.zeros(count, np.int64)
    if not any(mark in data for mark in special):
        return data, offsets, np.arange(count), extra
    parts, owners = [], []
    marks = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    for row in range(count):
        text, start = data[offsets[row]: offsets[row + 1]], 0
        for found in marks.finditer(text):
            parts.append(text[start: found.start()])
            owners.append(row)
            extra[row] += 1
            start = found.end()
        parts.append(text[start:])
        owners.append(row)
    return (b"".join(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))),
            np.array(owners), extra)


def count_texts(texts: pa.Array, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    data, offsets = common.ragged(texts)
    cut, bounds, owners, extra = segments(data.tobytes(), offsets, merges.special)
    found, starts = pieces(cut, bounds)
    sums = np.concatenate(([0], np.cumsum(merges.count_pieces(found))))
    tokens = extra
    np.add.at(tokens, owners, sums[starts[1:]] - sums[starts[:-1]])
    return np.diff(offsets), tokens


def count_tokens(docs: DataFrame, name: str = VOCABULARY_FILE,
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text, one row per row.

    A null or empty text has no bytes and no tokens. A special string inside a text counts as one
    token; a text of nothing else is passed over once. Repeated rows and a null ``doc_id`` pass through; other columns are not read. Map-only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(public_tokenizers.path(name))
        for block in common.blocks(batches):
            size, tokens = count_texts(block.column("text"), merges)
            yield common.record_batch(schema, [block.column("doc_id"), size, tokens, tokens > limit])

    return common.documents(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
