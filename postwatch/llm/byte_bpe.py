"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a pre-token has one valid encoding, so it has one valid last token, and the
encoding of a prefix is its last token after the encoding of what stands before that token. A table
of last tokens is therefore the whole state: bytes can be appended without looking back, and after
an edit rows are computed anew only until they agree with the old ones again.

A token can end a prefix if it is a suffix of it and no merge would cross the place where it meets
the last token before. Which token that is does not depend on anything further left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.llm.pieces import pieces

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose encoding a worker keeps; beyond it the memory is emptied and filled again.
KEPT_PIECES = 300_000
KEPT_PAIRS = 1_000_000
#: Pre-tokens whose tables are filled together, and bytes from which one is filled alone.
PIECES_AT_ONCE = 20_000
LONG_PIECE = 200
NEVER = 1 << 60


class Ranks:
    """A vocabulary of byte strings with merge ranks, which are their ids too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.decoded = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.known: dict[bytes, bytes] = {}
        self.held: dict[tuple[int, int], bool] = {}
        self.borders = common.Lookup()
        self._suffixes()
        self._merges()

    def _suffixes(self) -> None:
        """A trie of reversed tokens: (node, byte before) to node, and the token at each node."""
        nodes: dict[int, int] = {}
        tokens = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in nodes:
                    nodes[key] = len(tokens)
                    tokens.append(-1)
                node = nodes[key]
            tokens[node] = rank
        self.steps = common.Lookup(list(nodes), list(nodes.values()))
        self.step_of = nodes
        self.token_at = np.array(tokens, np.int64)

    def _merges(self) -> None:
        """Ranks of all pairs of tokens that merge, and the parts at both ends of each token.

        While a token is built, a part stands at its end until the rank of the merge that takes it.
        """
        get = self.ranks.get
        pairs, made = [], []
        halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            splits = [(get(token[:i]), get(token[i:])) for i in range(1, len(token))]
            splits = [(a, b) for a, b in splits if a is not None and b is not None]
            pairs += [a << 32 | b for a, b in splits]
            made += [rank] * len(splits)
            if len(splits) == 1:
                halves[rank] = splits[0]
            elif splits:
                halves[rank] = self._last_merge(token)
        self.merged = common.Lookup(pairs, made, NEVER)
        self.ends = []
        for side in (0, 1):
            chains: dict[int, list[tuple[int, int]]] = {}
            for rank in range(max(self.decoded) + 1):  # parts have lower ranks than the whole
                below = chains[halves[rank][side]] if rank in halves else []
                chains[rank] = [(rank, NEVER)]
                if below:
                    chains[rank] += [(below[0][0], rank), *below[1:]]
            depth = max(map(len, chains.values()))
            parts = np.full((depth, len(chains)), -1, np.int64)
            until = np.zeros((depth, len(chains)), np.int64)
            for rank, chain in chains.items():
                for level, (part, end) in enumerate(chain):
                    parts[level, rank], until[level, rank] = part, end
            self.ends.append((parts, until))

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        parts = [token[i: i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranked.index(min(ranked))
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def border(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens can stand side by side: no merge happens across their border.

        Parts at the border coexist until one is merged away; a cross merge of lower rank comes
        first, and of equal ranks the leftmost does.
        """
        fine = np.ones(len(left), bool)
        (a_parts, a_until), (b_parts, b_until) = self.ends[1], self.ends[0]
        for i in range(len(a_parts)):
            rows = np.flatnonzero(fine & (a_parts[i, left] >= 0))
            for j in range(len(b_parts)):
                rows = rows[b_parts[j, right[rows]] >= 0]
                if not len(rows):
                    break
                rank = self.merged.find(a_parts[i, left[rows]] << 32 | b_parts[j, right[rows]])
                crossed = (rank < a_until[i, left[rows]]) & (rank <= b_until[j, right[rows]])
                crossed &= rank != NEVER
                fine[rows[crossed]] = False
                rows = rows[~crossed]
        return fine

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``border``, remembered; what the memory loses when it is emptied is not looked up again."""
        keys = left << 32 | right
        held = self.borders.find(keys)
        unknown = np.flatnonzero(held < 0)
        if len(unknown):
            fresh, at = np.unique(keys[unknown], return_inverse=True)
            made = self.border(fresh >> 32, fresh & 0xFFFFFFFF).astype(np.int64)
            held[unknown] = made[at]
            if self.borders.size + len(fresh) > KEPT_PAIRS:
                self.borders.clear()
            self.borders.insert(fresh, made)
        return held > 0

    def joins(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.held:
            if len(self.held) >= KEPT_PAIRS:
                self.held.clear()
            self.held[key] = bool(self.border(np.array([left]), np.array([right]))[0])
        return self.held[key]

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> None:
        """Fill the table ``last`` from its length up to ``until`` bytes of ``data``."""
        for end in range(len(last), len(data) if until is None else until):
            node, found = 0, []
            for begin in range(end, -1, -1):
                node = self.step_of.get(node << 8 | data[begin], -1)
                if node < 0:
                    break
                if self.token_at[node] >= 0:
                    found.append((begin, int(self.token_at[node])))
            for begin, token in reversed(found):  # a longer one first
                if begin == 0 or self.joins(last[begin - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def trace(self, last: list[int]) -> list[int]:
        found, at = [], len(last)
        while at:
            token = last[at - 1]
            found.append(token)
            at -= len(self.decoded[token])
        return found[::-1]

    def tables(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last tokens of all prefixes of many pre-tokens, longest first, and each one's place."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        within = np.arange(len(data)) - np.repeat(starts, sizes)
        # Tokens that end at each byte, by length.
        ending, places, node = [], np.arange(len(data)), np.zeros(len(data), np.int64)
        while len(places):
            node = self.steps.find(node << 8 | data[places - len(ending)])
            live = node >= 0
            places, node = places[live], node[live]
            tokens = np.full(len(data), -1, np.int32)
            tokens[places] = self.token_at[node]
            ending.append(tokens)
            live = within[places] >= len(ending)
            places, node = places[live], node[live]
        last = np.zeros(len(data), np.int32)
        for end in range(int(sizes[0]) if len(sizes) else 0):
            open_ = starts[: np.searchsorted(-sizes, -end, "left")] + end
            for size in range(min(end + 1, len(ending)), 0, -1):
                tokens = ending[size - 1][open_]
                rows = np.flatnonzero(tokens >= 0)
                if not len(rows):
                    continue
                if size <= end:
                    before = last[open_[rows] - size].astype(np.int64)
                    rows = rows[self.joined(before, tokens[rows].astype(np.int64))]
                last[open_[rows]] = tokens[rows]
                open_ = np.delete(open_, rows)
                if not len(open_):
                    break
        return last, starts, sizes

    def encode_many(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pre-tokens as little-endian unsigned 32-bit integers."""
        out = {}
        for piece in found:
            token = self.ranks.get(piece)
            if token is not None:
                out[piece] = token.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                last: list[int] = []
                self.extend(piece, last)
                out[piece] = np.array(self.trace(last), "<u4").tobytes()
        rest = sorted((piece for piece in found if piece not in out), key=len, reverse=True)
        size = np.zeros(max(self.decoded) + 1, np.int64)
        size[list(self.decoded)] = [len(x) for x in self.decoded.values()]
        for start in range(0, len(rest), PIECES_AT_ONCE):
            chunk = rest[start: start + PIECES_AT_ONCE]
            last, begins, widths = self.tables(chunk)
            at, rows, steps = begins + widths, np.arange(len(chunk)), []
            while len(rows):  # backwards through all tables at once
                tokens = last[at[rows] - 1]
                steps.append((rows, tokens))
                at[rows] -= size[tokens]
                rows = rows[at[rows] > begins[rows]]
            counts = np.bincount(np.concatenate([rows for rows, _ in steps]), minlength=len(chunk))
            ends = np.cumsum(counts)
            flat = np.zeros(int(ends[-1]), "<u4")
            for back, (rows, tokens) in enumerate(steps):
                flat[ends[rows] - 1 - back] = tokens
            held, bounds = flat.tobytes(), [0, *(4 * ends).tolist()]
            out.update(zip(chunk, (held[a:b] for a, b in zip(bounds, bounds[1:], strict=False)),
                           strict=True))
        return out

    def encode_pieces(self, found: list[bytes]) -> list[bytes]:
        known = self.known
        held = list(map(known.get, found))
        fresh = {piece for piece, ids in zip(found, held, strict=True) if ids is None}
        if fresh:
            if len(known) + len(fresh) > KEPT_PIECES:
                known.clear()
            made = self.encode_many(list(fresh))
            held = [made[piece] if ids is None else ids
                    for piece, ids in zip(found, held, strict=True)]
            known.update((piece, ids) for piece, ids in made.items() if len(piece) <= 64)
        return held


class PrefixTable:
    """The encoding of one growing or edited pre-token."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, data, []
        ranks.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.ranks.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for bytes start to stop; the number of rows that had to be computed.

        Rows before the edit stay. Behind it, once as many rows in a row as the longest token has
        bytes repeat the old ones, all others do too, since no row looks back further.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        self.ranks.extend(self.data, self.last, start + len(new))
        same = 0
        while len(self.last) < len(self.data) and same < self.ranks.longest:
            at = len(self.last)
            self.ranks.extend(self.data, self.last, at + 1)
            same = same + 1 if self.last[at] == old[at - shift] else 0
        made = len(self.last) - start
        self.last += old[len(self.last) - shift:]
        return made

    def tokens(self) -> list[int]:
        return self.ranks.trace(self.last)


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    """A rank file that every executor has at this path, as part of its Python installation."""
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def rank_path(name: str = RANK_FILE) -> str:
    return public_tokenizers.path(name)


def encoded(
    texts: pa.Array, ranks: Ranks, pattern: str = public_tokenizers.PATTERN
) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    data, offsets = common.ragged(texts)
    found, bounds = pieces(data.tobytes(), offsets, pattern)
    ids = ranks.encode_pieces(found)
    bounds = bounds.tolist()
    for start, stop in zip(bounds, bounds[1:], strict=False):
        yield b"".join(ids[start:stop])


def decode(ids: bytes, ranks: Ranks) -> bytes:
    return b"".join(map(ranks.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, name: str = RANK_FILE,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token ids of every whole text: ``(doc_id, ids binary, n_tokens)``, one row per row.

    ``ids`` holds little-endian unsigned 32-bit integers. A null or empty text has none. Special
    tokens are ordinary text. Repeated rows and a null ``doc_id`` pass through; other columns of
    ``docs`` are not read. Map-only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(rank_path(name))
        for block in common.blocks(batches):
            ids = list(encoded(block.column("text"), ranks, pattern))
            yield common.record_batch(
                schema, [block.column("doc_id"), ids, [len(x) // 4 for x in ids]]
            )

    return common.documents(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decoded(ids: DataFrame, name: str = RANK_FILE) -> DataFrame:
    """Bytes of every row of ``(doc_id, ids)``: ``(doc_id, data binary)``; null ids have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(rank_path(name))
        for block in common.blocks(batches, "ids"):
            data = [decode(x or b"", ranks) for x in block.column("ids").to_pylist()]
            yield common.record_batch(schema, [block.column("doc_id"), data])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, name: str = RANK_FILE) -> DataFrame:
    """Digests of the ids of every text and of the bytes that decoding them gives back.

    Encoding and decoding happen in one pass, so that neither ids nor bytes leave a task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(rank_path(name))
        for block in common.blocks(batches):
            counts, sums, back = [], [], []
            for ids in encoded(block.column("text"), ranks):
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decode(ids, ranks)).hexdigest())
            yield common.record_batch(schema, [block.column("doc_id"), counts, sums, back])

    return common.documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
