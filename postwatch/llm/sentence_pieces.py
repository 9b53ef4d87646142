"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, many texts
at once, and every normalised byte keeps the source byte its unit began at. Pieces are merged on
normalised text; where a piece ends among its bytes tells which source bytes it covers.

Merging follows the scores: of all neighbours that form a piece the best one merges, of equal ones
the leftmost, until none is left. No piece has a white-space mark behind another character (a model
with such pieces is merged text by text), so texts are cut before those marks and what a cut piece
gives is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postwatch.llm import common

MODEL_FILE = "piece_bpe_32k.model"
#: Cut pieces whose ids a worker keeps; beyond it the memory is emptied and filled again.
KEPT_CHUNKS = 300_000
#: Cut pieces that are merged together, and characters from which one is merged alone.
CHUNKS_AT_ONCE = 20_000
LONG_CHUNK = 64
NEVER = np.iinfo(np.int64).max
MARK = "▁"
SPACE = MARK.encode()
REPLACEMENT = "�".encode()
# Kinds of pieces, the model kind and field numbers of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of a protocol-buffer message: integers, or the bytes of the others."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at: at + size]
        at += size


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and the strings it leads to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if blob else None
        self.strings = np.frombuffer(blob, np.uint8, offset=4 + size) if blob else None
        if blob:
            zeros = np.flatnonzero(self.strings == 0)
            at = np.arange(len(self.strings))
            self.sizes = zeros[np.minimum(np.searchsorted(zeros, at), len(zeros) - 1)] - at

    def __bool__(self) -> bool:
        return self.units is not None

    @staticmethod
    def steps(units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 512) >> 6)

    def longest(self, data: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple:
        """For each head the longest known prefix before its end: its bytes (0: none) and string."""
        size, value = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        rows, at = np.arange(len(heads)), heads.copy()
        node = np.full(len(heads), self.steps(self.units[:1])[0])
        while len(rows):
            inside = at < ends[rows]
            rows, at, node = rows[inside], at[inside], node[inside]
            byte = data[at].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            rows, at, node, byte = rows[known], at[known], node[known], byte[known]
            unit = self.units[node]
            known = (unit & (1 << 31 | 255)) == byte
            rows, at, node, unit = rows[known], at[known] + 1, node[known], unit[known]
            node = node ^ self.steps(unit)
            leaf = (unit >> 8 & 1).astype(bool)
            size[rows[leaf]] = at[leaf] - heads[rows[leaf]]
            value[rows[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return size, value


class Model:
    """A vocabulary of scored pieces with its normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        scores, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == PIECES:
                spec = dict(fields(value))
                self.pieces.append(spec[1])
                scores.append(struct.unpack("<f", spec.get(2, bytes(4)))[0])
                self.kinds.append(spec.get(3, NORMAL))
            elif number == TRAINER:
                trainer.update(fields(value))
            elif number == NORMALIZER:
                normalizer.update(fields(value))
        if trainer.get(MODEL_TYPE, 1) != BPE or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("a BPE model without user-defined or unused pieces is needed")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.remove = bool(normalizer.get(REMOVE_SPACES, 1))
        self.escape = bool(normalizer.get(ESCAPE_SPACES, 1))
        self.suffix = bool(trainer.get(SUFFIX_SPACE, 0))
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.surface = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        self.unknown = self.kinds.index(UNKNOWN)
        self.known: dict[bytes, bytes] = {}
        self._merges(np.array(scores))
        self._sizes()

    def _merges(self, scores: np.ndarray) -> None:
        """Symbols are ids of pieces, and beyond them code points that are no piece."""
        _, ranks = np.unique(-scores, return_inverse=True)
        texts = {piece.decode(): i for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True))
                 if kind == NORMAL}
        self.count = len(self.pieces)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.count
        for text, i in texts.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = i
        keys, made, inner = [], [], set()
        for text, i in texts.items():
            for at in range(1, len(text)):
                inner.add(ord(text[at - 1]) << 32 | ord(text[at]))
                sides = [texts.get(part, self.symbol_of[ord(part)] if len(part) == 1 else -1)
                         for part in (text[:at], text[at:])]
                if min(sides) >= 0:
                    keys.append(int(sides[0]) << 32 | int(sides[1]))
                    made.append(i)
        self.table = common.Lookup(keys, np.arange(len(keys)))
        made = np.array(made, np.int64)
        self.made, self.made_rank = np.append(made, -1), np.append(ranks[made].astype(np.int64), NEVER)
        self.pair = dict(zip(keys, zip(self.made_rank.tolist(), self.made.tolist(), strict=False), strict=False))
        self.inner = common.Lookup(list(inner), np.ones(len(inner)))
        self.cut_at_marks = not any((x & 0xFFFFFFFF) == ord(MARK) and x >> 32 != ord(MARK) for x in inner)
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][3:-1], 16)] = i

    def _sizes(self) -> None:
        """Of each id: what it decodes to, and its normalised bytes (unknown ones vary)."""
        self.shown, self.size = [], np.zeros(self.count, np.int64)
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            self.size[i] = 1 if kind == BYTE else len(piece)
            self.shown.append({CONTROL: b"", UNKNOWN: self.surface}.get(kind, piece.replace(SPACE, b" ")))
            if kind == BYTE:
                self.shown[i] = bytes([int(piece[3:-1], 16)])
        self.digits = [str(i).encode() for i in range(self.count)]

    # --- normalising ---------------------------------------------------------------------------

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Bytes after the character map, the unit start of each, and each text's first byte."""
        head = np.flatnonzero((data & 0xC0) != 0x80)
        begins = head[np.searchsorted(head, np.arange(len(data)), "right") - 1]
        if not self.map:
            return data, begins, offsets
        rows = np.searchsorted(offsets, head, "right") - 1
        size, value = self.map.longest(data, head, offsets[rows + 1])
        hit = np.flatnonzero(size)
        wide = size[hit] > np.diff(np.append(head, len(data)))[hit]
        stop = -1
        if wide.any():  # a match of several characters hides those that begin inside it
            inside = np.zeros(len(hit), bool)
            firsts, lasts = head[hit].tolist(), (head[hit] + size[hit]).tolist()
            for i, (first, last) in enumerate(zip(firsts, lasts, strict=True)):
                if first < stop:
                    inside[i] = True
                else:
                    stop = last
            hit = hit[~inside]
        at, size, value = head[hit], size[hit], value[hit]
        counts = np.ones(len(data), np.int64)
        counts[ranges(at, size)] = 0
        counts[at] = self.map.sizes[value]
        begins[ranges(at, size)] = np.repeat(at, size)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.repeat(data, counts)
        out[ranges(ends[at], counts[at])] = self.map.strings[ranges(value, counts[at])]
        return out, np.repeat(begins, counts), ends[offsets]

    def normalize(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Normalised bytes of many texts, the source place of each, their offsets and source ends.

        Source places count from the start of the block; a text's source end is that of its last
        normalised byte.
        """
        out, source, bounds = self.units(data, offsets)
        ends = offsets[1:].copy()
        blank = out == 32
        if self.remove:
            first = np.zeros(len(out) + 1, bool)
            first[bounds] = True
            before = np.concatenate(([False], blank[:-1])) if len(out) else blank
            drop = blank & (before | first[:-1])
            kept = np.concatenate(([0], np.cumsum(~drop)))
            out, source, bounds = out[~drop], source[~drop], kept[bounds]
            out, source, bounds, ends = self._trim(out, source, bounds, ends)
            blank = out == 32
        space = SPACE if self.escape else b" "
        sizes = np.diff(bounds)
        counts = np.where(blank, len(space), 1)
        filled = np.flatnonzero(sizes) if self.prefix else np.zeros(0, np.int64)
        placed = (bounds[1:] if self.suffix else bounds[:-1])[filled]
        origin = ends[filled] if self.suffix else offsets[filled]
        if self.remove and not self.suffix:
            origin = source[placed]
        out = np.insert(out, placed, 32)
        source = np.insert(source, placed, origin)
        counts = np.insert(counts, placed, len(space))
        blank = np.insert(blank, placed, True)
        extra = np.zeros(len(bounds), np.int64)
        extra[filled + 1] = 1
        bounds = np.concatenate(([0], np.cumsum(counts)))[bounds + np.cumsum(extra)]
        wide = np.repeat(np.where(blank, space[0], out), counts).astype(np.uint8)
        if self.escape:
            starts = (np.cumsum(counts) - counts)[blank]
            wide[starts + 1], wide[starts + 2] = space[1], space[2]
        return wide, np.repeat(source, counts), bounds, ends

    def _trim(self, out, source, bounds, ends) -> tuple:
        """Without spaces (or marks, where spaces become marks) at the ends of texts."""
        held = out.tobytes()
        keep = np.ones(len(out), bool)
        for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            stop = b
            while stop > a:
                if held[stop - 1] == 32:
                    stop -= 1
                elif self.escape and held.endswith(SPACE, a, stop):
                    stop -= 3
                else:
                    break
            if stop < b:
                keep[stop:b] = False
                ends[row] = source[stop]
        kept = np.concatenate(([0], np.cumsum(keep)))
        return out[keep], source[keep], kept[bounds], ends

    # --- merging -------------------------------------------------------------------------------

    def chunks(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where cut pieces of normalised texts start: at texts, and at marks behind other bytes."""
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        if self.cut_at_marks and len(data) > 2:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
            again = np.zeros(len(data), bool)
            again[3:] = mark[:-3]
            cut[:-1] |= mark & ~again
        return np.flatnonzero(cut[:-1])

    def merge_many(self, found: list[bytes]) -> list[bytes]:
        """Ids of many short cut pieces. In a round each one merges its best, leftmost pair."""
        texts = [piece.decode("utf-8") for piece in found]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols, rows = self.symbol_of[points], np.repeat(np.arange(len(found)), sizes)
        ranks, made = self.look(symbols, rows, np.arange(len(symbols)))
        done_rows, done = [], []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            widths = np.diff(np.append(heads, len(rows)))
            best = np.minimum.reduceat(ranks, heads)
            live = best != NEVER
            if not live.all():
                stay = np.repeat(live, widths)
                done_rows.append(rows[~stay])
                done.append(symbols[~stay])
                symbols, rows, ranks, made = (x[stay] for x in (symbols, rows, ranks, made))
                best, widths = best[live], widths[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, widths))
            at = hit[np.concatenate(([True], rows[hit[1:]] != rows[hit[:-1]]))]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rows, ranks, made = (x[keep] for x in (symbols, rows, ranks, made))
            at = at - np.arange(len(at))
            touched = np.concatenate((at, at[at > 0] - 1))
            ranks[touched], made[touched] = self.look(symbols, rows, touched)
        if not done:
            return [b""] * len(found)
        order = np.argsort(np.concatenate(done_rows), kind="stable")
        owners = np.concatenate(done_rows)[order]
        ids, ends = self.ids_of(np.concatenate(done)[order])
        bounds = np.concatenate(([0], ends))[np.searchsorted(owners, np.arange(len(found) + 1))]
        flat, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def look(self, symbols, rows, at) -> tuple[np.ndarray, np.ndarray]:
        following = np.minimum(at + 1, len(symbols) - 1)
        found = self.table.find(symbols[at] << 32 | symbols[following])
        found = np.where((following == at) | (rows[following] != rows[at]), -1, found)
        return self.made_rank[found], self.made[found]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long cut piece, cut again between characters that no piece holds together."""
        points = np.frombuffer(piece.decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        dead = self.inner.find(points[:-1] << 32 | points[1:]) < 0
        parts = np.split(self.symbol_of[points], np.flatnonzero(dead) + 1)
        return self.ids_of(np.concatenate([self.merge_heap(part.tolist()) for part in parts]))[0].tobytes()

    def merge_heap(self, symbols: list[int]) -> np.ndarray:
        size, pair = len(symbols), self.pair
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []

        def offer(at: int) -> None:
            other = after[at]
            if other < size:
                found = pair.get(symbols[at] << 32 | symbols[other])
                if found:
                    heap.append((found[0], at, symbols[at], symbols[other], found[1]))

        for at in range(size):
            offer(at)
        heapq.heapify(heap)
        while heap:
            _, at, left, right, made = heapq.heappop(heap)
            other = after[at] if symbols[at] == left else size
            if other >= size or symbols[other] != right:
                continue
            symbols[at], symbols[other] = made, -1
            after[at] = after[other]
            if after[at] < size:
                before[after[at]] = at
            for place in (before[at], at):
                if place >= 0:
                    count = len(heap)
                    offer(place)
                    if len(heap) > count:
                        heapq.heappush(heap, heap.pop())
        return np.array([x for x in symbols if x >= 0], np.int64)

    def ids_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and where each symbol's ids end.

        Characters that are no piece become the ids of their bytes, or the unknown id.
        """
        strange = symbols >= self.count
        sizes = np.ones(len(symbols), np.int64)
        points = symbols[strange] - self.count
        if self.fallback:
            sizes[strange] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(sizes)
        out = np.full(ends[-1] if len(ends) else 0, self.unknown, "<u4")
        out[(ends - sizes)[~strange]] = symbols[~strange]
        if self.fallback and len(points):
            data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
            out[ranges((ends - sizes)[strange], sizes[strange])] = self.byte_ids[np.frombuffer(data, np.uint8)]
        return out, ends

    def encode_chunks(self, found: list[bytes]) -> list[bytes]:
        known = self.known
        held = list(map(known.get, found))
        if None in held:
            fresh = list({piece for piece, ids in zip(found, held, strict=True) if ids is None})
            short = sorted((x for x in fresh if len(x) <= LONG_CHUNK), key=len)
            made = {x: self.merge_long(x) for x in fresh if len(x) > LONG_CHUNK}
            for start in range(0, len(short), CHUNKS_AT_ONCE):
                part = short[start: start + CHUNKS_AT_ONCE]
                made.update(zip(part, self.merge_many(part), strict=True))
            held = [made[piece] if ids is None else ids for piece, ids in zip(found, held, strict=True)]
            if len(known) + len(made) > KEPT_CHUNKS:
                known.clear()
            known.update((piece, ids) for piece, ids in made.items() if len(piece) <= LONG_CHUNK)
        return held

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """``(ids, begins, ends)`` of each text; the latter are byte places in the text."""
        norm, source, bounds, stops = self.normalize(data, offsets)
        starts = self.chunks(norm, bounds)
        flat = norm.tobytes()
        edges = [*starts.tolist(), len(flat)]
        found = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        encoded = self.encode_chunks(found)
        places = np.searchsorted(starts, bounds).tolist()
        for row, (a, b) in enumerate(zip(places, places[1:], strict=False)):
            ids = np.frombuffer(b"".join(encoded[a:b]), "<u4").astype(np.int64)
            yield self.spans(ids, norm, np.append(source[bounds[row]: bounds[row + 1]], stops[row])
                             - offsets[row], bounds[row])

    def spans(self, ids, norm, source, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source bytes of each id. Of a character's bytes the last one covers it, the others nothing."""
        if not self.fallback and (ids == self.unknown).any():
            return self._unknown_spans(ids, norm, source, start)
        ends = np.cumsum(self.size[ids])
        return ids, source[ends - self.size[ids]], source[ends]

    def _unknown_spans(self, ids, norm, source, start) -> tuple:
        """An unknown id stands for one character; unknown ids in a row are one."""
        out, begins, ends, at = [], [], [], 0
        for i in ids.tolist():
            size = int(self.size[i])
            if i == self.unknown:
                size = 1
                while start + at + size < len(norm) and norm[start + at + size] & 0xC0 == 0x80:
                    size += 1
            if out and i == self.unknown == out[-1]:
                ends[-1] = int(source[at + size])
            else:
                out.append(i)
                begins.append(int(source[at]))
                ends.append(int(source[at + size]))
            at += size
        return np.array(out, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)

    # --- decoding ------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of a list of ids; bytes that form no character each become a replacement mark."""
        kinds, pieces = self.kinds, self.pieces
        cut, at = 0, 0
        if self.prefix or self.remove:
            for at, i in enumerate(ids):
                if kinds[i] == NORMAL and pieces[i].startswith(SPACE):
                    cut += 1
                    if self.remove and len(pieces[i]) == len(SPACE):
                        continue
                if kinds[i] != CONTROL:
                    break
        data = b"".join(map(self.shown.__getitem__, ids))[cut:]
        try:
            data.decode("utf-8")
            return data
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: list[int]) -> bytes:
        out, run, bos = [], bytearray(), self.prefix or self.remove

        def flush() -> None:
            data = bytes(run)
            while data:
                try:
                    data.decode("utf-8")
                    out.append(data)
                    break
                except UnicodeDecodeError as error:
                    out.append(data[: error.start] + REPLACEMENT)
                    data = data[error.start + 1:]
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.shown[i]
                continue
            if run:
                flush()
                bos = False
            shown = self.shown[i]
            if bos and self.kinds[i] == NORMAL and self.pieces[i].startswith(SPACE):
                shown, bos = shown[1:], self.remove and len(shown) == 1
            elif self.kinds[i] != CONTROL:
                bos = False
            out.append(shown)
        flush()
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """A model file that every executor has at this path, as part of its Python installation."""
    with open(path, "rb") as file:
        return Model(file.read())


def encode(docs: DataFrame, name: str = MODEL_FILE) -> DataFrame:
    """``(doc_id, n_tokens, ids, begins, ends)`` of every whole text, one row per row.

    ``begins`` and ``ends`` are places in the text's UTF-8 bytes; the white-space mark that is put
    before a text covers nothing. A null or empty text has no ids. Repeated rows and a null
    ``doc_id`` pass through; other columns of ``docs`` are not read; an empty table gives none.
    Special strings are ordinary text. Map-only, in blocks of bounded size or of one text.
    """
    whole = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", whole),
                        ("begins", whole), ("ends", whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(public_tokenizers.path(name))
        for block in common.blocks(batches):
            found = list(model.encode(*common.ragged(block.column("text"))))
            yield common.record_batch(schema, [
                block.column("doc_id"), [len(x[0]) for x in found],
                *(pa.array([x[i] for x in found], whole) for i in range(3))])

    return common.documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, begins array<int>, ends array<int>")


def decode(ids: DataFrame, name: str = MODEL_FILE) -> DataFrame:
    """``(doc_id, text)`` of every row of ``(doc_id, ids)``; null or no ids give an empty text.

    A null id counts as unknown, an id outside the vocabulary is an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(public_tokenizers.path(name))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [model.decode([model.unknown if i is None else i for i in row or ()]).decode()
                         for row in part.column("ids").to_pylist()]
                yield common.record_batch(schema, [part.column("doc_id"), texts])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = MODEL_FILE) -> DataFrame:
    """Digests of the ids of every text and of the text that decoding them gives back.

    ``n_covered`` counts the source bytes that the pieces cover. Encoding and decoding happen in one
    pass, so that neither ids nor texts leave a task. Nulls and repeats as in :func:`encode`.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("n_covered", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(public_tokenizers.path(name))
        for block in common.blocks(batches):
            counts, sums, back, covered = [], [], [], []
            for ids, begins, ends in model.encode(*common.ragged(block.column("text"))):
                held = ids.tolist()
                counts.append(len(held))
                digits = b",".join(map(model.digits.__getitem__, held))
                sums.append(hashlib.sha256(digits).hexdigest())
                back.append(hashlib.sha256(model.decode(held)).hexdigest())
                covered.append(int((ends - begins).sum()))
            yield common.record_batch(schema, [block.column("doc_id"), counts, sums, back, covered])

    return common.documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
