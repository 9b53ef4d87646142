"""Lines that several documents share, kept in one of them only.

All distinct line hashes are dealt into shards. Each shard gets a minimal perfect hash: levels of bit
arrays in which a key owns a bit that no other key of its level hits, and whose rank is the key's
slot in three plain arrays: a fingerprint, the number of documents and the smallest of them. The
arrays are rows of a written table. Documents send 16-byte hashes of their lines to the shards and
probe the arrays; lines themselves are never moved or joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.session import fresh_dir

#: Fixed values of the contract: what is stripped from a line's ends, and the shortest key.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
#: Distinct hashes in a shard, and probes that one copy of a shard answers.
SHARD_KEYS = 4096
COPY_PROBES = 8192
#: Bits of a level for each key left.
LOAD = 2
NO_ID = (1 << 63) - 1
KEYS = ("doc_key", "text_key")


def key_of(line: str) -> bytes | None:
    """A line's key as UTF-8, or None if it is too short to be compared."""
    key = line.strip(BLANKS)
    if len(key) < LEAST_CHARS:
        return None
    return key.encode().lower()  # bytes: only A to Z change


def digest(line: str) -> bytes | None:
    key = key_of(line)
    return None if key is None else xxhash.xxh3_128_digest(key)


class Shard:
    """Minimal perfect hash of a shard and the arrays that it indexes."""

    @staticmethod
    def place(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
        spread = common.mix(low ^ common.mix(high, level), level)
        return (spread % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, high, low, count, first) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """Sizes and bits of the levels, then fingerprints, counts and first documents by slot."""
        left, sizes, levels, slots = np.arange(len(high)), [], [], np.zeros(len(high), np.int64)
        used = 0
        while len(left):
            bits = max(64, LOAD * len(left))
            at = cls.place(high[left], low[left], len(sizes), bits)
            hits = np.bincount(at, minlength=bits)
            alone = hits[at] == 1
            taken = np.zeros(bits, bool)
            taken[at[alone]] = True
            slots[left[alone]] = used + (np.cumsum(taken) - 1)[at[alone]]
            used += int(taken.sum())
            sizes.append(bits)
            levels.append(taken)
            left = left[~alone]
        order = np.argsort(slots)
        return (np.array(sizes, "<i8").tobytes(),
                np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)).tobytes(),
                high[order].astype("<u4").tobytes(),
                np.minimum(count[order], 2**32 - 1).astype("<u4").tobytes(),
                first[order].astype("<i8").tobytes())

    def __init__(self, sizes: bytes, bits: bytes, marks: bytes, count: bytes, first: bytes):
        self.sizes = np.frombuffer(sizes, "<i8")
        total = int(self.sizes.sum())
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.marks = np.frombuffer(marks, "<u4")
        self.count = np.frombuffer(count, "<u4")
        self.first = np.frombuffer(first, "<i8")

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents and the first of them for each hash; 0 for a hash not in the shard."""
        slots = np.full(len(high), -1, np.int64)
        left, start = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + self.place(high[left], low[left], level, size)
            owned = self.bits[at]
            slots[left[owned]] = self.ranks[at[owned]]
            left, start = left[~owned], start + size
        found = slots >= 0
        found[found] = self.marks[slots[found]] == (high[found] & np.uint64(0xFFFFFFFF))
        return np.where(found, self.count[slots], 0), np.where(found, self.first[slots], -1)


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(high, low, doc_key, text_key)``, once for each distinct comparable line of a row of ``docs``.

    ``doc_key`` is the id; rows without one count as one document after all others. ``text_key`` tells
    rows of one document apart. Rows that repeat both in a task have the same lines and give them once.
    """
    schema = pa.schema([(name, pa.int64()) for name in ("high", "low", "doc_key", "text_key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for block in common.blocks(batches):
            digests, sizes = [], []
            keys = [block.column(name).to_numpy() for name in KEYS]
            for text, *row in zip(block.column("text").to_pylist(), *keys, strict=True):
                own = {}
                if text and (row := tuple(row)) not in seen:
                    seen.add(row)
                    own = dict.fromkeys(map(digest, text.split("\n")))
                    own.pop(None, None)
                digests += own
                sizes.append(len(own))
            high, low = halves(digests)
            yield common.record_batch(schema, [high.view(np.int64), low.view(np.int64),
                                               *(np.repeat(key, sizes) for key in keys)])

    keyed = common.documents(docs).select("text", *row_keys())
    return keyed.mapInArrow(run, "high long, low long, doc_key long, text_key long")


def row_keys() -> list[Column]:
    """``doc_key`` and ``text_key`` of rows with ``doc_id`` and ``text``.

    Only lines of one's own text are ever dropped, so rows that share both keys may share losses.
    """
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_key"),
            F.xxhash64(F.col("text").cast("string")).alias("text_key")]


def shard_of(shards: int):
    return F.pmod(F.col("low"), F.lit(shards))


def build_index(hashes: DataFrame, path: str) -> int:
    """Write one row of arrays for each shard of all distinct hashes; the number of shards.

    Counting combines in the map tasks first, so a line that a third of all documents share is one
    row of each task.
    """
    spark = hashes.sparkSession
    counted = f"{path}/counted"
    (hashes.groupBy("high", "low")
     .agg(F.count("*").alias("n"), F.min("doc_key").alias("first"), F.max("doc_key").alias("last"))
     .select("high", "low", "first", F.when(F.col("first") == F.col("last"), 1)
             .otherwise(F.greatest("n", F.lit(2))).cast("long").alias("n"))
     .write.parquet(counted))
    keys = spark.read.parquet(counted)
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).to_numpy()
        count = column("n")
        arrays = Shard.build(column("high").view(np.uint64), column("low").view(np.uint64), count,
                             column("first"))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "probes": pa.array([int(count.sum())], pa.int64()),
            **{name: pa.array([held], pa.binary()) for name, held in zip(ARRAYS, arrays, strict=True)},
        })

    schema = "shard long, probes long, " + ", ".join(f"{name} binary" for name in ARRAYS)
    (keys.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build, schema)
     .write.parquet(f"{path}/shards"))
    return shards


ARRAYS = ("sizes", "bits", "marks", "counts", "firsts")


def probe(hashes: DataFrame, path: str, shards: int) -> DataFrame:
    """``(doc_key, text_key, hash binary)`` of the lines that a row loses.

    A shard with many probes is copied, and each copy answers some of the lines and rows; a task
    reads the arrays first and then the probes as they stream by.
    """
    index = hashes.sparkSession.read.parquet(f"{path}/shards")
    copies = F.ceil(F.col("probes") / COPY_PROBES).cast("int")
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("copy"),
        F.lit(0).alias("kind"), *ARRAYS, *(F.lit(None).cast("long").alias(x)
                                           for x in ("high", "low", *KEYS)),
    )
    busy = index.filter(copies > 1).select("shard", copies.alias("copies"))
    probes = (
        hashes.withColumn("shard", shard_of(shards)).join(busy, "shard", "left")
        .select("shard",
                F.pmod(F.xxhash64("low", *KEYS), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"),
                F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(x) for x in ARRAYS),
                "high", "low", *KEYS)
    )
    schema = pa.schema([*((name, pa.int64()) for name in KEYS), ("hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            shard, copy = (batch.column(x).to_numpy() for x in ("shard", "copy"))
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0)
                                    | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *change], [*change, len(kind)], strict=True):
                if start == stop:
                    continue
                here = (int(shard[start]), int(copy[start]))
                if kind[start] == 0:
                    held = Shard(*(batch.column(x)[int(start)].as_py() for x in ARRAYS))
                    name = here
                    continue
                if name != here:
                    raise RuntimeError(f"no arrays for shard {here}")
                part = batch.slice(int(start), int(stop - start))
                high, low, doc, row = (part.column(x).to_numpy() for x in ("high", "low", *KEYS))
                count, first = held.probe(high.view(np.uint64), low.view(np.uint64))
                lost = np.flatnonzero((count > 1) & (first != doc))
                if len(lost):
                    pair = np.stack((high[lost], low[lost]), 1).tobytes()
                    yield common.record_batch(schema, [
                        doc[lost], row[lost], [pair[i: i + 16] for i in range(0, len(pair), 16)]])

    return (arrays.unionByName(probes).repartition("shard", "copy")
            .sortWithinPartitions("shard", "copy", "kind")
            .mapInArrow(run, "doc_key long, text_key long, hash binary"))


def kept_text(text: str, lost: set[bytes]) -> tuple[int, int, str]:
    lines = text.split("\n")
    kept = [line for line in lines if digest(line) not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def losses(docs: DataFrame) -> DataFrame:
    """``(doc_key, text_key, lost array<binary>)``: distinct hashes of the lines that a row loses."""
    path = fresh_dir(docs.sparkSession, "lines")
    hashes = line_hashes(docs)
    shards = build_index(hashes, path)
    return probe(hashes, path, shards).groupBy(*KEYS).agg(F.collect_set("hash").alias("lost"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its remaining lines.

    ``(doc_id, kept_text, n_lines, n_dropped)``: a line is dropped if its key has at least ten code
    points, stands in at least two documents, and this is not the one of smallest id. Null and empty
    texts are one empty line, which stays. Rows that repeat a ``doc_id`` are one document, and rows
    without one are one document after all others. Lines of a whole text are compared, however
    long it is. Other columns are not read.
    """
    rows = common.documents(docs).select("doc_id", "text", *row_keys())
    schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()),
                        ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            out = cleaned(block.column("text"), block.column("lost"))
            yield common.record_batch(schema, [block.column("doc_id"), *map(list, zip(*out, strict=True))])

    return (rows.join(losses(docs), list(KEYS), "left").select("doc_id", "text", "lost")
            .mapInArrow(run, "doc_id long, kept_text string, n_lines long, n_dropped long"))


def cleaned(texts: pa.Array, lost: pa.Array) -> list[tuple[str, int, int]]:
    """Kept text, lines and dropped lines of each text."""
    out = []
    for text, hashes in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
        lines = (text or "").split("\n")
        kept = lines
        if hashes:
            dropped = set(hashes)
            kept = [line for line in lines if digest(line) not in dropped]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def without_shared_lines(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with its columns, ``text`` and ``n_chars`` being what ``drop_lines`` leaves.

    A null text stays null; a text that loses all its lines is empty. ``n_chars`` is optional. Without
    ``keep_emptied``, rows that lose lines and have only white space left are left out. Repeated rows
    are changed alike, and rows without an id, which count as one document, are judged by their texts.
    """
    *keys, lost = common.free_names(docs, *KEYS, "lost")
    found = losses(docs).withColumnsRenamed({**dict(zip(KEYS, keys, strict=True)), "lost": lost})
    schema = docs.schema
    keyed = docs.withColumns(dict(zip(keys, row_keys(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            texts = block.column("text")
            kept = [x[0] for x in cleaned(texts, block.column(lost))]
            kept = [None if null else x for x, null in
                    zip(kept, texts.is_null().to_pylist(), strict=True)]
            arrays = {name: block.column(name) for name in schema.names}
            arrays["text"] = pa.array(kept, texts.type)
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([None if x is None else len(x) for x in kept],
                                             arrays["n_chars"].type)
            out = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
            if not keep_emptied:
                before = [x or "" for x in texts.to_pylist()]
                out = out.filter(pa.array([bool(x and not x.isspace()) or (x or "") == old
                                           for x, old in zip(kept, before, strict=True)], pa.bool_()))
            yield out

    return keyed.join(found, keys, "left").drop(*keys).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH line AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS body
  FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS t(i)
), keyed AS (
  SELECT *, translate(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> first AS dropped
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
