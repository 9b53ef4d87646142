"""Token ids in training order, as shards of fixed-stride records.

Texts become sequences of a fixed number of 16-bit token ids. Sequences are numbered by the task that
made them and their place in it; a keyed Feistel network, walked until it stays below their number,
permutes these numbers into slots. Slots are cut into ranges, and each range is one record of
sequences of equal size, so that slot k lies at a known place of a known shard and a reader can go
on anywhere.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.session import fresh_dir

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Ids that the vocabulary leaves free: the end of a text, and what fills up its last sequence.
END_ID, PAD_ID = 50256, 50257
SEQUENCE_TOKENS = 256
SHARD_SEQUENCES = 2048
KEY = 0x5DEECE66D
ROUNDS = 6


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """A rank file that every executor has at this path, as part of its Python installation."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class Permutation:
    """A keyed bijection of 0 .. size - 1.

    A balanced Feistel network permutes the next power of four; values that land outside are put
    through it again until they land inside, which takes fewer than four turns on average.
    """

    def __init__(self, size: int, key: int = KEY, rounds: int = ROUNDS):
        self.size, self.key, self.rounds = size, key, rounds
        self.half = max(1, -(-(max(size, 2) - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)

    def network(self, values: np.ndarray, backwards: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = values >> half, values & self.mask
        for turn in reversed(range(self.rounds)) if backwards else range(self.rounds):
            kept = left if backwards else right
            noise = common.mix(kept, self.key + 0x10001 * turn) & self.mask
            left, right = (right ^ noise, left) if backwards else (right, left ^ noise)
        return (left << half) | right

    def walk(self, values: np.ndarray, backwards: bool = False) -> np.ndarray:
        out = self.network(np.asarray(values).astype(np.uint64), backwards)
        outside = np.flatnonzero(out >= self.size)
        while len(outside):
            out[outside] = self.network(out[outside], backwards)
            outside = outside[out[outside] >= self.size]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self.walk(numbers)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self.walk(slots, backwards=True)


def sequences(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, name: str = RANK_FILE) -> DataFrame:
    """``(part, place, doc_id, chunk, ids binary)``: whole texts cut into runs of token ids.

    Every text ends with ``END_ID``; a null or empty one is that alone. The last run of a text is
    shorter. ``part`` and ``place`` number the runs within the task that makes them, so the frame
    has to be written before it is used twice.
    """
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
                        ("chunk", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = encoding(public_tokenizers.path(name))
        part, place = TaskContext.get().partitionId(), 0
        for block in common.blocks(batches):
            doc, chunk, ids = [], [], []
            for doc_id, text in zip(block.column("doc_id").to_pylist(),
                                    block.column("text").to_pylist(), strict=True):
                found = rule.encode_to_numpy(text or "", disallowed_special=()).astype("<u2")
                held = np.append(found, np.uint16(END_ID)).astype("<u2").tobytes()
                runs = [held[i: i + 2 * tokens] for i in range(0, len(held), 2 * tokens)]
                doc += [doc_id] * len(runs)
                chunk += range(len(runs))
                ids += runs
            yield common.record_batch(schema, [
                np.full(len(ids), part, np.int32), np.arange(place, place + len(ids)), doc, chunk, ids])
            place += len(ids)

    return common.documents(docs).mapInArrow(
        run, "part int, place long, doc_id long, chunk int, ids binary")


def ordered(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, per_shard: int = SHARD_SEQUENCES,
            key: int = KEY, name: str = RANK_FILE) -> DataFrame:
    """All sequences of all texts, shuffled by the key: one row for each shard of slots.

    ``(shard, first_slot, n_sequences, stride, doc_ids array, chunks array, payload binary)``:
    ``payload`` holds the sequences of slots ``first_slot`` onward in order, each of ``stride``
    bytes of little-endian 16-bit ids, filled up with ``PAD_ID``. Every sequence has one slot and
    every slot from 0 one sequence; all shards but the last hold ``per_shard``. The same rows dealt
    over the same input splits and the same key give the same order. Null and empty texts are
    one sequence with the end id; repeated rows are sequences of their own; a null ``doc_id`` stays
    null; other columns are not read. An empty table gives no shard.
    """
    spark = docs.sparkSession
    staged = f"{fresh_dir(spark, 'sequences')}"
    sequences(docs, tokens, name).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    # One row for each task of the writing job.
    sizes = sorted(map(tuple, rows.groupBy("part").agg(F.count("*")).collect()))
    parts = np.array([part for part, _ in sizes], np.int64)
    counts = np.array([count for _, count in sizes], np.int64)
    starts = spark.sparkContext.broadcast((parts, np.cumsum(counts) - counts))
    total = int(counts.sum())
    slotted = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64()),
                         ("chunk", pa.int32()), ("ids", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(total, key)
        known, first = starts.value
        for batch in batches:
            number = first[np.searchsorted(known, batch.column("part").to_numpy())]
            slot = order.slots(number + batch.column("place").to_numpy())
            yield common.record_batch(slotted, [slot // per_shard, slot, batch.column("doc_id"),
                                                batch.column("chunk"), batch.column("ids")])

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        data, offsets = common.ragged(group.column("ids"))
        ids = np.full((group.num_rows, tokens), PAD_ID, "<u2")
        sizes = np.diff(offsets) // 2
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[row, within] = np.frombuffer(data.tobytes(), "<u2")
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "first_slot": pa.array([key[0].as_py() * per_shard], pa.int64()),
            "n_sequences": pa.array([group.num_rows], pa.int64()),
            "stride": pa.array([2 * tokens], pa.int64()),
            "doc_ids": pa.array([group.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "chunks": pa.array([group.column("chunk").to_pylist()], pa.list_(pa.int32())),
            "payload": pa.array([ids.tobytes()], pa.binary()),
        })

    return (
        rows.mapInArrow(place, "shard long, slot long, doc_id long, chunk int, ids binary")
        .repartitionByRange("shard").groupBy("shard").applyInArrow(
            fill, "shard long, first_slot long, n_sequences long, stride long, "
                  "doc_ids array<long>, chunks array<int>, payload binary")
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards of ``ordered`` in slot order; a lost executor's ranges are written again."""
    ordered(docs, **options).write.parquet(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """``(slot, doc_id, chunk, ids binary)`` of ``count`` slots from ``first`` on, to resume there.

    Only shards that hold such slots are read, and records are cut by their fixed stride.
    """
    shards = spark.read.parquet(path).filter(
        (F.col("first_slot") < first + count) & (F.col("first_slot") + F.col("n_sequences") > first))
    place = F.col("slot") - F.col("first_slot")
    return (
        shards.withColumn("slot", F.explode(F.sequence(
            F.greatest("first_slot", F.lit(first)),
            F.least(F.col("first_slot") + F.col("n_sequences"), F.lit(first + count)) - 1)))
        .select("slot", F.get("doc_ids", place.cast("int")).alias("doc_id"),
                F.get("chunks", place.cast("int")).alias("chunk"),
                F.substring("payload", (place * F.col("stride") + 1).cast("int"),
                            F.col("stride").cast("int")).alias("ids"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(common.table(spark, sf_dir, "documents"))
