"""Arrow batches as numpy, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read; what else a table holds cannot clash with theirs."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has."""
    taken = {x.lower() for x in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def ragged(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[array.offset: array.offset + len(array) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0]: bounds[-1]], bounds - bounds[0]


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = ragged(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        column if isinstance(column, pa.Array) else pa.array(column, field.type)
        for column, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers: xor-shift and odd multipliers."""
    values = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Lookup:
    """A map from non-negative 64-bit integers to 64-bit integers, for whole arrays at a time.

    Open addressing in numpy arrays, at most half full.
    """

    def __init__(self, keys=(), values=(), missing: int = -1):
        self.missing, self.size = missing, 0
        self.clear()
        if len(keys):
            self.insert(np.asarray(keys, np.int64), np.asarray(values, np.int64))

    def clear(self, bits: int = 10) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.missing, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            full = self.keys >= 0
            keys = np.concatenate((self.keys[full], keys))
            values = np.concatenate((self.values[full], values))
            self.clear(int(4 * len(keys)).bit_length())
        self.size += len(keys)
        slots, ring = self.slots(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            self.values[slots[free]] = values[free]
            rest = self.keys[slots] != keys
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ring

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots, ring = self.slots(keys), len(self.keys) - 1
        held = self.keys[slots]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ring
            held = self.keys[slots[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return self.values[slots]
