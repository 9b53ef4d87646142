"""Sliding-window admission: per key, at most ``limit`` accepted events in any trailing window.

Only accepted events count, so each decision depends on earlier ones and a range count over all
events would be wrong. The work is split wherever the past cannot matter: a gap longer than the
window starts afresh, and a stretch with no more than ``limit`` events is accepted as a whole in
the JVM. What remains is walked in time order, batch by batch, holding ``limit`` times per stretch.

A long stretch of one busy key is cut into chunks of time that are walked on many tasks at once, each
from a guess of the times accepted before it. The guess is what the chunk before it gave in the
round before; chunks whose guess has changed are walked again, until none changes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from postwatch.session import fresh_dir

MICROS = 1_000_000
#: Events of a stretch beyond which it is cut, and the size of its chunks, about.
CHUNK_EVENTS = 200_000
#: Chunk limits lie between these parts of a window.
TICKS = 64
#: Rounds after which stretches that still change are walked in one piece each.
MOST_ROUNDS = 6


def with_stretches(events: DataFrame, key: str, at: str, window_micros: int) -> DataFrame:
    """Add ``_stretch`` and ``_events``: runs of events without a gap longer than the window.

    Gaps are found on one row per key and window-long cell, so the ordered pass over a busy key
    sees cells, not events.
    """
    cells = events.withColumn("_cell", F.floor(F.col(at) / window_micros))
    summary = cells.groupBy(key, "_cell").agg(
        F.min(at).alias("_from"), F.max(at).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    in_order = Window.partitionBy(key).orderBy("_cell")
    starts = F.coalesce(
        F.col("_from") - F.lag("_to").over(in_order) > window_micros, F.lit(True)
    )
    marked = summary.withColumn("_start", F.when(starts, F.col("_cell")))
    numbered = marked.withColumn("_stretch", F.last("_start", ignorenulls=True).over(in_order))
    sized = numbered.withColumn(
        "_events", F.sum("_n").over(Window.partitionBy(key, "_stretch"))
    )
    return cells.join(sized.select(key, "_cell", "_stretch", "_events"), [key, "_cell"])


class Ring:
    """The times of the last ``limit`` admitted events of a key, which is all a decision needs.

    An event passes unless the ring is full and its oldest time lies within the window. A time just
    one window old is within it.
    """

    def __init__(self, limit: int, window_micros: int, times: Iterable[int] = ()) -> None:
        self.window, self.times = window_micros, deque(times, maxlen=limit)

    def admits(self, now: int) -> bool:
        full = len(self.times) == self.times.maxlen
        if full and (not self.times or now - self.times[0] <= self.window):
            return False
        self.times.append(now)  # a full ring loses its oldest time
        return True

    def verdicts(self, times: np.ndarray) -> np.ndarray:
        """Which of some times in ascending order are admitted.

        From a full ring the next event to pass is found by binary search, so that refused events,
        of which a crowded key has most, cost nothing.
        """
        out = np.zeros(len(times), bool)
        if not self.times.maxlen:
            return out
        held, at, count = times.tolist(), 0, len(times)
        while at < count:
            if len(self.times) == self.times.maxlen and held[at] - self.times[0] <= self.window:
                at = int(np.searchsorted(times, self.times[0] + self.window, "right"))
                if at >= count:
                    break
            out[at] = True
            self.times.append(held[at])
            at += 1
        return out


def admit(
    events: DataFrame, key: str, ts: str, row_id: str, limit: int, window_seconds: int = 60,
    chunk_events: int = CHUNK_EVENTS,
) -> DataFrame:
    """Key, row id and whether the event is admitted, in (time, id) order per key. Runs jobs."""
    spark = events.sparkSession
    window = window_seconds * MICROS
    # The epoch distance of a wall clock in UTC, independent of the session time zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = events.select(key, row_id, F.timestamp_diff("MICROSECOND", epoch, ts).alias("_at"))
    split = with_stretches(timed, key, "_at", window)
    free = split.filter(F.col("_events") <= limit).select(
        key, row_id, F.lit(True).alias("admitted")
    )
    crowded = split.filter((F.col("_events") > limit) & (F.col("_events") <= chunk_events))
    schema = T.StructType(
        [events.schema[key], events.schema[row_id], T.StructField("admitted", T.BooleanType())]
    )
    found = free.unionByName(_in_order(crowded, key, row_id, limit, window, schema))
    busy = split.filter(F.col("_events") > max(limit, chunk_events)).select(
        key, "_stretch", "_cell", "_at", row_id)
    path = fresh_dir(spark, "admission")
    busy.write.parquet(f"{path}/busy")
    busy = spark.read.parquet(f"{path}/busy")
    if busy.isEmpty():
        return found
    return found.unionByName(_in_chunks(busy, key, row_id, limit, window, chunk_events, schema, path))


def _in_order(rows: DataFrame, key: str, row_id: str, limit: int, window: int,
              schema: T.StructType) -> DataFrame:
    """Each stretch walked in one task, in Arrow batches."""
    dealt = rows.select(key, "_stretch", "_at", row_id).repartition(key, "_stretch")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ring = None, Ring(limit, window)
        for batch in batches:
            at, owner, stretch = (batch[x].to_numpy() for x in ("_at", key, "_stretch"))
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])))
            heads = np.append(np.flatnonzero(new), len(batch)) if len(batch) else np.zeros(1, int)
            verdicts = []
            for start, stop in zip(heads, heads[1:], strict=False):
                if (owner[start], stretch[start]) != current:
                    current, ring = (owner[start], stretch[start]), Ring(limit, window)
                verdicts.append(ring.verdicts(at[start:stop]))
            yield pd.DataFrame({key: batch[key], row_id: batch[row_id],
                                "admitted": np.concatenate([np.zeros(0, bool), *verdicts])})

    return dealt.sortWithinPartitions(key, "_stretch", "_at", row_id).mapInPandas(walk, schema)


def _chunked(busy: DataFrame, key: str, row_id: str, limit: int, window: int,
             chunk_events: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may pass with their ``_chunk``, and the rest.

    Of the events of one moment only the first ``limit`` by id can pass, so the others are set aside
    however many there are. Chunks end between ticks; their sizes come from counts per tick, summed
    within cells and over cells.
    """
    moment = Window.partitionBy(key, "_at").orderBy(row_id)
    last = (busy.select(key, "_at", row_id).withColumn("_rank", F.row_number().over(moment))
            .filter(F.col("_rank") <= limit).groupBy(key, "_at").agg(F.max(row_id).alias("_last")))
    judged = busy.join(last, [key, "_at"])
    tick = F.floor(F.col("_at") / max(window // TICKS, 1))
    rows = judged.filter(F.col(row_id) <= F.col("_last")).drop("_last").withColumn("_tick", tick)
    counts = rows.groupBy(key, "_stretch", "_cell", "_tick").agg(F.count(F.lit(1)).alias("_n"))
    in_cell = Window.partitionBy(key, "_cell").orderBy("_tick")
    ticks = counts.withColumn("_within", F.sum("_n").over(in_cell) - F.col("_n"))
    cells = counts.groupBy(key, "_stretch", "_cell").agg(F.sum("_n").alias("_n"))
    in_stretch = Window.partitionBy(key, "_stretch").orderBy("_cell")
    before = cells.withColumn("_before", F.sum("_n").over(in_stretch) - F.col("_n"))
    numbered = ticks.join(before.select(key, "_cell", "_before"), [key, "_cell"]).select(
        key, "_cell", "_tick",
        F.floor((F.col("_before") + F.col("_within")) / chunk_events).cast("int").alias("_chunk"))
    chunked = rows.join(numbered, [key, "_cell", "_tick"]).select(key, "_stretch", "_chunk", "_at", row_id)
    return chunked, judged.filter(F.col(row_id) > F.col("_last")).select(
        key, row_id, F.lit(False).alias("admitted"))


def _in_chunks(busy, key: str, row_id: str, limit: int, window: int, chunk_events: int,
               schema: T.StructType, path: str) -> DataFrame:
    """Stretches of many events, walked by chunks that guess what came before them."""
    spark = busy.sparkSession
    chunked, refused = _chunked(busy, key, row_id, limit, window, chunk_events)
    chunked.write.parquet(f"{path}/chunked")
    rows = spark.read.parquet(f"{path}/chunked")
    place = [key, "_stretch", "_chunk"]
    none = F.array().cast("array<long>")
    rings = rows.select(*place).distinct().withColumns(
        {"_old": none, "_new": none, "_out": none, "_changed": F.lit(True)})
    following = Window.partitionBy(key, "_stretch").orderBy("_chunk")
    for turn in range(MOST_ROUNDS):
        rings.write.parquet(f"{path}/guess-{turn}")
        rings = spark.read.parquet(f"{path}/guess-{turn}")
        again = rings.filter("_changed")
        if again.isEmpty():
            break
        walked = _walked(rows, again, key, row_id, limit, window).withColumnRenamed("_ring", "_walked")
        out = F.coalesce("_walked", "_out")
        before = F.coalesce(F.lag("_out").over(following), none)
        rings = (rings.join(walked, place, "left").withColumn("_out", out).drop("_walked")
                 .withColumns({"_old": F.col("_new"), "_new": before})
                 .withColumn("_changed", F.col("_new") != F.col("_old")))
    else:
        rings.write.parquet(f"{path}/guess")
        rings = spark.read.parquet(f"{path}/guess")
    unsettled = rings.filter("_changed").select(key, "_stretch").distinct()
    settled = rings.join(unsettled, [key, "_stretch"], "left_anti")
    kept = _judged(rows.join(unsettled, [key, "_stretch"], "left_anti"), settled, key, row_id, limit,
                   window, schema)
    rest = _in_order(rows.join(unsettled, [key, "_stretch"], "left_semi"), key, row_id, limit, window, schema)
    return refused.unionByName(kept).unionByName(rest)


def _with_heads(rows: DataFrame, rings: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows of the chunks of ``rings`` in order, behind one row each that holds the rings."""
    place = [key, "_stretch", "_chunk"]
    heads = rings.select(*place, F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_at"),
                         F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), "_old", "_new")
    wanted = rows.join(rings.select(*place), place, "left_semi").withColumn("_kind", F.lit(1))
    both = heads.unionByName(wanted, allowMissingColumns=True)
    return both.repartition(*place).sortWithinPartitions(*place, "_kind", "_at", row_id)


def _pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices that begin with a head or continue the chunk before them."""
    for batch in batches:
        heads = np.flatnonzero(np.asarray(batch.column("_kind")) == 0).tolist()
        bounds = sorted({0, *heads, batch.num_rows})
        for start, stop in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(start, stop - start), start in heads


def _walked(rows: DataFrame, rings: DataFrame, key: str, row_id: str, limit: int, window: int) -> DataFrame:
    """``_ring`` that each chunk ends with, started from ``_new``; nothing for chunks whose walks from
    ``_old`` and ``_new`` meet, which end as before. Rows behind that place are passed over."""
    schema = T.StructType([*(rings.schema[x] for x in (key, "_stretch", "_chunk")),
                           T.StructField("_ring", T.ArrayType(T.LongType()))])
    first = F.col("_old") == F.col("_new")  # in the first round, when nothing has been walked
    dealt = _with_heads(rows, rings.withColumn("_old", F.when(~first, F.col("_old"))), key, row_id)

    names = [*(x.name for x in schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)

        def result() -> pa.RecordBatch:
            row = dict(zip(names, (*owner, list(new.times)), strict=True))
            return pa.RecordBatch.from_pylist([row], kinds)

        owner, old, new, met = None, None, None, True
        for part, head in _pieces(batches, key):
            if head:
                if not met:
                    yield result()
                top = part.slice(0, 1).to_pylist()[0]
                owner = (top[key], top["_stretch"], top["_chunk"])
                new, met = Ring(limit, window, top["_new"]), False
                old = None if top["_old"] is None else Ring(limit, window, top["_old"])
                part = part.slice(1)
            if met or not part.num_rows:
                continue
            times = np.asarray(part.column("_at"), np.int64)
            new.verdicts(times)
            if old is not None:
                old.verdicts(times)
                met = old.times == new.times
        if not met:
            yield result()

    return dealt.mapInArrow(run, schema)


def _judged(rows: DataFrame, rings: DataFrame, key: str, row_id: str, limit: int, window: int,
            schema: T.StructType) -> DataFrame:
    """Verdicts of all rows, each chunk started from its settled ring ``_new``."""
    dealt = _with_heads(rows, rings, key, row_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(limit, window)
        for part, head in _pieces(batches, key):
            if head:
                ring = Ring(limit, window, part.column("_new")[0].as_py())
                part = part.slice(1)
            times = np.asarray(part.column("_at"), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(key), part.column(row_id), pa.array(ring.verdicts(times))],
                [key, row_id, "admitted"])

    return dealt.mapInArrow(run, schema)
