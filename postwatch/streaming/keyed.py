"""Streams with keyed state: seen ids, admission, queue, authors, current posts as signed counts.

State is in the RocksDB store. Authors and admission keep one small row per key. Seen ids, queue and
current posts have about as many keys as rows, and calls per key would cost far more than the rows:
their keys are dealt over buckets, each of which keeps its rows as columns in one value that is read
and written once a batch. So a batch reads the buckets of the keys that it has, not what earlier
batches wrote. Forgetting is done by event-time timers: the clock is the newest time that earlier
batches had. Columns that carry the watermark are replaced by plain numbers before the state operator,
because Spark leaves out rows behind the watermark there; a late row is handled like any other.
Results are appended by the file sink, which writes each batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postwatch.operators.admission import MICROS, Ring

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
DAY_MILLIS = 86_400_000


@contextmanager
def keyed_state(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """The RocksDB store, and over how many tasks keys are dealt, for streams started within.

    A stream keeps the number of tasks of its first start in its checkpoint.
    """
    before = {name: spark.conf.get(name) for name in (STORE, PARTITIONS, PROGRESS)}
    spark.conf.set(STORE, ROCKSDB)
    spark.conf.set(PROGRESS, 100_000)  # batches of a run whose metrics are kept
    if tasks:
        spark.conf.set(PARTITIONS, tasks)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def append_stream(stream: DataFrame, path: str, checkpoint: str, tasks: int | None = None) -> list[dict]:
    """Process everything that has landed and append the results as Parquet, each batch once.

    Gives the observed metrics of every batch of this run, by their names.
    """
    with keyed_state(stream.sparkSession, tasks):
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return [{name: value for row in (progress["observedMetrics"] or {}).values()
             for name, value in row.asDict().items()} for progress in query.recentProgress]


def on_clock(stream: DataFrame, at: str, delay: str = "0 seconds") -> DataFrame:
    """The stream with ``at_ms``, the time ``at`` in milliseconds, on a watermark of ``at``."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.withColumn("at_ms", F.unix_millis(at)).drop(at)


class Timed(StatefulProcessor):
    """A processor with at most one timer per key."""

    def set_timer(self, moment: int) -> None:
        for old in list(self.handle.listTimers()):
            if old != moment:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(moment)

    def drop_timers(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    def close(self) -> None:
        pass


BUCKETS = 4_096  # of a stream; a checkpoint keeps the number it was started with


def in_buckets(rows: DataFrame, key: str, buckets: int) -> GroupedData:
    """Rows grouped by bucket, with the key as text: numbers beside nulls would arrive as floats."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return dealt.withColumn(key, F.col(key).cast("string")).groupBy("bucket")


class Bucket(Timed):
    """A processor of all keys of a bucket; state is one row of ``columns`` per key, or several."""

    columns: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", ", ".join(
            f"`{name}` array<{kind}>" for name, kind in self.columns.items()))

    def load(self) -> list[tuple]:
        held = self.kept.get()
        return [] if held is None else list(zip(*held, strict=True))

    def store(self, rows: list[tuple]) -> None:
        if rows:
            self.kept.update(tuple(list(column) for column in zip(*rows, strict=True)))
        else:
            self.kept.clear()

    def wake(self, soonest: int | None, later: int = 0) -> None:
        """The one timer of the bucket, some time after the soonest moment if there is one."""
        if soonest is None:
            self.drop_timers()
        else:
            self.set_timer(soonest + later)


def _least(one: Any, other: Any, choose: Callable = min) -> Any:
    return other if one is None else one if other is None else choose(one, other)


def records(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    """Rows as tuples of Python values, with None for what is missing."""
    columns = [[None if missing else value for value, missing in zip(frame[name].tolist(), frame[name].isna())]
               for name in names]
    return zip(*columns, strict=True)


# --- seen ids --------------------------------------------------------------------------------------


class SeenIds(Bucket):
    """When ids were marked as seen; each is forgotten a retention time later."""

    columns = {"post_id": "string", "marked": "long"}

    def __init__(self, retention: int) -> None:
        self.retention = retention

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):  # noqa: N802, N803
        times: dict[Any, tuple[int | None, int | None]] = {}
        for frame in rows:
            spans = frame.groupby("post_id", dropna=False)["at_ms"].agg(["min", "max"]).reset_index()
            for post, low, high in records(spans, ["post_id", "min", "max"]):
                first, newest = times.get(post, (None, None))
                times[post] = (_least(first, low), _least(newest, high, max))
        clock = timerValues.getCurrentWatermarkInMs()
        marks, out = dict(self.load()), []
        for post, (first, newest) in times.items():
            now = max(clock, 0 if newest is None else int(newest))
            marked = marks.get(post)
            if marked is None or marked < now - self.retention:
                marks[post] = now
                out.append((post, first))
        if out:
            self.keep(marks)
            frame = pd.DataFrame(out, columns=["post_id", "seen_ms"])
            yield frame.astype({"seen_ms": "Int64"})

    def keep(self, marks: dict[Any, int]) -> None:
        self.store(list(marks.items()))
        self.wake(min(marks.values(), default=None), self.retention + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        self.keep({post: at for post, at in self.load() if at + self.retention + 1 > clock})
        yield from ()


def seen_ids(sightings: DataFrame, retention_days: int, buckets: int = BUCKETS) -> DataFrame:
    """``(post_id, seen_at)`` of sightings (post_id, seen_at) of ids that are new.

    Of the sightings of a batch the earliest counts. An id is remembered for the retention time after
    it was marked, by the newest time that the batches before and its own sightings had.
    """
    kind = sightings.schema["post_id"].dataType
    dealt = in_buckets(on_clock(sightings.select("post_id", "seen_at"), "seen_at"), "post_id", buckets)
    found = dealt.transformWithStateInPandas(
        statefulProcessor=SeenIds(retention_days * DAY_MILLIS), outputStructType="post_id string, seen_ms long",
        outputMode="Append", timeMode="EventTime")
    return found.select(F.col("post_id").cast(kind).alias("post_id"), F.timestamp_millis("seen_ms").alias("seen_at"))


# --- admission -------------------------------------------------------------------------------------


class Admission(Timed):
    """Sliding-window admission with at most ``limit`` accepted times of state per key."""

    def __init__(
        self, key: str, at: str, row_id: str, limit: int, window_seconds: int, idle_seconds: int | None
    ) -> None:
        self.key, self.at, self.row_id = key, at, row_id
        self.limit, self.window = limit, window_seconds * MICROS
        self.idle = None if idle_seconds is None else idle_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "last long, times array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):  # noqa: N802, N803
        # One key's share of one micro-batch, which the trigger limits keep small.
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        if len(batch) > 1:
            batch = batch.sort_values([self.at, self.row_id])
        last, held = self.accepted.get() or (None, ())
        ring = Ring(self.limit, self.window, held)
        times = batch[self.at].to_numpy(np.int64)
        breaks = np.zeros(0, np.int64)
        if self.idle is not None:
            before = np.concatenate(([times[0] if last is None else last], times[:-1]))
            breaks = np.flatnonzero(times - before > self.idle)
        verdicts = []
        for part, piece in enumerate(np.split(times, breaks)):
            if part:
                ring.times.clear()
            verdicts.append(ring.verdicts(piece))
        newest = int(times[-1]) if last is None else max(last, int(times[-1]))
        self.accepted.update((newest, list(ring.times)))
        if self.idle is not None and newest != last:
            if last is not None:  # its timer is known, so that none need be listed
                self.handle.deleteTimer(self.silent(last))
            self.handle.registerTimer(self.silent(newest))
        yield pd.DataFrame({self.key: batch[self.key], self.row_id: batch[self.row_id],
                            "admitted": np.concatenate(verdicts)})

    def silent(self, last: int) -> int:
        """The millisecond by which a key has been silent for too long."""
        return (last + self.idle) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):  # noqa: N802, N803
        held = self.accepted.get()
        if held and self.silent(held[0]) <= timerValues.getCurrentWatermarkInMs():
            self.accepted.clear()
        yield from ()


# --- queue -----------------------------------------------------------------------------------------

DONE, FAILED, ARRIVED = 0, 1, 2


class OpenRows(Bucket):
    """The open row of each source id: its id, attempts, when it is available, and whether it waits."""

    columns = {"source_id": "string", "id": "long", "attempts": "int", "available": "long", "waits": "boolean"}

    def __init__(self, delay: int) -> None:
        self.delay = delay

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):  # noqa: N802, N803
        held = {row[0]: row for row in self.load()}
        done, failed, first = set(), {}, {}  # by source id: its outcomes and the arrival of the least place
        for frame in rows:
            changes = records(frame, ["source_id", "id", "kind", "at_ms", "place"])
            for source, number, kind, at, place in changes:
                if kind == ARRIVED:
                    came = (place, number, at)
                    if source not in first or came < first[source]:
                        first[source] = came
                elif source in held and held[source][1] == number:
                    if kind == DONE:
                        done.add(source)
                    elif kind == FAILED:
                        failed[source] = max(at, failed.get(source, 0))
        for source in done:
            del held[source]
        for source in failed.keys() - done:
            _, number, attempts, _, _ = held[source]
            held[source] = (source, number, attempts + 1, failed[source] + self.delay, True)
        out = [(source, number, 0, at, False) for source, (_, number, at) in first.items() if source not in held]
        held.update({row[0]: row for row in out})
        if done or failed or out:
            self.keep(list(held.values()), bool(done or failed))
        yield from self.handed(out)

    def keep(self, rows: list[tuple], moved: bool) -> None:
        self.store(rows)
        if moved:
            self.wake(min((row[3] for row in rows if row[4]), default=None))

    @staticmethod
    def handed(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([row[:4] for row in rows],
                               columns=["source_id", "id", "attempts", "available_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        rows = self.load()
        due = [row[4] and row[3] <= clock for row in rows]
        rows = [(*row[:4], row[4] and not now) for row, now in zip(rows, due, strict=True)]
        self.keep(rows, True)
        yield from self.handed([row for row, now in zip(rows, due, strict=True) if now])


def work_queue(changes: DataFrame, delay_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """Rows handed out: ``(source_id, id, attempts, available_at)``.

    ``changes`` has (source_id, id, kind, at, place): arrivals, and acknowledgements and failures of
    rows handed out. A source id is queued unless it has an open row; of the arrivals of a batch the
    one of the least ``place`` counts. In a batch, outcomes come before arrivals. A failed row is
    handed out again with one more attempt once the clock has passed its failure by the delay; there
    is no cap on attempts. Outcomes of rows that are not open are ignored.
    """
    kind = changes.schema["source_id"].dataType
    timed = on_clock(changes.select("source_id", F.col("id").cast("long").alias("id"), "kind", "at",
                                    F.col("place").cast("long").alias("place")), "at")
    # A change without a time does not move the clock and is available at once.
    timed = timed.withColumn("at_ms", F.coalesce("at_ms", F.lit(0).cast("long")))
    found = in_buckets(timed, "source_id", buckets).transformWithStateInPandas(
        statefulProcessor=OpenRows(delay_seconds * 1000),
        outputStructType="source_id string, id long, attempts int, available_ms long",
        outputMode="Append", timeMode="EventTime")
    return found.select(F.col("source_id").cast(kind).alias("source_id"), "id", "attempts", F.timestamp_millis("available_ms").alias("available_at"))


# --- authors beside posts ----------------------------------------------------------------------------


class LatestAuthor(Timed):
    """The newest record of an author, and the posts that wait for it."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.author = handle.getValueState("author", "seq long, record string")
        self.posts = handle.getListState("posts", "post string, due long")

    def joined(self, key: Any, posts: list[str], record: str | None) -> Iterator[pd.DataFrame]:
        if posts:
            yield pd.DataFrame({"author_id": [key[0]] * len(posts), "post": posts,
                                "author": [record] * len(posts)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = tuple(self.author.get()) if self.author.exists() else None
        newest, ready, waiting = held, [], []
        for frame in rows:
            known = frame[frame["seq"].notna()]
            if len(known):
                last = known.loc[known["seq"].idxmax()]
                if newest is None or int(last["seq"]) >= newest[0]:
                    newest = (int(last["seq"]), last["record"])
            for post, at in frame.loc[frame["post"].notna(), ["post", "at_ms"]].itertuples(index=False):
                due = now if pd.isna(at) else int(at) + self.wait
                if due <= now:
                    ready.append(post)
                else:
                    waiting.append((post, due))
        if newest != held:
            self.author.update(newest)
        if waiting:
            self.posts.appendList(waiting)
            soonest = min(due for _, due in waiting)
            self.set_timer(min([soonest, *self.handle.listTimers()]))
        yield from self.joined(key, ready, newest[1] if newest else None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        record = self.author.get()[1] if self.author.exists() else None
        posts = [tuple(x) for x in self.posts.get()] if self.posts.exists() else []
        later = [(post, due) for post, due in posts if due > now]
        if later:
            self.posts.put(later)
            self.handle.registerTimer(min(due for _, due in later))
        else:
            self.posts.clear()
        yield from self.joined(key, [post for post, due in posts if due <= now], record)


def with_latest_authors(posts: DataFrame, authors: DataFrame, wait_seconds: int, parts: int = 1) -> DataFrame:
    """``(author_id, post, author)``: every post with the newest record of its author, or none.

    ``posts`` has (author_id, post, at) and ``authors`` (author_id, seq, record, at), with posts and
    records as JSON. A post waits until the slower of the two streams has passed it by the wait, so
    records that come after it in that time count, in whatever order things arrive; a later post is
    joined at once. The records stay as state. ``parts`` deals the posts of each author over so many
    keys, to each of which the author's records go.
    """
    none = F.lit(None).cast("string")
    salt = F.pmod(F.xxhash64("post"), F.lit(parts)).cast("int")
    left = on_clock(posts.select("author_id", "post", "at"), "at").select(
        "author_id", salt.alias("part"), "post", F.lit(None).cast("long").alias("seq"), none.alias("record"), "at_ms")
    right = on_clock(authors.select("author_id", "seq", "record", "at"), "at").select(
        "author_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), none.alias("post"),
        F.col("seq").cast("long").alias("seq"), "record", "at_ms")
    kind = posts.schema["author_id"].dataType
    schema = T.StructType([T.StructField("author_id", kind), T.StructField("post", T.StringType()),
                           T.StructField("author", T.StringType())])
    return left.unionByName(right).groupBy("author_id", "part").transformWithStateInPandas(
        statefulProcessor=LatestAuthor(wait_seconds * 1000), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


# --- current posts as signed counts ------------------------------------------------------------------

#: What a post adds to its day, besides itself, and the order of its versions.
MEASURES = ("high", "critical", "network", "hashes", "cve_attack")
LEAST = -(2**63)
DELTA_DDL = ("day_number int, cti_level string, ingested_us long, sign int, "
             + ", ".join(f"{name} long" for name in MEASURES))


class CurrentPosts(Bucket):
    """The current version of each day of a post, and up to which ingest time its rows are deleted.

    There is one row per post and day, or one without a day for a post that has none.
    """

    columns = {"post_id": "string", "upto": "long", "newest": "long", "day": "int",
               "version": "array<long>", "level": "string", "measures": "array<long>"}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):  # noqa: N802, N803
        posts: dict[Any, tuple[int, int, dict]] = {}  # upto, newest and the days
        for post, upto, newest, day, *current in self.load():
            days = posts.setdefault(post, (upto, newest, {}))[2]
            if day is not None:
                days[day] = (list(current[0]), current[1], list(current[2]))
        before: dict[Any, dict] = {}
        gone = set()
        for frame in rows:
            for row in frame.itertuples(index=False):
                post = None if pd.isna(row.post_id) else row.post_id
                upto, newest, days = posts.get(post, (LEAST, LEAST, {}))
                before.setdefault(post, dict(days))
                if row.deleted:
                    gone.add(post)
                else:
                    version = [int(x) for x in row.version]
                    newest = max(newest, version[1])
                    day = int(row.day_number)  # a float beside the nulls of deletes
                    if version[1] > upto and (day not in days or version > days[day][0]):
                        level = None if pd.isna(row.cti_level) else row.cti_level
                        days[day] = (version, level, [int(x) for x in row.measures])
                posts[post] = (upto, newest, days)
        for post in gone:
            posts[post] = (posts[post][1], posts[post][1], {})
        self.store([
            (post, upto, newest, day, *current) for post, (upto, newest, days) in posts.items()
            for day, current in (days or {None: ([], None, [])}).items()])
        out = []
        for post, old in before.items():
            days = posts[post][2]
            for day in old.keys() | days.keys():
                if old.get(day) != days.get(day):
                    out += [(day, current[1], current[0][1], sign, *current[2])
                            for sign, current in ((-1, old.get(day)), (1, days.get(day))) if current]
        if out:
            yield pd.DataFrame(out, columns=["day_number", "cti_level", "ingested_us", "sign", *MEASURES])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):  # noqa: N802, N803
        yield from ()


def signed_counts(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What changes of posts add to and take from their days: one signed row per version.

    ``changes`` comes from :func:`post_changes` and :func:`post_deletes`. A version that becomes
    current is added, and the one it replaces is taken away; late and repeated versions add nothing.
    A delete takes all days of its post away, and rows that it covers (ingested no later than the
    newest row of the post then) stay hidden; of a batch it covers all rows. State is one row per post
    and day.
    """
    found = in_buckets(changes, "post_id", buckets).transformWithStateInPandas(
        statefulProcessor=CurrentPosts(), outputStructType=DELTA_DDL, outputMode="Append", timeMode="None")
    return found.select(
        F.date_add(F.lit("1970-01-01").cast("date"), "day_number").alias("day"), "cti_level",
        F.timestamp_micros("ingested_us").alias("ingested_at"), "sign", *MEASURES)


def _micros(column: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("MICROSECOND", epoch, column), F.lit(LEAST))


def post_changes(posts: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Stored posts as changes; ``measures`` names a count for each of ``MEASURES``."""
    numbers = ("content_version", "impression_count", "like_count")
    version, impressions, likes = (F.coalesce(F.col(x).cast("long"), F.lit(LEAST)) for x in numbers)
    return posts.select(
        "post_id", F.lit(False).alias("deleted"),
        F.date_diff("day", F.lit("1970-01-01").cast("date")).alias("day_number"),
        F.array(version, _micros(F.col("ingested_at")), _micros(F.col("source_updated_at")), impressions, likes)
        .alias("version"), "cti_level",
        F.array(*[measures[name].cast("long") for name in MEASURES]).alias("measures"))


def post_deletes(ids: DataFrame) -> DataFrame:
    none = F.lit(None)
    return ids.select("post_id", F.lit(True).alias("deleted"), none.cast("int").alias("day_number"),
                      none.cast("array<long>").alias("version"), none.cast("string").alias("cti_level"),
                      none.cast("array<long>").alias("measures"))


def current_levels(deltas: DataFrame) -> DataFrame:
    """Current posts per day and level: the sum of all signed counts."""
    return (deltas.groupBy("day", "cti_level").agg(F.sum("sign").cast("bigint").alias("posts"))
            .filter(F.col("posts") != 0))


def day_summaries(deltas: DataFrame) -> DataFrame:
    """One row per day with current posts: counts, measures and the newest ingest time.

    Counts of equal ingest times are added first, since a newest time cannot be taken back otherwise.
    """
    counts = deltas.groupBy("day", "ingested_at").agg(
        F.sum("sign").alias("posts"), *[F.sum(F.col("sign") * F.col(x)).alias(x) for x in MEASURES])
    return counts.groupBy("day").agg(
        F.sum("posts").alias("posts"), *[F.sum(x).alias(x) for x in MEASURES],
        F.max(F.when(F.col("posts") > 0, F.col("ingested_at"))).alias("latest"),
    ).filter(F.col("posts") != 0)
