"""Structured Streaming jobs over landing tables.

The checkpoint replaces acknowledging a queue: offsets move on only after a batch is written. Where
a replayed batch must not count twice, each batch owns a folder that the replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions.scoring import Scorer, null_scorer
from postwatch.operators.ingest import (
    enrich,
    flatten_payloads,
    split_rejects,
    to_stored,
)
from postwatch.operators.stats import daily_levels
from postwatch.schema import PAYLOAD_DDL, Settings
from postwatch.session import fresh_dir
from postwatch.sources.deletes import delete_events
from postwatch.sources.store import append_posts, delete_posts
from postwatch.streaming import keyed
from postwatch.streaming.keyed import ROCKSDB  # noqa: F401 - the store that keyed streams need


def landing_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1_000,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Parquet files as they land; the trigger limits are the back-pressure."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def payload_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to payloads; an unreadable line becomes a payload without id, which is rejected.

    The generator keeps later filters above it; pushed below, each would parse the text again.
    """
    parsed = F.from_json(value, f"struct<{_fields()}>")
    return lines.select(F.inline(F.array(parsed)))


def _fields() -> str:
    return PAYLOAD_DDL.replace("post struct", "post: struct").replace(
        "author struct", "author: struct"
    )


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has landed, in as many batches as the source limits ask for."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def enrich_stream(
    payloads: DataFrame,
    posts_path: str,
    quarantine_path: str,
    checkpoint: str,
    as_of: datetime | None = None,
    settings: Settings | None = None,
    scorer: Scorer = null_scorer,
    tasks: int | None = None,
) -> None:
    """Payloads to stored posts, rejects with their reason to quarantine.

    ``tasks`` deals the payloads of a batch out where batches consist of few files.

    Appending is at-least-once; a replayed row has the same key and version and drops out when
    current versions are read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(UTC)
        # Read and parsed once for both outputs; a lost part is computed again from the source.
        kept = (batch.repartition(tasks) if tasks else batch).persist()
        try:
            accepted, rejected = split_rejects(kept)
            posts = to_stored(enrich(flatten_payloads(accepted, now), settings, scorer))
            append_posts(posts, posts_path)
            rejected.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    run(payloads, handle, checkpoint)


def delete_stream(lines: DataFrame, posts_path: str, checkpoint: str, name: str = "deletes",
                  value: str = "value") -> None:
    """JSON lines of delete events to tombstones of the stored posts.

    A batch hides what is stored when it runs; posts that arrive later are visible again. Each batch
    has its own folder of tombstones under ``name``, so a replay of a finished batch changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        delete_posts(batch.sparkSession, posts_path, delete_events(batch, value), f"{name}-{batch_id}")

    run(lines, handle, checkpoint)


def daily_level_stream(posts: DataFrame, path: str, checkpoint: str) -> None:
    """Per batch, the added rows per day and level."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        daily_levels(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run(posts, handle, checkpoint)


def read_daily_levels(spark: SparkSession, path: str) -> DataFrame:
    """The rollup: the sum of all deltas."""
    return (
        spark.read.parquet(path)
        .groupBy("day", "cti_level")
        .agg(F.sum("posts").cast("bigint").alias("posts"))
    )


def queue_stream(changes: DataFrame, path: str, checkpoint: str, delay_seconds: int = 30,
                 tasks: int | None = None) -> Row:
    """Append the rows that the work queue hands out (see ``keyed.work_queue``); what this run counted.

    ``fetched`` arrivals, ``enqueued`` source ids and ``retried`` rows are observed while the rows pass,
    so no table is read for them.
    """
    arrived = F.col("kind") == keyed.ARRIVED
    counted = changes.observe("arrived", F.count_if(arrived).alias("fetched"))
    handed = keyed.work_queue(counted, delay_seconds).observe(
        "handed", F.count_if(F.col("attempts") == 0).alias("enqueued"),
        F.count_if(F.col("attempts") > 0).alias("retried"))
    batches = keyed.append_stream(handed, path, checkpoint, tasks)
    names = ("fetched", "enqueued", "retried")
    return Row(**{name: sum(batch.get(name) or 0 for batch in batches) for name in names})


def read_queued(spark: SparkSession, path: str) -> DataFrame:
    """Rows handed out for the first time; those with attempts came back after a failure."""
    return spark.read.parquet(path).filter(F.col("attempts") == 0)


def seen_stream(sightings: DataFrame, path: str, checkpoint: str, retention_days: int = 30,
                tasks: int | None = None) -> None:
    """Store the first sighting of each id; an id counts as new again once it is forgotten.

    No row is left out for being late: a sighting of old is compared with what is remembered like
    any other.
    """
    keyed.append_stream(keyed.seen_ids(sightings, retention_days), path, checkpoint, tasks)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """``(post_id, seen_at)`` of every id that was new when it came."""
    return spark.read.parquet(path)


def current_stream(changes: DataFrame, path: str, checkpoint: str, tasks: int | None = None) -> None:
    """Append signed counts of posts that become current and that cease to be."""
    keyed.append_stream(keyed.signed_counts(changes), path, checkpoint, tasks)


def admission_stream(
    events: DataFrame, key: str, at: str, row_id: str, limit: int, window_seconds: int = 60,
    idle_seconds: int | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """Streaming admission; ``at`` is a time in microseconds. Needs the RocksDB state store.

    State is ``limit`` times per key. With ``idle_seconds`` a key that has been silent for longer starts
    afresh, by the times of its own events, and its state is dropped once the clock, which is the
    newest time of earlier batches less ``delay``, has passed that moment. Events of any lateness are
    decided.
    """
    schema = T.StructType(
        [events.schema[key], events.schema[row_id], T.StructField("admitted", T.BooleanType())]
    )
    rows = events.select(key, at, row_id)
    if idle_seconds is not None:
        rows = keyed.on_clock(rows.withColumn("clock", F.timestamp_micros(at)), "clock", delay)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=keyed.Admission(key, at, row_id, limit, window_seconds, idle_seconds),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None" if idle_seconds is None else "EventTime",
    )


def collect_stream(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what has landed into a fresh folder and return it as a table."""
    spark = stream.sparkSession
    out, checkpoint = fresh_dir(spark, label), fresh_dir(spark, f"{label}-offsets")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
