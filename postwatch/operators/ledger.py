"""Queue, seen ids, usage, key/value state, audit and status as tables.

Every ledger is append-only; the current state is an aggregate over it, combined map-side.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.functions.records import is_stale, ntz
from postwatch.schema import Settings
from postwatch.session import fresh_dir

# --- queue (id, source_id, payload, attempts, available_at) --------------------------------------


def enqueue(queue: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    """Incoming rows whose ``source_id`` is not queued yet; of repeats the first arrival stays."""
    first = Window.partitionBy("source_id").orderBy(arrival)
    distinct = (
        incoming.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
    return distinct.join(queue.select("source_id"), "source_id", "left_anti")


def queue_batch(queue: DataFrame, as_of: datetime, limit: int = 100) -> DataFrame:
    """The oldest rows that may be worked on now."""
    return queue.filter(F.col("available_at") <= ntz(as_of)).orderBy("id").limit(limit)


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("id"), "id", "left_anti")


def retry(queue: DataFrame, failed: DataFrame, as_of: datetime, delay_seconds: int) -> DataFrame:
    """Count an attempt and postpone the failed rows; there is no cap on attempts."""
    marked = queue.join(failed.select("id", F.lit(True).alias("_failed")).distinct(), "id", "left")
    again = F.timestamp_add("SECOND", F.lit(delay_seconds), ntz(as_of))
    return marked.withColumns(
        {
            "attempts": F.when(F.col("_failed"), F.col("attempts") + 1).otherwise(F.col("attempts")),
            "available_at": F.when(F.col("_failed"), again).otherwise(F.col("available_at")),
        }
    ).drop("_failed")


def queue_stats(queue: DataFrame) -> DataFrame:
    size = F.sum(F.octet_length("payload").cast("bigint"))
    return queue.agg(
        F.count(F.lit(1)).alias("depth"),
        F.coalesce(size, F.lit(0).cast("bigint")).alias("bytes"),
    )


# --- seen ids (post_id, seen_at) -----------------------------------------------------------------


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "post_id") -> DataFrame:
    return candidates.join(seen.select(key), key, "left_anti")


def mark_seen(seen: DataFrame, sightings: DataFrame) -> DataFrame:
    """Insert or ignore: the first time an id was seen stays."""
    both = seen.select("post_id", "seen_at").unionByName(sightings.select("post_id", "seen_at"))
    return both.groupBy("post_id").agg(F.min("seen_at").alias("seen_at"))


def prune_seen(seen: DataFrame, as_of: datetime, retention_days: int) -> DataFrame:
    """Forget ids seen before the cutoff; one seen exactly at it stays."""
    return seen.filter(
        F.col("seen_at") >= F.timestamp_add("DAY", F.lit(-retention_days), ntz(as_of))
    )


# --- reads, budget, high-water marks -------------------------------------------------------------


def daily_usage(reads: DataFrame, day: Column, count: Column) -> DataFrame:
    return reads.groupBy(day.alias("day")).agg(
        F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("post_reads")
    )


def usage_on(usage: DataFrame, day: str) -> DataFrame:
    """Reads of one day, 0 where nothing was recorded."""
    total = F.sum("post_reads").cast("bigint")
    return usage.filter(F.col("day") == F.to_date(F.lit(day))).agg(
        F.coalesce(total, F.lit(0).cast("bigint")).alias("post_reads")
    )


#: The second of reads without a time, which stand first.
NO_SECOND = -(2**63)
#: Reads of the second in which a day's budget ends that are ranked in one task at most, about.
MOST_RANKED = 500_000


def budget_cap(
    reads: DataFrame,
    budget: int,
    day: str = "day",
    order: Sequence[str] = ("ts", "id"),
    most_ranked: int = MOST_RANKED,
) -> DataFrame:
    """The first ``budget`` reads of every day; ``order`` starts with a time. Runs a job.

    Reads are counted per second, combined in the map tasks, and running totals over a day's seconds
    (86,400 at most) give the second in which its budget runs out. Earlier reads pass and later ones
    do not, without being sorted; only the reads of that one second are ranked. Reads without a time
    stand before all others and count like them. Where that second has very many reads (bulk loads,
    times of whole days) it is cut into ranges of ``order`` first, and only the range in which the
    budget runs out is ranked.
    """
    spark = reads.sparkSession
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    second = F.coalesce(F.timestamp_diff("SECOND", epoch, order[0]), F.lit(NO_SECOND))
    counts = reads.groupBy(F.col(day).alias("_day"), second.alias("_second")).agg(
        F.count(F.lit(1)).alias("_n"))
    ends = _run_out(counts, "_second", F.lit(budget)).select("_day", "_second", "_room", "_n").toArrow()
    if not ends.num_rows:
        return reads
    # One row per calendar day. A missing one means that the whole day fits.
    last = spark.createDataFrame(ends).select("_day", F.col("_second").alias("_end"), "_room")
    marked = reads.withColumn("_second", second).join(
        F.broadcast(last), F.col(day).eqNullSafe(F.col("_day")), "left")
    early = marked.filter(F.col("_end").isNull() | (F.col("_second") < F.col("_end")))
    at_end = marked.filter(F.col("_second") == F.col("_end")).select(*reads.columns, "_room")
    crowded = max(ends.column("_n").to_pylist())
    if crowded > most_ranked:
        parts = 2 * -(-sum(ends.column("_n").to_pylist()) // most_ranked)
        before, at_end = _sliced(at_end, day, order, parts)
        early = early.select(*reads.columns).unionByName(before)
    at_end = at_end.withColumn("_rank", F.row_number().over(Window.partitionBy(day).orderBy(*order)))
    return early.select(*reads.columns).unionByName(
        at_end.filter(F.col("_rank") <= F.col("_room")).select(*reads.columns))


def _run_out(counts: DataFrame, cell: str, budget: Column) -> DataFrame:
    """Per ``_day`` the first row of ``counts`` beyond the budget, and the room left before it."""
    so_far = Window.partitionBy("_day").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.withColumn("_total", F.sum("_n").over(so_far)).withColumn(
        "_room", budget - F.col("_total") + F.col("_n"))
    beyond = total.filter(F.col("_total") > budget)
    names = [name for name in beyond.columns if name != "_day"]
    return beyond.groupBy("_day").agg(F.min_by(F.struct(*names), cell).alias("_cut")).select(
        "_day", "_cut.*")


def _sliced(rows: DataFrame, day: str, order: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows that pass whole, and those of the range in which each day's ``_room`` runs out.

    The ranges are written, so that reading them again cannot cut them elsewhere.
    """
    path = fresh_dir(rows.sparkSession, "budget")
    (rows.repartitionByRange(parts, day, *order).withColumn("_slice", F.spark_partition_id())
     .write.parquet(path))
    held = rows.sparkSession.read.parquet(path)
    counts = held.groupBy(F.col(day).alias("_day"), "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_room").alias("_all"))
    cut = _run_out(counts, "_slice", F.col("_all")).select(
        "_day", F.col("_slice").alias("_cut"), F.col("_room").alias("_left"))
    marked = held.join(F.broadcast(cut), F.col(day).eqNullSafe(F.col("_day")), "left")
    before = marked.filter(F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")))
    inside = marked.filter(F.col("_slice") == F.col("_cut")).withColumn("_room", F.col("_left"))
    names = [name for name in rows.columns if name != "_room"]
    return before.select(*names), inside.select(*names, "_room")


def keep_last_per_id(sightings: DataFrame, budget: int, key: str, position: str) -> DataFrame:
    """One row per id, the last one seen, in order of first sight, up to ``budget`` ids.

    Looking stops the moment the budget is full, so sightings after that moment do not count.
    """
    firsts = sightings.groupBy(key).agg(F.min(position).alias("_first"))
    stop = (
        firsts.orderBy("_first")
        .limit(budget)
        .agg(F.when(F.count(F.lit(1)) == budget, F.max("_first")).alias("_stop"))
        .scalar()
    )
    rest = [name for name in sightings.columns if name != key]
    seen = sightings.filter(F.col(position) <= F.coalesce(stop, F.col(position)))
    return (
        seen.groupBy(key)
        .agg(
            F.min(position).alias("first_position"),
            F.max_by(F.struct(*rest), F.col(position)).alias("_last"),
        )
        .select(key, "first_position", *[F.col("_last")[name].alias(name) for name in rest])
        .orderBy("first_position")
        .limit(budget)
    )


def new_since(rows: DataFrame, marks: DataFrame, source: str, row_id: str) -> DataFrame:
    """Rows beyond their source's high-water mark; a source without a mark starts at the beginning."""
    joined = rows.join(marks.select(source, F.col("mark").alias("_mark")), source, "left")
    return joined.filter(F.col("_mark").isNull() | (F.col(row_id) > F.col("_mark"))).drop("_mark")


def advance_marks(marks: DataFrame, fetched: DataFrame, source: str, row_id: str) -> DataFrame:
    """Marks after a fetch; a source that gave nothing keeps its mark."""
    newest = fetched.select(source, F.col(row_id).alias("mark"))
    return marks.select(source, "mark").unionByName(newest).groupBy(source).agg(
        F.max("mark").alias("mark")
    )


def cycle_metrics(
    reads: DataFrame, run: Sequence[str], day: str, source_id: str, position: str
) -> DataFrame:
    """Per run: rows fetched, ids enqueued for the first time, and reads of the day so far.

    The running total is taken over one row per run, never over the reads themselves.
    """
    firsts = reads.groupBy(source_id).agg(
        F.min_by(F.struct(*run), F.col(position)).alias("_run")
    )
    enqueued = firsts.select("_run.*").groupBy(*run).agg(F.count(F.lit(1)).alias("enqueued"))
    fetched = reads.groupBy(*run).agg(F.count(F.lit(1)).alias("fetched"))
    running = Window.partitionBy(day).orderBy(*run).rowsBetween(Window.unboundedPreceding, 0)
    return (
        fetched.join(enqueued, list(run), "left")
        .fillna(0, ["enqueued"])
        .withColumn("daily_reads", F.sum("fetched").over(running))
    )


# --- key/value state and audit -------------------------------------------------------------------


def kv_latest(entries: DataFrame, key: str = "key", value: str = "value",
              order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Last written value per key."""
    return entries.groupBy(F.col(key).alias("key")).agg(
        F.max_by(F.col(value), F.struct(*order)).alias("value")
    )


def kv_get(state: DataFrame, key: str, default: str = "") -> DataFrame:
    return state.filter(F.col("key") == key).agg(
        F.coalesce(F.max("value"), F.lit(default)).alias("value")
    )


def counting(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and what is counted while an action reads them; no second pass is needed.

    ``name`` also tells the counts apart in the query's progress. The counts are those of the first
    action on the rows.
    """
    seen = Observation(name)
    return rows.observe(seen, *[column.alias(key) for key, column in metrics.items()]), seen


def observed_audit(spark: SparkSession, event_type: str, counts: dict, at: str) -> DataFrame:
    """One audit entry of observed counts."""
    detail = json.dumps(counts, separators=(",", ":"))
    return spark.createDataFrame([(event_type, detail, at)],
                                 "event_type string, detail string, created_at string")


def audit_rows(rows: DataFrame, event_type: Column, detail: Sequence[str], at: Column) -> DataFrame:
    """Audit entries with their details as compact JSON."""
    return rows.select(
        event_type.alias("event_type"), F.to_json(F.struct(*detail)).alias("detail"),
        at.alias("created_at"),
    )


# --- status --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ledgers:
    """The tables a status report reads: queue, usage per day, and latest key/value state."""

    queue: DataFrame
    usage: DataFrame
    state: DataFrame


def ingest_status(
    ledgers: Ledgers,
    as_of: datetime,
    settings: Settings | None = None,
    store_ok: bool = True,
    source_connected: bool = True,
) -> DataFrame:
    """One row with depth, bytes, reads, last events and health flags.

    Each ledger gives one partial row; the partial rows are stacked and folded into one.
    """
    settings = settings or Settings()
    today = ntz(as_of).cast("date")
    state = {
        "last_success": "last_collector_success",
        "last_compliance_success": "last_compliance_success",
        "last_error": "last_collector_error",
        "scoring_mode": "worker_scoring_mode",
    }
    kv = ledgers.state.filter(F.col("key").isin(*state.values())).agg(
        *[F.max(F.when(F.col("key") == key, F.nullif(F.col("value"), F.lit("")))).alias(name)
          for name, key in state.items()]
    )
    reads = ledgers.usage.filter(F.col("day") == today).agg(
        F.sum("post_reads").cast("bigint").alias("daily_post_reads")
    )
    parts = [
        queue_stats(ledgers.queue).select(
            F.col("depth").alias("queue_depth"), F.col("bytes").alias("queue_bytes")
        ),
        reads,
        kv,
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    zero = F.lit(0).cast("bigint")
    folded = stacked.agg(
        *[F.coalesce(F.max(name), zero).alias(name)
          for name in ("queue_depth", "queue_bytes", "daily_post_reads")],
        *[F.max(name).alias(name) for name in state],
    )
    stale = is_stale(F.col("last_compliance_success"), ntz(as_of), settings.stale_hours)
    flagged = folded.withColumns(
        {
            "scoring_mode": F.coalesce("scoring_mode", F.lit("unknown")),
            "compliance_stale": stale,
            "compliance_due": is_stale(
                F.col("last_compliance_success"), ntz(as_of), settings.due_hours
            ),
            "queue_ok": F.col("queue_depth") < settings.queue_depth_warning,
            "budget_ok": F.col("daily_post_reads") < settings.daily_read_budget,
            "queue_full": F.col("queue_bytes") >= settings.queue_byte_limit,
        }
    )
    ready = (
        F.lit(store_ok) & (F.col("scoring_mode") == "hybrid") & ~F.col("compliance_stale")
        & F.lit(source_connected)
    )
    return flagged.withColumn("ready", ready)
