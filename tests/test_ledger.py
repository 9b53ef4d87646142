from __future__ import annotations

import random
import re
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwatch.operators import admission, ledger
from postwatch.schema import Settings

AS_OF = datetime(2026, 1, 10)


def test_queue_life(spark):
    schema = "id bigint, source_id string, payload string, attempts int, available_at timestamp_ntz"
    queue = spark.createDataFrame([(1, "a", "xé", 0, AS_OF), (2, "b", "y", 0, AS_OF)], schema)
    arriving = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], "id bigint, source_id string")
    assert [tuple(r) for r in ledger.enqueue(queue, arriving, "id").collect()] == [("c", 4)]
    assert tuple(ledger.queue_stats(queue).first()) == (2, 4)
    failed = spark.createDataFrame([(1,)], "id bigint")
    again = ledger.retry(queue, failed, AS_OF, 30)
    assert [r["id"] for r in ledger.queue_batch(again, AS_OF).collect()] == [2]
    later = ledger.queue_batch(again, AS_OF + timedelta(seconds=30)).collect()
    assert [(r["id"], r["attempts"]) for r in later] == [(1, 1), (2, 0)]
    left = ledger.acknowledge(queue, queue.select("id"))
    assert tuple(ledger.queue_stats(left).first()) == (0, 0)


def test_seen_and_prune(spark):
    seen = spark.createDataFrame([("1", AS_OF), ("2", AS_OF)], "post_id string, seen_at timestamp_ntz")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "post_id string")
    assert [r["post_id"] for r in ledger.unseen(ids, seen).collect()] == ["3"]
    same = ledger.mark_seen(seen, seen.withColumn("seen_at", F.lit("2027-01-01").cast("timestamp_ntz")))
    assert {r["seen_at"] for r in same.collect()} == {AS_OF}
    assert ledger.prune_seen(seen, AS_OF, 0).count() == 2  # exactly at the cutoff stays
    assert ledger.prune_seen(seen, AS_OF + timedelta(seconds=1), 0).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 70, 1500, 10_000])
def test_budget_is_exact_on_a_busy_day(spark, budget):
    rng = random.Random(budget)
    rows = [(n, rng.choice(["a"] * 6 + ["b", None]),
             AS_OF + timedelta(milliseconds=100 * rng.randint(0, 500))) for n in range(3000)]
    df = spark.createDataFrame(rows, "id int, day string, ts timestamp_ntz")
    got = {r["id"] for r in ledger.budget_cap(df, budget).collect()}
    wanted = set()
    for day in {r[1] for r in rows}:
        wanted |= {r[0] for r in sorted((r for r in rows if r[1] == day),
                                        key=lambda r: (r[2], r[0]))[:budget]}
    assert got == wanted


def test_budget_has_the_same_plan_at_any_size(spark):
    df = spark.range(10).selectExpr("id", "'a' AS day", "TIMESTAMP_NTZ'2026-01-01 00:00:00' AS ts")
    plans = [ledger.budget_cap(df, budget)._jdf.queryExecution().sparkPlan().toString()
             for budget in (100, 10_000)]
    shapes = [re.findall(r"^[ :+-]*(\w+)", plan, re.M) for plan in plans]
    assert shapes[0] == shapes[1]


@pytest.mark.parametrize("budget", [1, 5, 12, 100])
def test_keep_last_stops_when_full(spark, budget):
    rng = random.Random(budget)
    rows = [(n, f"k{rng.randint(0, 11)}", f"v{n}") for n in range(60)]
    kept: dict[str, str] = {}
    for _, key, value in rows:
        kept[key] = value
        if len(kept) >= budget:
            break
    df = spark.createDataFrame(rows, "pos int, id string, value string")
    got = ledger.keep_last_per_id(df, budget, "id", "pos").collect()
    assert [(r["id"], r["value"]) for r in got] == list(kept.items())


def test_marks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "s string, id int")
    marks = spark.createDataFrame([("a", 3), ("c", 9)], "s string, mark int")
    fetched = ledger.new_since(rows, marks, "s", "id")
    assert sorted(tuple(r) for r in fetched.collect()) == [("a", 5), ("b", 2)]
    after = ledger.advance_marks(marks, fetched, "s", "id")
    assert sorted(tuple(r) for r in after.collect()) == [("a", 5), ("b", 2), ("c", 9)]


def test_key_value_defaults(spark):
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, value string, updated_at int")
    state = ledger.kv_latest(rows)
    assert ledger.kv_get(state, "k").first()["value"] == "new"
    assert ledger.kv_get(state, "none", "x").first()["value"] == "x"


def status(spark, entries, depth=0, reads=0):
    queue = spark.range(depth).select(F.lit("abc").alias("payload"))
    usage = spark.createDataFrame([(AS_OF.date(), reads)], "day date, post_reads bigint")
    state = spark.createDataFrame(list(entries.items()), "key string, value string")
    return ledger.ingest_status(ledger.Ledgers(queue, usage, state), AS_OF, Settings()).first()


def test_status(spark):
    fresh = "2026-01-09T12:00:00+00:00"
    good = status(spark, {"last_compliance_success": fresh, "worker_scoring_mode": "hybrid",
                          "last_collector_error": ""}, 3, 10)
    assert good["ready"] and not good["compliance_stale"] and good["last_error"] is None
    assert (good["queue_depth"], good["queue_bytes"], good["daily_post_reads"]) == (3, 9, 10)
    bad = status(spark, {"last_collector_error": "late"}, 1000, 10_000)
    assert not bad["ready"] and bad["compliance_stale"] and bad["last_error"] == "late"
    assert bad["scoring_mode"] == "unknown" and not bad["queue_ok"] and not bad["budget_ok"]


def walk(events, limit, window):
    """Admission one event at a time."""
    times, verdicts = defaultdict(deque), {}
    for key, at, row in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        queue = times[key]
        while queue and (at - queue[0]).total_seconds() > window:
            queue.popleft()
        verdicts[row] = len(queue) < limit
        if verdicts[row]:
            queue.append(at)
    return verdicts


@pytest.mark.parametrize(("limit", "window"), [(1, 60), (2, 60), (5, 60), (3, 1), (60, 60)])
def test_admission_equals_event_by_event(spark, limit, window):
    rng = random.Random(limit * 100 + window)
    events, row = [], 0
    for key in range(6):
        at = datetime(2025, 12, 31, 23, 58)
        for _ in range(400 if key == 0 else 60):
            at += timedelta(seconds=rng.choice([0, 0, 1, 5, 20, 60, 61, 200]),
                            microseconds=rng.choice([0, 0, 1]))
            events.append((key, at, row))
            row += 1
    df = spark.createDataFrame(events, "k int, ts timestamp_ntz, id int")
    got = {r["id"]: r["admitted"]
           for r in admission.admit(df, "k", "ts", "id", limit, window).collect()}
    assert got == walk(events, limit, window)


def test_two_of_three_at_once(spark):
    df = spark.createDataFrame([("u", AS_OF, n) for n in range(3)], "k string, ts timestamp_ntz, id int")
    rows = admission.admit(df, "k", "ts", "id", 2).orderBy("id").collect()
    assert [r["admitted"] for r in rows] == [True, True, False]


@pytest.mark.parametrize(("limit", "window", "steps"), [
    (1, 60, [0, 1, 2, 9, 40, 61]), (3, 60, [0, 0, 1, 5, 20, 60, 61, 200]), (2, 60, [1]), (5, 10, [0, 1, 7])])
def test_one_busy_key_is_walked_in_chunks(spark, limit, window, steps):
    rng = random.Random(limit)
    at, events = datetime(2025, 12, 31, 23, 58), []
    for row in range(3000):
        at += timedelta(seconds=rng.choice(steps))
        events.append(("busy", at, row))
    events += [("busy", events[500][1], 10_000 + row) for row in range(40)]  # one crowded moment
    events += [("calm", AS_OF + timedelta(seconds=9 * n), 20_000 + n) for n in range(60)]
    df = spark.createDataFrame(events, "k string, ts timestamp_ntz, id int").repartition(5)
    found = admission.admit(df, "k", "ts", "id", limit, window, chunk_events=250)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r["id"]: r["admitted"] for r in rows} == walk(events, limit, window)
    assert len(rows) == len(events)


def test_chunks_of_one_key_run_on_many_tasks(spark, tmp_path):
    rows = [("busy", n, n * 2_000_000 // admission.MICROS, 0, n * 2_000_000) for n in range(4000)]
    busy = spark.createDataFrame(rows, "k string, id int, _cell long, _stretch long, _at long")
    chunked, refused = admission._chunked(busy, "k", "id", 2, 60 * admission.MICROS, 300)
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 400 and sum(sizes) == 4000 and refused.isEmpty()
    none = F.array().cast("array<long>")
    rings = chunked.select("k", "_stretch", "_chunk").distinct().withColumns({"_old": none, "_new": none})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = admission._with_heads(chunked, rings, "k", "id")
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_skipping_refused_events_changes_nothing():
    rng = random.Random(9)
    for limit in (0, 1, 3, 20):
        times = sorted(rng.randrange(2000) for _ in range(700))
        one, many = admission.Ring(limit, 60), admission.Ring(limit, 60)
        wanted = [one.admits(at) for at in times]
        got = [many.verdicts(np.array(times[a: a + 90])).tolist() for a in range(0, 700, 90)]
        assert sum(got, []) == wanted and many.times == one.times


def capped(rows, budget):
    """The first reads of each day, those without a time first."""
    kept, days = [], defaultdict(int)
    for day, at, row in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or AS_OF, r[2])):
        days[day] += 1
        if days[day] <= budget:
            kept.append(row)
    return sorted(kept)


@pytest.mark.parametrize("most_ranked", [3, 1000])
@pytest.mark.parametrize("budget", [0, 1, 2, 3, 7, 40, 500])
def test_reads_without_or_with_one_time_count(spark, budget, most_ranked):
    noon = datetime(2026, 1, 1, 12)
    rows = [("a", None if n < 2 else noon + timedelta(seconds=n), n) for n in range(4)]
    rows += [("b", noon, n) for n in range(100, 160)]  # one time for all
    rows += [(None, noon + timedelta(microseconds=n % 7), n) for n in range(200, 230)]
    rows += [("c", None, n) for n in range(300, 350)]
    df = spark.createDataFrame(rows, "day string, ts timestamp_ntz, id int").repartition(3)
    got = ledger.budget_cap(df, budget, most_ranked=most_ranked)
    assert got.columns == ["day", "ts", "id"]
    assert sorted(r["id"] for r in got.collect()) == capped(rows, budget)


def test_a_crowded_second_is_cut_into_ranges(spark):
    rows = spark.range(10_000).select(F.lit("d").alias("day"), F.lit(AS_OF).alias("ts"), "id",
                                      F.lit(4_321).cast("long").alias("_room"))
    before, inside = ledger._sliced(rows, "day", ("ts", "id"), 20)
    sizes = before.count(), inside.count(), inside.first()["_room"]
    assert sizes[1] < 1_500 and sizes[0] + sizes[2] == 4_321 and 0 <= sizes[2] <= sizes[1]
