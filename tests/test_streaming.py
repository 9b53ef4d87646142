from __future__ import annotations

import json
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from postwatch.operators import admission, ingest, ledger, stats
from postwatch.schema import Settings
from postwatch.sources import store
from postwatch.streaming import jobs, keyed

AS_OF = datetime(2026, 1, 31)


def land(spark, rows, schema, path, files):
    """Rows as several files, so that a stream sees several batches."""
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def lines(count):
    out = []
    for n in range(count):
        post = {"id": str(n % 40), "text": f"CVE-2026-{1000 + n} exploit {n}",
                "created_at": f"2026-01-{n % 3 + 1:02d}T00:00:00Z",
                "edit_history_tweet_ids": [str(e) for e in range(n // 40 + 1)]}
        out.append((json.dumps({"post": post, "author": {"username": "u", "protected": n % 7 == 0}}),))
    return [*out, ("not json",), ('{"post": {"id": "", "text": "x"}}',)]


def test_enrichment_in_batches_equals_one_batch(spark, tmp_path):
    path, posts, bad, checkpoint = (str(tmp_path / name) for name in ("in", "out", "bad", "ck"))
    schema = land(spark, lines(100), "value string", path, 4)
    stream = jobs.payload_stream(jobs.landing_stream(spark, path, schema, files_per_trigger=1))
    jobs.enrich_stream(stream, posts, bad, checkpoint, AS_OF)
    batch = jobs.payload_stream(spark.read.parquet(path))
    accepted, rejected = ingest.split_rejects(batch)
    wanted = ingest.prepare_posts(batch, AS_OF)
    columns = ["post_id", "day", "content_version", "text", "cti_score"]
    got = store.read_versions(spark, posts).select(*columns)
    assert got.exceptAll(wanted.select(*columns)).count() == 0
    assert got.count() == accepted.count() == wanted.count()
    reasons = spark.read.parquet(bad).groupBy("reason").count()
    assert reasons.exceptAll(rejected.groupBy("reason").count()).count() == 0
    assert store.read_current(spark, posts).count() == wanted.select("day", "post_id").distinct().count()
    # A second run finds nothing new.
    stream = jobs.payload_stream(jobs.landing_stream(spark, path, schema, files_per_trigger=1))
    jobs.enrich_stream(stream, posts, bad, checkpoint, AS_OF)
    assert store.read_versions(spark, posts).count() == wanted.count()


def test_daily_deltas_sum_to_the_rollup(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    rows = [(datetime(2026, 1, n % 5 + 1).date(), ["low", "high"][n % 2]) for n in range(50)]
    schema = land(spark, rows, "day date, cti_level string", path, 3)
    stream = jobs.landing_stream(spark, path, schema, files_per_trigger=1)
    jobs.daily_level_stream(stream, out, checkpoint)
    got = jobs.read_daily_levels(spark, out)
    assert spark.read.parquet(out).count() > got.count()
    assert got.exceptAll(stats.daily_levels(spark.read.parquet(path))).count() == 0


QUEUE = "source_id string, id bigint, kind int, at timestamp, place bigint"


def at(seconds):
    return datetime(2026, 1, 1) + timedelta(seconds=seconds)


def one_by_one(spark, rows, schema, path):
    """A stream whose batches hold one list of rows each."""
    for number, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{number}")
        time.sleep(0.002)  # files are taken by their times
    return jobs.landing_stream(spark, f"{path}/*", spark.read.schema(schema).parquet(f"{path}/0").schema,
                               files_per_trigger=1)


def test_the_queue_follows_its_outcomes(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    came, failed, done = keyed.ARRIVED, keyed.FAILED, keyed.DONE
    batches = [
        [("s", 2, came, at(0), 2), ("s", 1, came, at(1), 1), ("t", 3, came, at(1), 3), ("u", 4, came, None, 4)],
        [("s", 5, came, at(2), 5), ("s", 1, failed, at(3), 0), ("t", 9, done, at(3), 0)],  # 9 is not open
        [("t", 6, came, at(20), 6), ("t", 3, done, at(20), 0)],  # done first, then queued again
        [("s", 1, failed, at(5), 0), ("v", 7, came, at(40), 7)],  # postponed once more
        [("v", 8, came, at(41), 8)],
        [("v", 7, done, at(42), 0), ("s", 1, done, at(42), 0), ("s", 10, came, at(43), 10)],
    ]
    stream = one_by_one(spark, batches, QUEUE, path)
    jobs.queue_stream(stream, out, checkpoint, 30, tasks=2)
    rows = spark.read.parquet(out).collect()
    got = sorted((r["source_id"], r["id"], r["attempts"], r["available_at"]) for r in rows)
    assert got == sorted([
        ("s", 1, 0, at(1)), ("t", 3, 0, at(1)), ("u", 4, 0, datetime(1970, 1, 1)), ("t", 6, 0, at(20)),
        ("v", 7, 0, at(40)), ("s", 1, 2, at(35)), ("s", 10, 0, at(43))])
    assert jobs.read_queued(spark, out).count() == 6


def test_late_sightings_are_not_lost(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    rows = [("a", datetime(2026, 6, 1)), ("b", datetime(2026, 6, 2)), ("old", datetime(2026, 1, 1)),
            ("old", datetime(2026, 1, 1)), ("a", datetime(2026, 6, 20)), ("c", datetime(2026, 8, 1)),
            ("b", datetime(2026, 8, 1)), ("c", datetime(2026, 8, 2)), (None, None)]
    stream = one_by_one(spark, [[row] for row in rows], "post_id string, seen_at timestamp", path)
    jobs.seen_stream(stream, out, checkpoint, 30, tasks=2)
    found = [(r["post_id"], r["seen_at"]) for r in jobs.read_seen(spark, out).collect()]
    # "old" is new once though it is late, and "b" is forgotten by August.
    assert sorted(found, key=str) == sorted([rows[0], rows[1], rows[2], rows[5], rows[6], rows[8]], key=str)


def test_keyed_streams_do_not_read_what_they_wrote(spark, tmp_path):
    stream = one_by_one(spark, [[("a", datetime(2026, 6, 1))]], "post_id string, seen_at timestamp",
                        str(tmp_path / "in"))
    plan = keyed.seen_ids(stream, 30)._jdf.queryExecution().logical().toString()
    assert plan.count("StreamingRelation") == 1 and plan.count("Relation") == 2  # itself and an empty one


def test_idle_keys_start_afresh_and_are_forgotten(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))

    def micros(second):
        return second * 1_000_000

    batches = [[(1, micros(n), n) for n in range(6)], [(2, micros(100), 10)],
               [(1, micros(101 + n), 20 + n) for n in range(3)], [(2, micros(50), 30), (2, micros(101), 31)]]
    stream = one_by_one(spark, batches, "k int, at bigint, id int", path)
    keyed.append_stream(jobs.admission_stream(stream, "k", "at", "id", 2, 3600, idle_seconds=60), out,
                        checkpoint, 2)
    admitted = sorted(r["id"] for r in spark.read.parquet(out).filter("admitted").collect())
    # Key 1 is decided again after its silence; the late event of key 2 counts and changes nothing else.
    assert admitted == [0, 1, 10, 20, 21, 30]
    held = spark.read.format("statestore").option("stateVarName", "accepted").load(checkpoint)
    assert {r["key"][0] for r in held.collect()} == {1, 2}


def test_an_idle_key_leaves_no_state(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    batches = [[(1, n * 1_000_000, n) for n in range(3)], [(2, 10_000_000_000, 10)], [(2, 10_001_000_000, 11)]]
    stream = one_by_one(spark, batches, "k int, at bigint, id int", path)
    keyed.append_stream(jobs.admission_stream(stream, "k", "at", "id", 2, 60, idle_seconds=3600), out,
                        checkpoint, 2)
    held = spark.read.format("statestore").option("stateVarName", "accepted").load(checkpoint)
    assert [r["key"][0] for r in held.collect()] == [2]


def test_authors_count_in_any_order(spark, tmp_path):
    out, checkpoint = (str(tmp_path / name) for name in ("out", "ck"))
    posts = [[("a", "p1", at(0)), ("b", "p2", at(1)), (None, "p3", None)], [("a", "p4", at(500))],
             [("a", "p5", at(3)), ("c", "p6", at(2_000))], [(None, None, at(9_000))]]
    authors = [[("b", 5, "new b", at(2)), ("b", 1, "old b", at(0))], [("a", 1, "old a", at(10)), ("b", 3, "b", at(20))],
               [("a", 2, "new a", at(1_900))], [("d", 1, "d", at(9_000))]]
    rows = keyed.with_latest_authors(
        one_by_one(spark, posts, "author_id string, post string, at timestamp", str(tmp_path / "posts")),
        one_by_one(spark, authors, "author_id string, seq int, record string, at timestamp", str(tmp_path / "authors")),
        100, parts=2)
    keyed.append_stream(rows, out, checkpoint, 2)
    found = {r["post"]: r["author"] for r in spark.read.parquet(out).collect()}
    # All but p3 wait for the slower stream and meet records that came later.
    assert found == {"p1": "new a", "p2": "new b", "p3": None, "p4": "new a", "p5": "new a", "p6": None}


def test_counts_are_observed_while_rows_pass(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    batches = [[("s", 1, keyed.ARRIVED, at(0), 1), ("s", 2, keyed.ARRIVED, at(1), 2)],
               [("s", 1, keyed.FAILED, at(2), 0), ("t", 3, keyed.ARRIVED, at(90), 3)]]
    counts = jobs.queue_stream(one_by_one(spark, batches, QUEUE, path), out, checkpoint, 30, tasks=2)
    assert counts.asDict() == {"fetched": 3, "enqueued": 2, "retried": 1}
    rows, seen = ledger.counting(spark.range(50), "rows", n=F.count(F.lit(1)), most=F.max("id"))
    assert rows.filter("id > 40").count() == 9 and seen.get == {"n": 50, "most": 49}


def test_signed_counts_equal_the_current_posts(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    rng = random.Random(5)
    schema = ("post_id string, deleted boolean, day_number int, version array<long>, cti_level string, "
              "measures array<long>")
    batches, current, upto, newest = [], {}, {}, {}
    for _ in range(5):
        batch, gone = [], set()
        for _ in range(40):
            post, day = f"p{rng.randrange(6)}", rng.randrange(3)
            version = [rng.randrange(3), rng.randrange(50), 0, 0, 0]
            row = (post, False, day, version, rng.choice(["low", "high"]), [rng.randrange(2) for _ in range(5)])
            if any(x[:4] == row[:4] for x in batch) or current.get((post, day), [None])[0] == version:
                continue
            batch.append(row)
        batch += [batch[0], batch[0]]
        if rng.random() < 0.6:
            gone.add(f"p{rng.randrange(6)}")
        batches.append(batch + [(post, True, None, None, None, None) for post in gone])
        for post, _, day, version, level, numbers in batch:
            newest[post] = max(newest.get(post, -1), version[1])
            if version[1] > upto.get(post, -1) and version > current.get((post, day), [[-1]])[0]:
                current[post, day] = [version, level, numbers]
        for post in gone:
            upto[post] = newest.get(post, -1)
            current = {key: value for key, value in current.items() if key[0] != post}
    jobs.current_stream(one_by_one(spark, batches, schema, path), out, checkpoint, tasks=2)
    deltas = spark.read.parquet(out)
    levels = {(r["day"].day - 1, r["cti_level"]): r["posts"] for r in keyed.current_levels(deltas).collect()}
    assert levels == Counter((day, value[1]) for (_, day), value in current.items())
    for row in keyed.day_summaries(deltas).collect():
        own = [value for (_, day), value in current.items() if day == row["day"].day - 1]
        assert row["posts"] == len(own)
        assert [row[name] for name in keyed.MEASURES] == [sum(x[2][i] for x in own) for i in range(5)]
        assert row["latest"].microsecond == max(x[0][1] for x in own)
    assert keyed.day_summaries(deltas).count() == len({day for _, day in current})


def test_streamed_admission_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(n % 3, datetime(2026, 1, 1, 0, n // 7 % 60, n * 13 % 60), n) for n in range(200)]
    schema = land(spark, sorted(rows, key=lambda r: r[1]), "k int, ts timestamp_ntz, id int", path, 1)
    stream = jobs.landing_stream(spark, path, schema).withColumn(
        "at", F.unix_micros(F.col("ts").cast("timestamp")))
    with keyed.keyed_state(spark, 2):
        got = jobs.collect_stream(jobs.admission_stream(stream, "k", "at", "id", 4), "adm")
    wanted = admission.admit(spark.read.parquet(path), "k", "ts", "id", 4)
    assert got.exceptAll(wanted).count() == 0 and got.count() == 200


def test_settings_have_the_documented_defaults():
    settings = Settings()
    assert settings.daily_read_budget == 10_000 and settings.seen_retention_days == 30


def test_a_stream_with_many_keys_makes_few_calls(spark, tmp_path):
    """Half of the keys wait for one moment; keys beside null stay exact."""
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    count, big = 20_000, 2**60
    came = [(str(n), big + n, keyed.ARRIVED, at(0), n) for n in range(count)]
    failed = [(str(n), big + n, keyed.FAILED, at(1), n) for n in range(0, count, 2)]
    late = [(None, 5, keyed.ARRIVED, at(60), 0)]
    stream = one_by_one(spark, [came, failed, late], QUEUE, path)
    counts = jobs.queue_stream(stream, out, checkpoint, 30, tasks=8)
    assert counts.asDict() == {"fetched": count + 1, "enqueued": count + 1, "retried": count // 2}
    retried = spark.read.parquet(out).filter("attempts = 1").collect()
    assert {(r["source_id"], r["id"]) for r in retried} == {(x[0], x[1]) for x in failed}
    held = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    assert held.count() <= keyed.BUCKETS + 1


def test_seen_numbers_stay_exact_beside_null(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ck"))
    rows = [[(2**60 + 1, at(0)), (None, at(1)), (2**60 + 2, None)], [(2**60 + 1, at(2)), (None, at(3)), (7, at(4))]]
    jobs.seen_stream(one_by_one(spark, rows, "post_id bigint, seen_at timestamp", path), out, checkpoint, 30, tasks=2)
    found = {(r["post_id"], r["seen_at"]) for r in jobs.read_seen(spark, out).collect()}
    assert found == {(2**60 + 1, at(0)), (None, at(1)), (2**60 + 2, None), (7, at(4))}


def test_admission_lists_no_timers():
    """A key that comes again moves its timer, and is forgotten once it is silent."""
    class Handle:
        state, timers = None, set()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            return self.state is not None

        def get(self):
            return self.state

        def update(self, row):
            self.state = row

        def clear(self):
            self.state = None

        def listTimers(self):  # noqa: N802
            raise AssertionError("a call per key")

        def registerTimer(self, moment):  # noqa: N802
            self.timers.add(moment)

        def deleteTimer(self, moment):  # noqa: N802
            self.timers.remove(moment)

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    handle, second = Handle(), 1_000_000
    processor = keyed.Admission("k", "at", "id", 9, 3600, 60)
    processor.init(handle)
    for times in ([5, 0], [40], [30]):
        frame = pd.DataFrame({"k": 1, "at": [n * second for n in times], "id": times})
        list(processor.handleInputRows((1,), iter([frame]), Clock(0)))
    assert handle.timers == {100_001} and handle.state == (40 * second, [n * second for n in (0, 5, 40, 30)])
    list(processor.handleExpiredTimer((1,), Clock(100_000), None))
    assert handle.exists()
    list(processor.handleExpiredTimer((1,), Clock(100_001), None))
    assert not handle.exists()
