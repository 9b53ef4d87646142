from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postwatch.operators import search, stats, versions
from postwatch.schema import PageKey, SearchSpec, Settings, Thresholds
from postwatch.sources import deletes, store, synthetic, token_index

AS_OF = datetime(2026, 1, 31)
ROWS = 3000


@pytest.fixture(scope="module")
def posts(spark):
    """Synthetic posts over many days, a third of them in three versions, one row replayed."""
    numbers = spark.range(ROWS).select((F.col("id") * 8191).alias("number"))
    base = synthetic.synthetic_rows(numbers, AS_OF)
    number = F.col("conversation_id").cast("bigint")
    rows = base
    for version in (2, 3):
        rows = rows.unionByName(
            base.filter(number % 3 == 0).withColumns({
                "content_version": F.lit(version),
                "cti_score": (F.col("cti_score") + version) % 101,
                "text": F.concat("text", F.lit(f" v{version}")),
                "normalized_text": F.concat("normalized_text", F.lit(f" v{version}")),
            })
        )
    return rows.unionByName(base.filter(number == 8191)).cache()


@pytest.fixture(scope="module")
def truth(posts):
    """Newest versions by plain Python."""
    newest = {}
    for row in posts.collect():
        key = (row["day"], row["post_id"])
        if key not in newest or row["content_version"] > newest[key]["content_version"]:
            newest[key] = row
    return list(newest.values())


def test_current_versions(posts, truth):
    got = {(r["day"], r["post_id"], r["content_version"])
           for r in versions.current_posts(posts).collect()}
    assert got == {(r["day"], r["post_id"], r["content_version"]) for r in truth}
    assert versions.current_posts(posts).count() == len(truth)


def expected(truth, keep, order):
    return sorted((r for r in truth if keep(r)), key=order, reverse=True)


def by_score(row):
    return (row["cti_score"], row["created_at"], row["post_id"])


@pytest.mark.parametrize("versioned", [True, False])
@pytest.mark.parametrize("sort", ["cti", "newest"])
def test_pages_cover_all_hits_once(posts, truth, versioned, sort):
    rows = posts if versioned else versions.current_posts(posts)
    order = by_score if sort == "cti" else (lambda r: (r["created_at"], r["post_id"]))
    wanted = expected(truth, lambda r: "phishing" in r["text"] and "v2" not in r["text"], order)
    found, after = [], None
    for _ in range(20):
        spec = SearchSpec("phishing infrastructure", sort=sort, limit=100, after=after)
        page = search.search(rows, spec, versioned)
        found += [row["post_id"] for row in page.rows]
        after = page.next_key
        if after is None:
            break
    assert found == [row["post_id"] for row in wanted]


def test_superseded_version_is_not_found(posts):
    assert search.matching(posts, SearchSpec("v2 release", "any"), True).filter(
        F.col("text").contains("v2")
    ).count() == 0
    assert search.matching(posts, SearchSpec("abc v3", "any"), True).count() > 0


@pytest.mark.parametrize(
    ("changes", "keep"),
    [
        ({"lang": "en"}, lambda r: r["lang"] == "en"),
        ({"min_score": 0}, lambda r: True),
        ({"min_score": 50}, lambda r: r["cti_score"] >= 50),
        ({"level": "high"}, lambda r: r["cti_level"] == "high"),
        ({"category": "ioc_sharing"}, lambda r: "ioc_sharing" in r["cti_categories"]),
        ({"ioc_type": "url"}, lambda r: r["ioc_urls"]),
        ({"ioc_type": "attack"}, lambda r: r["ioc_attack_techniques"]),
        ({"ioc_type": "ip"}, lambda r: r["ioc_ipv4"] or r["ioc_ipv6"]),
        ({"author": "@@SYNTHETIC_8191"}, lambda r: r["username"] == "synthetic_8191"),
        ({"date_from": datetime(2025, 12, 1), "date_to": datetime(2026, 1, 10, 5)},
         lambda r: datetime(2025, 12, 1) <= r["created_at"] <= datetime(2026, 1, 10, 5)),
    ],
)
def test_filters(posts, truth, changes, keep):
    query = "exploit campaign advisory release topluluk"
    got = search.matching(posts, SearchSpec(query, "any", **changes), True, ("post_id",))
    words = ("exploit", "campaign", "advisory", "release", "topluluk")
    wanted = [r["post_id"] for r in truth
              if any(w in r["normalized_text"].replace(".", " ").split() for w in words)
              and keep(r)]
    assert sorted(row["post_id"] for row in got.collect()) == sorted(wanted)


def test_date_bounds_reach_the_partition_filter(spark, posts, tmp_path):
    store.append_posts(posts, str(tmp_path / "p"))
    rows = store.read_versions(spark, str(tmp_path / "p"))
    spec = SearchSpec("exploit", date_from=datetime(2026, 1, 1), date_to=datetime(2026, 1, 2))
    plan = search.matching(rows, spec, True)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/p]" in line]
    assert scans
    for line in scans:
        assert "day" in line.split("PartitionFilters: [")[1].split("]")[0]
        assert "text" not in line.split("ReadSchema")[1]


@pytest.mark.parametrize(
    ("query", "mode"),
    [("credential theft", "all"), ("credential v3", "all"), ("flaw release", "any"),
     ("credential theft", "phrase"), ("theft credential", "phrase"), ("v2 nothing", "any"),
     ("absent words", "all")],
)
def test_index_gives_what_a_full_scan_gives(spark, posts, index, query, mode):
    for extra in ({}, {"date_from": datetime(2025, 9, 1), "level": "high"}):
        spec = SearchSpec(query, mode, **extra)
        few = token_index.restrict(posts, index, spec, 16)
        wanted = search.matching(versions.current_posts(posts), spec, columns=("day", "post_id"))
        got = search.matching(few, spec, True, ("day", "post_id"))
        assert sorted(got.collect()) == sorted(wanted.collect())


def scans_of(frame, path):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line and f"{path}]" in line]


def test_index_prunes_days_and_ids_of_the_posts_scan(spark, posts, index, tmp_path):
    path = str(tmp_path / "p")
    store.append_posts(posts, path)
    rows = store.read_versions(spark, path)
    few = token_index.restrict(rows, index, SearchSpec("phishing infrastructure"), 16)
    scans = scans_of(few, path)
    assert scans
    for line in scans:
        days = line.split("PartitionFilters: [")[1].split("]")[0]
        assert "day" in days and ("IN" in days or "INSET" in days or "=" in days)


def test_tokens_of_deleted_posts_leave_the_index(spark, posts, tmp_path):
    path = str(tmp_path / "i")
    token_index.append_index(posts, path, 16)
    gone = posts.filter("cti_level = 'critical'").select("post_id").distinct()
    before = token_index.read_index(spark, path)
    wanted = before.join(gone, "post_id", "left_anti").count()
    assert token_index.remove_from_index(before, path, gone) > 0
    after = token_index.read_index(spark, path)
    assert after.count() == wanted and after.join(gone, "post_id", "left_semi").count() == 0
    assert token_index.remove_from_index(after, path, gone) == 0


def test_a_cursor_prunes_days_of_the_newest_order(posts, spark, tmp_path):
    path = str(tmp_path / "p")
    store.append_posts(posts, path)
    spec = SearchSpec("campaign", sort="newest", after=PageKey(0, datetime(2025, 12, 1), "0"))
    plan = search.matching(store.read_versions(spark, path), spec, True)
    assert all("day" in line.split("PartitionFilters: [")[1].split("]")[0]
               for line in scans_of(plan, path))


@pytest.fixture(scope="module")
def index(spark, posts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    token_index.append_index(posts, path, 16)
    return token_index.read_index(spark, path)


def test_many_superseded_leaders(spark, posts):
    """Old versions that lead the order do not push current rows out of a top list."""
    first = versions.current_posts(posts).limit(400).cache()
    old = first.withColumns({"content_version": F.lit(0), "cti_score": F.lit(100)})
    rows = first.unionByName(old)
    wanted = [r["post_id"] for r in first.orderBy(
        F.col("cti_score").desc(), F.col("created_at").desc(), F.col("post_id").desc()
    ).limit(5).collect()]
    order = ("cti_score", "created_at", "post_id")
    got = versions.top_current(rows, True, None, order, 5, ("post_id", "cti_score", "created_at"))
    assert [r["post_id"] for r in got.collect()] == wanted


def test_cursor_is_none_on_the_last_page(posts):
    page = search.search(posts, SearchSpec("nothing like this", after=PageKey(1, AS_OF, "1")), True)
    assert page.rows == [] and page.next_key is None


def test_recent_top_and_get(posts, truth):
    recent = [r["post_id"] for r in search.recent(posts, 7, versioned=True).collect()]
    assert recent == [r["post_id"] for r in expected(
        truth, lambda r: True, lambda r: (r["ingested_at"], r["post_id"]))[:7]]
    settings = Settings(thresholds=Thresholds(10, 60, 90))
    top = [r["post_id"] for r in search.top_scored(posts, 9, settings, True).collect()]
    assert top == [r["post_id"] for r in expected(
        truth, lambda r: r["cti_score"] >= 60, by_score)[:9]]
    chosen = max(truth, key=lambda r: r["content_version"])
    row = search.get_post(posts, chosen["post_id"]).first()
    assert row["cti_score"] == chosen["cti_score"] and row["source_url"] is None
    assert row["metrics"]["likes"] == chosen["like_count"]
    assert search.get_post(posts, "1").first() is None
    with pytest.raises(ValueError):
        search.get_post(posts, "12a")


def test_statistics(posts, truth):
    parts = stats.overview(posts, AS_OF, versioned=True)
    counts = parts["summary"].first()
    assert counts["total"] == len(truth)
    assert counts["high"] == sum(r["cti_score"] >= 70 for r in truth)
    assert counts["critical"] == sum(r["cti_score"] >= 85 for r in truth)
    assert counts["latest"] == max(r["ingested_at"] for r in truth)
    recent = [r for r in truth if r["created_at"] >= AS_OF - timedelta(days=30)]
    line = {r["day"]: r["posts"] for r in parts["timeline"].collect()}
    assert sum(line.values()) == len(recent) and list(line) == sorted(line)
    categories = {r["category"]: r["posts"] for r in parts["categories"].collect()}
    assert categories == {"ioc_sharing": sum("ioc_sharing" in r["cti_categories"] for r in recent),
                          "vulnerability": sum(
                              "vulnerability" in r["cti_categories"] for r in recent)}
    assert counts["network"] == sum(
        len(r["ioc_ipv4"]) + len(r["ioc_domains"]) + len(r["ioc_urls"]) for r in truth)
    raw = stats.daily_levels(posts).agg(F.sum("posts")).first()[0]
    current = stats.daily_levels(posts, versioned=True).agg(F.sum("posts")).first()[0]
    assert (raw, current) == (posts.count(), len(truth))


def test_empty_table_gives_zeros(posts):
    parts = stats.overview(posts.limit(0), AS_OF, versioned=True)
    assert tuple(parts["summary"].first()) == (0, 0, 0, None, 0, 0, 0)
    assert stats.chart_share(parts["timeline"]).count() == 0


def test_store_keeps_types_and_later_versions_win(spark, posts, truth, tmp_path):
    path = str(tmp_path / "p")
    late = F.col("content_version") == 3
    store.append_posts(posts.filter(late), path)  # the highest version may arrive first
    store.append_posts(posts.filter(~late), path)
    assert store.read_versions(spark, path).schema == posts.schema or set(
        store.read_versions(spark, path).columns) == set(posts.columns)
    current = store.read_current(spark, path)
    assert current.count() == len(truth)
    days = [r["day"] for r in posts.select("day").distinct().collect()]
    store.compact_days(spark, path, days)
    assert store.read_versions(spark, path).count() == len(truth)


def test_compacted_days_are_not_compared(spark, posts, truth, tmp_path):
    path = str(tmp_path / "p")
    store.append_posts(posts, path)
    assert store.settled_days(spark, path).days == ()
    days = sorted(r["day"] for r in posts.select("day").distinct().collect())
    store.compact_days(spark, path, days)
    settled = store.settled_days(spark, path)
    assert settled.days == tuple(days) and not settled.others
    frame = stats.overview_counts(store.read_versions(spark, path), versioned=settled)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert frame.first()["total"] == len(truth)
    late = posts.filter(F.col("day") == days[0]).withColumn("content_version", F.lit(9))
    store.append_posts(late, path)
    settled = store.settled_days(spark, path)
    assert settled.days == tuple(days[1:]) and settled.others
    counts = stats.overview_counts(store.read_versions(spark, path), versioned=settled).first()
    assert counts["total"] == len(truth)


def test_delete_removes_all_versions_and_empty_days(spark, posts, tmp_path):
    path = str(tmp_path / "p")
    store.append_posts(posts, path)
    first_day: date = posts.agg(F.min("day")).first()[0]
    gone = posts.filter(
        (F.col("day") == first_day) | (F.col("cti_level") == "critical")
    ).select("post_id").distinct()
    ids = {r["post_id"] for r in gone.collect()}
    store.delete_posts(spark, path, gone)
    left = store.read_versions(spark, path).collect()
    assert sorted((r["post_id"], r["content_version"]) for r in left) == sorted(
        (r["post_id"], r["content_version"]) for r in posts.collect() if r["post_id"] not in ids)
    assert first_day not in {r["day"] for r in left}
    assert store.delete_posts(spark, path, gone) == 0
    # Nothing was rewritten; a purge does that, and rows that arrive again are seen.
    assert spark.read.parquet(path).count() == posts.count()
    store.purge_days(spark, path, [r["day"] for r in posts.select("day").distinct().collect()])
    assert spark.read.parquet(path).count() == len(left)
    again = posts.filter(F.col("day") == first_day).withColumn(
        "ingested_at", F.expr("timestampadd(DAY, 1, ingested_at)"))
    store.append_posts(again, path)
    assert store.read_versions(spark, path).filter(F.col("day") == first_day).count() == again.count()


def test_delete_events_skip_bad_lines(spark):
    lines = spark.createDataFrame(
        [('{"action":"delete","id":"1"}',), ('{"action":"delete","id":1}',), ("{oops",), ("",),
         ('{"action":"keep","id":"2"}',), ('{"action":"delete"}',), ('[1]',), ('{"id":"3"}',)],
        "value string",
    )
    assert [r["post_id"] for r in deletes.delete_events(lines).collect()] == ["1"]


def test_synthetic_rows_are_checked():
    with pytest.raises(ValueError):
        synthetic.synthetic_posts(None, 0)
    with pytest.raises(ValueError):
        synthetic.synthetic_posts(None, 1_000_000_001)


def test_a_repeated_delete_batch_changes_nothing(spark, posts, tmp_path):
    path = str(tmp_path / "p")
    store.append_posts(posts, path)
    gone = posts.filter("cti_level = 'critical'").select("post_id").distinct()
    found = store.delete_posts(spark, path, gone, "deletes-0")
    left = store.read_versions(spark, path).count()
    assert found == gone.count() and left < posts.count()
    again = posts.join(gone, "post_id", "left_semi").withColumn(
        "ingested_at", F.expr("timestampadd(DAY, 1, ingested_at)"))
    store.append_posts(again, path)
    seen = store.read_versions(spark, path).count()
    assert seen == left + again.count()
    # The replay of a finished batch does not reach what came after it; a new batch does.
    assert store.delete_posts(spark, path, gone, "deletes-0") == 0
    assert store.read_versions(spark, path).count() == seen
    assert store.delete_posts(spark, path, gone, "deletes-1") == found
    assert store.read_versions(spark, path).count() == left
