"""Named queries over the driver tables. Arrays and times are emitted as text, counts as bigint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import indicators, records, scoring, text, vectors
from postwatch.operators import admission, ingest, ledger, search, stats, versions
from postwatch.plans import fixture
from postwatch.plans.fixture import AS_OF, EVENTS_AS_OF, SETTINGS, table
from postwatch.schema import (
    INDICATOR_FIELDS,
    IOC_COLUMNS,
    IOC_TYPES,
    PageKey,
    SearchSpec,
)
from postwatch.session import fresh_dir
from postwatch.sources import deletes, html, pages, store, synthetic, token_index
from postwatch.streaming import jobs, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANY_TOPIC = "exploit ransomware phishing advisory routine"
PAGE_KEY = PageKey(37, datetime(2026, 1, 20), "500")
SEEN_AS_OF = datetime(2024, 1, 31, 12)
LOW_THRESHOLDS = replace(SETTINGS.thresholds, medium=10, high=20, critical=30)
LOW = replace(SETTINGS, thresholds=LOW_THRESHOLDS)


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def joined(column: str | Column) -> Column:
    return F.coalesce(F.array_join(column, "|"), F.lit(""))


def clock(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def big(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("bigint")


def day() -> Column:
    return F.col("day").cast("string").alias("day")


def plain(df: DataFrame) -> DataFrame:
    """Any result with arrays, times, dates and narrow numbers in their emitted types."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(field.name)
        if kind == "array<string>":
            column = joined(column)
        elif kind.startswith("timestamp"):
            column = clock(column)
        elif kind == "date":
            column = column.cast("string")
        elif kind in ("int", "smallint"):
            column = big(column)
        elif kind == "float":
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def key_and(*columns: Column | str) -> list:
    return ["post_id", day(), *columns]


# --- scans, sources, sinks -----------------------------------------------------------------------


@query("scan_current")
def scan_current(spark, sf):
    fixture.current(spark, sf).createOrReplaceTempView("posts_current")
    return plain(spark.sql(
        "SELECT post_id, day, lang, username, content_version, like_count FROM posts_current"
    ))


@query("dedupe_versions")
def dedupe_versions(spark, sf):
    rows = fixture.current(spark, sf)
    return plain(rows.select(*key_and("content_version", "like_count", "text")))


@query("late_version")
def late_version(spark, sf):
    """Version counts before and after the higher versions arrive, in any order."""
    raw = fixture.versions(spark, sf)
    current = versions.current_posts(raw)
    return current.groupBy("content_version").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("like_count").alias("likes")
    ).select(big("content_version").alias("content_version"), "posts", "likes")


def current_stored(spark, sf) -> DataFrame:
    return versions.current_posts(fixture.posts(spark, sf))


def stored(spark, sf) -> str:
    """A store of its own for a query that changes it."""
    path = fresh_dir(spark, "posts")
    store.append_posts(fixture.all_versions(spark, sf), path)
    return path


@query("insert_roundtrip")
def insert_roundtrip(spark, sf):
    store.register_views(spark, stored(spark, sf))
    rows = spark.table("posts_current")
    return plain(rows.select(*key_and(
        "content_version", "cti_score", "cti_level", "cti_categories", "ioc_domains",
        "cti_semantic_score", "created_at",
    )))


@query("compacted_store")
def compacted_store(spark, sf):
    path = stored(spark, sf)
    days = [row["day"] for row in store.read_versions(spark, path).select("day").distinct()
            .collect()]  # one row per calendar day
    store.compact_days(spark, path, days)
    rows = store.read_versions(spark, path)
    return plain(rows.select(*key_and("content_version", "cti_score")))


@query("apply_deletes")
def apply_deletes(spark, sf):
    path = stored(spark, sf)
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    store.delete_posts(spark, path, toxic.select(F.col("doc_id").cast("string").alias("post_id")))
    rows = store.read_versions(spark, path)
    return plain(rows.select(*key_and("content_version")))


@query("stream_deletes")
def stream_deletes(spark, sf):
    """Posts and delete events in turn: first versions, deletes of even ids, the other versions (which
    are visible again), deletes of odd ids, and those of the first batch once more as a replay."""
    path, lines, offsets = (fresh_dir(spark, name) for name in ("posts", "deletes", "delete-offsets"))
    first = F.col("content_version") == 1
    events = table(spark, sf, "labels").select(
        "doc_id", F.to_json(F.struct(
            F.when(F.col("toxic") == 1, "delete").otherwise("keep").alias("action"),
            F.col("doc_id").cast("string").alias("id"))).alias("value"))
    noise = table(spark, sf, "conversations").select(F.col("text").alias("value"))
    for part, wanted in enumerate((first, ~first)):
        store.append_posts(fixture.enriched(spark, sf, wanted), path)
        events.filter(F.col("doc_id") % 2 == part).select("value").unionAll(noise).write.text(f"{lines}/{part}")
        jobs.delete_stream(spark.readStream.text(f"{lines}/*"), path, offsets)
    again = deletes.delete_events(events.filter(F.col("doc_id") % 2 == 0))
    store.delete_posts(spark, path, again, "deletes-0")
    return plain(store.read_versions(spark, path).select(*key_and("content_version")))


@query("purged_store")
def purged_store(spark, sf):
    """The same deletes, with the days of deleted rows rewritten and read without tombstones."""
    path = stored(spark, sf)
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    store.delete_posts(spark, path, toxic.select(F.col("doc_id").cast("string").alias("post_id")))
    days = [row["day"] for row in store.read_versions(spark, path).select("day").distinct()
            .collect()]  # one row per calendar day
    store.purge_days(spark, path, days)
    rows = spark.read.schema(store.STORED_SCHEMA).parquet(path).filter(F.col("day").isin(days))
    return plain(rows.select(*key_and("content_version")))


@query("synthetic_posts")
def synthetic_posts(spark, sf):
    numbers = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("number")
    )
    rows = synthetic.synthetic_rows(numbers, AS_OF)
    return plain(rows.select(*key_and(
        "author_id", "normalized_text", "lang", "created_at", "username", "like_count",
        "impression_count", "cti_score", "cti_level", "cti_semantic_score", "cti_categories",
        "ioc_ipv4", "ioc_domains", "ioc_urls", "ioc_cves", "ioc_attack_techniques",
        "ioc_threat_actors",
    )))


@query("page_ingest")
def page_ingest(spark, sf):
    payloads = pages.page_posts(fixture.turn_pages(spark, sf))
    rows = ingest.flatten_payloads(payloads, AS_OF)
    return plain(rows.select(
        "post_id", "author_id", "conversation_id", "text", "lang", "username", "display_name",
        "referenced_post_ids", "content_version",
    ))


@query("page_meta")
def page_meta(spark, sf):
    """Where each page's reader goes on, from the page's own cursor data."""
    return pages.page_meta(fixture.turn_pages(spark, sf))


@query("scraped_to_post")
def scraped_to_post(spark, sf):
    payloads = pages.scraped_payloads(fixture.scraped_rows(spark, sf))
    rows = ingest.flatten_payloads(payloads, AS_OF)
    return plain(rows.select(
        "post_id", "text", "lang", "created_at", "username", "display_name", "author_verified",
        "reply_count", "repost_count", "quote_count", "like_count", "impression_count",
        "urls", "hashtags", "mentions", "referenced_post_ids",
    ))


@query("html_to_raw")
def html_to_raw(spark, sf):
    raw = html.html_to_raw(fixture.dealt(table(spark, sf, "pages")), markup=html.WEB_PAGE)
    links = F.transform("urls", lambda item: item["url"])
    return raw.select("page_id", "lang", F.trim("text").alias("text"), joined(links).alias("links"))


@query("html_timeline")
def html_timeline(spark, sf):
    raw = html.html_to_raw(fixture.timeline_pages(spark, sf), page_id="doc_id")
    return plain(raw.withColumn("urls", F.transform("urls", lambda item: item["expanded_url"])))


@query("delete_events")
def delete_events(spark, sf):
    """Delete events among lines that are no events or no JSON at all."""
    action = F.when(F.col("toxic") == 1, "delete").otherwise("keep")
    events = table(spark, sf, "labels").select(
        F.to_json(F.struct(action.alias("action"), F.col("doc_id").cast("string").alias("id")))
        .alias("value")
    )
    noise = table(spark, sf, "conversations").select(F.col("text").alias("value"))
    other = table(spark, sf, "events").select(F.col("props").alias("value"))
    return deletes.delete_events(events.unionByName(noise).unionByName(other))


@query("id_export")
def id_export(spark, sf):
    path = fresh_dir(spark, "ids")
    deletes.export_ids(fixture.posts(spark, sf), path, versioned=True)
    return spark.read.text(path).withColumnRenamed("value", "post_id")


@query("queue_batch")
def queue_batch(spark, sf):
    batch = ledger.queue_batch(fixture.event_queue(spark, sf), EVENTS_AS_OF, SETTINGS.queue_batch)
    return plain(batch.select("id", "source_id", "payload", "available_at"))


@query("queue_stats")
def queue_stats(spark, sf):
    return ledger.queue_stats(fixture.event_queue(spark, sf))


@query("queue_retry")
def queue_retry(spark, sf):
    """Failed rows wait thirty seconds, acknowledged rows leave; the rest stays as it was."""
    queue = fixture.event_queue(spark, sf)
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    failed = kinds.filter(F.col("event_type") == "error")
    done = kinds.filter(F.col("event_type") == "click")
    left = ledger.acknowledge(
        ledger.retry(queue, failed, EVENTS_AS_OF, SETTINGS.retry_delay_seconds), done
    )
    return plain(left.select("id", "attempts", "available_at"))


@query("enqueue_unique")
def enqueue_unique(spark, sf):
    """Arrivals after a moment, without ids that were queued before it."""
    queue = fixture.event_queue(spark, sf)
    early = queue.filter(F.col("available_at") < records.ntz(datetime(2024, 1, 2)))
    late = queue.filter(F.col("available_at") >= records.ntz(datetime(2024, 1, 2)))
    return plain(ledger.enqueue(early, late, "id").select("source_id", "id"))


@query("audit_append")
def audit_append(spark, sf):
    reads = fixture.event_reads(spark, sf)
    cycles = reads.groupBy("event_type", "day").agg(
        F.count(F.lit(1)).alias("fetched"), F.countDistinct("user_id").alias("enqueued")
    )
    rows = ledger.audit_rows(
        cycles, F.concat(F.lit("collector_"), "event_type"), ["fetched", "enqueued"],
        F.col("day").cast("string"),
    )
    path = fresh_dir(spark, "audit")
    store.append_audit(rows, path)
    return spark.read.schema("event_type string, detail string, created_at string").json(path)


@query("kv_latest")
def kv_latest(spark, sf):
    return ledger.kv_latest(
        fixture.event_reads(spark, sf), "user_id", "props", ["ts", "event_id"]
    )


# --- projections ---------------------------------------------------------------------------------


@query("recent_posts")
def recent_posts(spark, sf):
    return plain(search.recent(fixture.posts(spark, sf), versioned=True))


@query("result_shape")
def result_shape(spark, sf):
    rows = search.shape_results(current_stored(spark, sf))
    return plain(rows.select(
        "post_id", "created_at", "cti_score", "scoring_mode", "model_revision", "source_url",
        F.col("indicators.domains").alias("domains"), F.col("indicators.cves").alias("cves"),
        F.col("metrics")["likes"].alias("likes"),
        F.col("metrics")["impressions"].alias("impressions"),
        F.size("highlights").alias("highlight_count"),
    ))


@query("flatten_record")
def flatten_record(spark, sf):
    enriched = ingest.enrich(fixture.current(spark, sf), SETTINGS)
    flat = ingest.flatten_assessment(ingest.nest_assessment(enriched))
    return plain(flat.select(*key_and(
        "cti_score", "cti_level", "cti_rule_score", "cti_semantic_score", "cti_scoring_mode",
        "cti_reasons", "model_revision", "ioc_md5", "ioc_filenames",
    )))


@query("indicator_preview")
def indicator_preview(spark, sf):
    rows = current_stored(spark, sf).select(
        "*", indicators.indicator_preview().alias("preview"),
        indicators.indicator_preview(4).alias("compact"),
    )
    return plain(rows.select(*key_and("preview", "compact")))


@query("indicator_total")
def indicator_total(spark, sf):
    rows = current_stored(spark, sf).withColumn("total", indicators.indicator_total())
    return plain(rows.select(*key_and("total")))


# --- search --------------------------------------------------------------------------------------

RESULT = ("post_id", "created_at", "cti_score", "username", "lang")


def matches(spec: SearchSpec) -> Query:
    def run(spark, sf):
        rows = search.matching(fixture.posts(spark, sf), spec, versioned=True, columns=RESULT)
        return plain(rows)

    return run


def page(spec: SearchSpec) -> Query:
    def run(spark, sf):
        rows = search.search_rows(fixture.posts(spark, sf), spec, versioned=True, columns=RESULT)
        return plain(rows)

    return run


MATCH_SPECS = {
    "search_all": SearchSpec("cve-2031-10001 exploit"),
    "search_any": SearchSpec("meetup phishing", mode="any"),
    "search_phrase": SearchSpec("Sunny day at", mode="phrase"),
    "filter_dates": SearchSpec(ANY_TOPIC, "any", date_from=datetime(2026, 1, 5, 6),
                               date_to=datetime(2026, 1, 12, 23, 59, 59)),
    "filter_lang": SearchSpec(ANY_TOPIC, "any", lang="de"),
    "filter_min_score": SearchSpec(ANY_TOPIC, "any", min_score=30),
    "filter_level": SearchSpec(ANY_TOPIC, "any", level="medium"),
    "filter_category": SearchSpec(ANY_TOPIC, "any", category="phishing"),
    "filter_author": SearchSpec(ANY_TOPIC, "any", author="@USER_src3"),
    **{f"filter_ioc_{kind}": SearchSpec(ANY_TOPIC, "any", ioc_type=kind) for kind in IOC_TYPES},
}
PAGE_SPECS = {
    "search_newest": SearchSpec(ANY_TOPIC, "any", "newest", 50),
    "search_relevance": SearchSpec(ANY_TOPIC, "any", "relevance", 50),
    "search_page1": SearchSpec(ANY_TOPIC, "any", "cti", 100),
    "search_page2_score": SearchSpec(ANY_TOPIC, "any", "cti", 50, after=PAGE_KEY),
    "search_page2_newest": SearchSpec(ANY_TOPIC, "any", "newest", 50, after=PAGE_KEY),
}
QUERIES.update({name: matches(spec) for name, spec in MATCH_SPECS.items()})
QUERIES.update({name: page(spec) for name, spec in PAGE_SPECS.items()})


@query("search_current")
def search_current(spark, sf):
    """Same answer as ``search_any`` by comparing all versions first."""
    rows = search.matching(current_stored(spark, sf), MATCH_SPECS["search_any"], columns=RESULT)
    return plain(rows)


@query("search_walk")
def search_walk(spark, sf):
    """Three pages in a row, each starting after the last key of the one before, with highlights."""
    rows, after, number = fixture.posts(spark, sf), None, 0
    found = []
    while number < 3 and (number == 0 or after is not None):
        page_ = search.search(rows, replace(MATCH_SPECS["search_any"], limit=7, after=after), True)
        found += [(number, place, row["post_id"], row["cti_score"], len(row["highlights"]) > 0)
                  for place, row in enumerate(page_.rows)]
        after, number = page_.next_key, number + 1
    return spark.createDataFrame(
        found, "page bigint, place bigint, post_id string, cti_score int, marked boolean"
    ).withColumn("cti_score", big("cti_score"))


def indexed(spec: SearchSpec) -> Query:
    """Same answers as the plain search, through the token index."""

    def run(spark, sf):
        index = token_index.read_index(spark, fixture.index_path(spark, sf))
        rows = token_index.restrict(fixture.posts(spark, sf), index, spec)
        found = search.matching(rows, spec, versioned=True, columns=RESULT)
        return plain(found)

    return run


QUERIES.update({
    f"indexed_{mode}": indexed(MATCH_SPECS[f"search_{mode}"]) for mode in ("all", "any", "phrase")
})


@query("get_post")
def get_post(spark, sf):
    """The newest version of the post that was created last."""
    posts = fixture.posts(spark, sf)
    newest = posts.agg(F.max_by("post_id", F.struct("created_at", "post_id"))).collect()[0][0]
    rows = search.get_post(posts, newest)
    return plain(rows.select("post_id", "created_at", "cti_score", "text"))


@query("top_scored")
def top_scored(spark, sf):
    rows = search.top_scored(fixture.posts(spark, sf), settings=LOW, versioned=True)
    return plain(rows.select(*RESULT))


# --- rejects and lookups -------------------------------------------------------------------------


@query("reject_protected")
def reject_protected(spark, sf):
    _, rejected = ingest.split_rejects(fixture.payloads(spark, sf))
    kept = rejected.filter(F.col("reason") == "protected_author")
    return kept.select(F.col("post.conversation_id").alias("conversation_id"), "reason")


@query("reject_incomplete")
def reject_incomplete(spark, sf):
    _, rejected = ingest.split_rejects(fixture.payloads(spark, sf))
    kept = rejected.filter(F.col("reason").isin("missing_id", "missing_text"))
    return kept.select(F.col("post.conversation_id").alias("conversation_id"), "reason")


@query("quarantine")
def quarantine(spark, sf):
    """Accepted and rejected payloads by reason."""
    accepted, rejected = ingest.split_rejects(fixture.payloads(spark, sf))
    reasons = accepted.select(F.lit("accepted").alias("reason")).unionByName(
        rejected.select("reason")
    )
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("payloads"))


@query("page_authors")
def page_authors(spark, sf):
    """Authors of all pages, as the last page that names them has them."""
    sequence = (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq")
    named = F.concat(F.lit("page "), sequence.cast("string"))
    documents = fixture.turn_pages(spark, sf).select(
        sequence, F.replace("value", F.lit('"name":"User"'), F.concat(
            F.lit('"name":"'), named, F.lit('"'))).alias("value")
    )
    latest = ingest.latest_authors(pages.page_authors(documents, "seq"))
    return latest.select("id", "username", "name")


def supplier_authors(spark, sf) -> DataFrame:
    """Suppliers of a nation as versions of one author, ordered by their number."""
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("id"), F.col("s_name").alias("username"),
        F.round("s_acctbal", 2).alias("balance"), F.col("s_suppkey").alias("page_seq"),
    )


@query("author_latest")
def author_latest(spark, sf):
    return ingest.latest_authors(supplier_authors(spark, sf))


@query("author_join")
def author_join(spark, sf):
    """Customers as posts: the author by own key where a supplier has it, else by nation."""
    posts = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("post_id"),
        F.col("c_nationkey").cast("string").alias("author_id"),
    )
    by_post = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("username"),
        F.round("s_acctbal", 2).alias("balance"),
    )
    found = ingest.join_authors(posts, ingest.latest_authors(supplier_authors(spark, sf)), by_post)
    return found.select("post_id", "author_id", "author.username", "author.balance")


@query("expand_referenced")
def expand_referenced(spark, sf):
    """Turns quote the two turns before them and reply to the first of the conversation."""
    turns = table(spark, sf, "conversations")

    def name(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    posts = turns.select(name(F.col("turn")).alias("post_id"), "text")
    relation = F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("replied_to").alias("type"),
                 name(F.lit(0)).alias("id")),
        F.struct(F.lit(1).alias("pos"), F.lit("quoted").alias("type"),
                 name(F.col("turn") - 1).alias("id")),
        F.struct(F.lit(2).alias("pos"), F.lit("retweeted").alias("type"),
                 name(F.col("turn") - 2).alias("id")),
    )).alias("relation")
    relations = turns.select(name(F.col("turn")).alias("post_id"), relation).select(
        "post_id", "relation.*"
    )
    references = posts.select(F.col("post_id").alias("id"), "text")
    return ingest.expand_referenced(posts, relations, references)


@query("unseen_anti_join")
def unseen_anti_join(spark, sf):
    candidates = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"), "lang"
    )
    seen = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    return ledger.unseen(candidates, seen)


@query("trusted_flag")
def trusted_flag(spark, sf):
    handles = table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_id"), F.concat(F.lit("@@User_"), "source").alias("username")
    )
    return ingest.trusted_flag(handles, SETTINGS)


# --- statistics ----------------------------------------------------------------------------------


@query("stats_overview")
def stats_overview(spark, sf):
    return plain(stats.overview_counts(fixture.posts(spark, sf), LOW, versioned=True))


@query("overview_settled")
def overview_settled(spark, sf):
    """The same row from a store of which the days of one half of the calendar are compacted."""
    path = stored(spark, sf)
    days = sorted(row["day"] for row in store.read_versions(spark, path).select("day").distinct()
                  .collect())  # one row per calendar day
    store.compact_days(spark, path, days[::2])
    settled = store.settled_days(spark, path)
    parts = stats.overview(store.read_versions(spark, path), AS_OF, LOW, versioned=settled)
    return plain(parts["summary"].withColumn("settled", F.lit(settled.days == tuple(days[::2]))))


@query("overview")
def overview(spark, sf):
    """Counts and indicator totals of the dashboard in one pass."""
    parts = stats.overview(fixture.posts(spark, sf), AS_OF, LOW, versioned=True)
    return plain(parts["summary"])


@query("stats_timeline")
def stats_timeline(spark, sf):
    return stats.timeline(fixture.posts(spark, sf), AS_OF, versioned=True)


@query("stats_categories")
def stats_categories(spark, sf):
    return stats.category_counts(fixture.posts(spark, sf), AS_OF, versioned=True)


@query("stats_iocs")
def stats_iocs(spark, sf):
    return stats.indicator_totals(fixture.posts(spark, sf), versioned=True)


@query("daily_levels_raw")
def daily_levels_raw(spark, sf):
    return plain(stats.daily_levels(fixture.posts(spark, sf)))


@query("daily_levels_current")
def daily_levels_current(spark, sf):
    return plain(stats.daily_levels(fixture.posts(spark, sf), versioned=True))


@query("distinct_ids")
def distinct_ids(spark, sf):
    return stats.distinct_live_ids(fixture.posts(spark, sf), versioned=True)


@query("chart_share")
def chart_share(spark, sf):
    days = stats.timeline(fixture.posts(spark, sf), AS_OF, versioned=True)
    shares = stats.chart_share(days, floor=stats.TIMELINE_FLOOR)
    return shares.select("day", "posts", F.round("share", 6).alias("share"))


@query("daily_usage")
def daily_usage(spark, sf):
    reads = fixture.event_reads(spark, sf)
    return plain(ledger.daily_usage(reads, F.col("day"), F.lit(1)))


@query("usage_today")
def usage_today(spark, sf):
    usage = ledger.daily_usage(fixture.event_reads(spark, sf), F.col("day"), F.lit(1))
    return ledger.usage_on(usage, "2024-01-15")


@query("cycle_metrics")
def cycle_metrics(spark, sf):
    reads = fixture.event_reads(spark, sf)
    return plain(ledger.cycle_metrics(reads, ["day", "hour"], "day", "user_id", "event_id"))


@query("ingest_status")
def ingest_status(spark, sf):
    usage = ledger.daily_usage(fixture.event_reads(spark, sf), F.col("day"), F.lit(1))
    state = ledger.kv_latest(
        fixture.event_state(spark, sf), order=["updated_at", "event_id"]
    )
    ledgers = ledger.Ledgers(fixture.event_queue(spark, sf), usage, state)
    return plain(ledger.ingest_status(ledgers, EVENTS_AS_OF, SETTINGS))


@query("budget_cap")
def budget_cap(spark, sf):
    kept = ledger.budget_cap(fixture.event_reads(spark, sf), 100, order=("ts", "event_id"))
    return plain(kept.select("event_id", "day"))


@query("budget_cap_default")
def budget_cap_default(spark, sf):
    """The default budget, applied to all events as if they were read on one day."""
    reads = fixture.event_reads(spark, sf).withColumn("day", F.lit("2024").cast("string"))
    kept = ledger.budget_cap(reads, SETTINGS.daily_read_budget, order=("ts", "event_id"))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.max("event_id").alias("last"),
                    F.sum("event_id").alias("ids"))


@query("keep_last_per_id")
def keep_last_per_id(spark, sf):
    sightings = table(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    return ledger.keep_last_per_id(sightings, 100, "user_id", "event_id")


# --- text ----------------------------------------------------------------------------------------


@query("normalize")
def normalize(spark, sf):
    return fixture.documents(spark, sf).select(
        "doc_id", text.normalize_text(F.col("text")).alias("normalized")
    )


@query("refang")
def refang(spark, sf):
    rows = fixture.current(spark, sf)
    return rows.select(*key_and(text.refang_text(F.col("text")).alias("prepared")))


@query("query_terms")
def query_terms(spark, sf):
    return plain(table(spark, sf, "conversations").select(
        "conv_id", "turn", text.query_terms(F.col("text")).alias("terms")
    ))


@query("tokenize")
def tokenize(spark, sf):
    """Count and first position of every token over all documents."""
    tokens = fixture.documents(spark, sf).select(
        "doc_id", F.explode(text.tokenize(text.normalize_text(F.col("text")))).alias("token")
    )
    return tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_doc")
    )


def spans_text(spans: Column) -> Column:
    return joined(F.transform(spans, lambda span: F.concat_ws(
        "-", span["start"].cast("string"), span["end"].cast("string"))))


@query("highlights")
def highlights(spark, sf):
    rows = fixture.documents(spark, sf).select(
        "doc_id", text.highlight_offsets(F.col("text"), "the rt").alias("spans")
    )
    return rows.select("doc_id", spans_text(F.col("spans")).alias("spans"))


@query("merge_highlights")
def merge_highlights(spark, sf):
    """Ranges of two terms that overlap inside words, merged per document."""
    rows = fixture.documents(spark, sf).select(
        "doc_id", text.highlight_offsets(F.col("text"), "the he").alias("spans")
    )
    return rows.select("doc_id", spans_text(text.merge_highlights(F.col("spans"))).alias("merged"))


# --- indicators ----------------------------------------------------------------------------------


def listing(*columns: str) -> Query:
    """Chosen indicator lists of the current posts; Spark computes no others."""

    def run(spark, sf):
        rows = indicators.with_indicators(fixture.current(spark, sf))
        return plain(rows.select(*key_and(*columns)))

    return run


QUERIES.update({
    "ioc_urls": listing("ioc_urls"),
    "ioc_emails": listing("ioc_emails"),
    "ioc_ipv4": listing("ioc_ipv4"),
    "ioc_ipv6": listing("ioc_ipv6"),
    "ioc_domains": listing("ioc_domains"),
    "ioc_hashes": listing("ioc_md5", "ioc_sha1", "ioc_sha256", "ioc_sha512"),
    "ioc_cves": listing("ioc_cves"),
    "ioc_attack": listing("ioc_attack_techniques"),
    "ioc_filenames": listing("ioc_filenames"),
    "ioc_hashtags": listing("ioc_hashtags"),
    "ioc_actors": listing("ioc_threat_actors"),
})


@query("extract_indicators")
def extract_indicators(spark, sf):
    rows = indicators.with_indicators(fixture.current(spark, sf)).withColumn(
        "found", indicators.indicator_struct()
    )
    return plain(rows.select(*key_and(*[
        F.col(f"found.{name}").alias(f"ioc_{name}") for name in INDICATOR_FIELDS
    ])))


# --- scoring -------------------------------------------------------------------------------------


def rule_part(column: str, name: str) -> Query:
    def run(spark, sf):
        rows = indicators.with_indicators(fixture.current(spark, sf)).withColumn(
            "normalized_text", text.normalize_text(F.col("text"))
        )
        parts = scoring.with_rule_parts(rows, SETTINGS).withColumn("_rule", scoring.rule_score())
        return plain(parts.select(*key_and(F.col(column).alias(name))))

    return run


QUERIES.update({
    "score_indicators": rule_part("_indicator_score", "indicator_score"),
    "score_cve": rule_part("_reference_score", "reference_score"),
    "score_context": rule_part("_context_score", "context_score"),
    "score_trust": rule_part("_trust_score", "trust_score"),
    "score_engagement": rule_part("_engagement_score", "engagement_score"),
    "score_rules": rule_part("_rule", "rule_score"),
})


def prototypes(spark, sf) -> vectors.Prototypes:
    """One prototype per label: its vector with the lowest number."""
    chosen = table(spark, sf, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("vector")
    )
    name = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return vectors.Prototypes.read(chosen.select(name.alias("category"), "vector"))


def hybrid_posts(spark, sf) -> DataFrame:
    """Current posts, scored with their vector where there is one and by rules elsewhere."""
    stored_vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"), "embedding"
    )
    rows = fixture.current(spark, sf).join(stored_vectors, "post_id", "left")
    scorer = vectors.VectorScorer(prototypes(spark, sf), "vectors-1")
    return ingest.enrich(rows, SETTINGS, scorer)


@query("score_hybrid")
def score_hybrid(spark, sf):
    return plain(hybrid_posts(spark, sf).select(*key_and(
        "cti_rule_score", "cti_score", "cti_scoring_mode", "model_revision",
        F.round("cti_semantic_score", 2).alias("semantic"),
    )))


@query("score_level")
def score_level(spark, sf):
    return plain(hybrid_posts(spark, sf).select(*key_and("cti_score", "cti_level")))


@query("score_reasons")
def score_reasons(spark, sf):
    return plain(hybrid_posts(spark, sf).select(*key_and("cti_reasons")))


@query("score_categories")
def score_categories(spark, sf):
    return plain(hybrid_posts(spark, sf).select(*key_and("cti_categories")))


@query("assess_posts")
def assess_posts(spark, sf):
    return plain(hybrid_posts(spark, sf).select(*key_and(
        "cti_score", "cti_level", "cti_rule_score", "cti_scoring_mode", "cti_categories",
        "cti_reasons", "scorer_version", *IOC_COLUMNS,
    )))


# --- raw records ---------------------------------------------------------------------------------


@query("parse_metric")
def parse_metric(spark, sf):
    """Labels from order lines: with thousands commas, decimals, suffixes and plain words."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    label = (
        F.when(F.col("l_returnflag") == "A", F.concat(quantity, F.lit(",250 Replies")))
        .when(F.col("l_returnflag") == "R", F.concat(price, F.lit("K Reposts")))
        .when(F.col("l_linestatus") == "O", F.concat(quantity, F.lit(" Bookmarks")))
        .otherwise(F.concat(quantity, F.lit(" m views")))
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))
    parsed = rows.withColumn("value", records.parse_metric(F.col("label")))
    return plain(parsed)


@query("extract_post_id")
def extract_post_id(spark, sf):
    number = F.col("doc_id").cast("string")
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(F.lit(" "), number, F.lit(" ")))
        .when(F.col("lang") == "fr", F.concat(F.lit("x"), number)).otherwise("").alias("raw"),
        F.when(F.col("lang") == "es", "/home").otherwise(
            F.concat(F.lit("/"), "source", F.lit("/status/7"), number, F.lit("/photo/1"))
        ).alias("link"),
    )
    return rows.select(
        "doc_id", records.extract_post_id(F.col("raw"), F.col("link")).alias("post_id")
    )


@query("flatten_entities")
def flatten_entities(spark, sf):
    accepted, _ = ingest.split_rejects(fixture.payloads(spark, sf))
    rows = ingest.flatten_payloads(accepted, AS_OF)
    return plain(rows.select(
        "post_id", "urls", "hashtags", "mentions", "referenced_post_ids", "like_count",
        "reply_count", "impression_count",
    ))


@query("parse_ts")
def parse_ts(spark, sf):
    """Zoned, offset, naive and unreadable spellings of event times."""
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    spelled = (
        F.when(F.col("event_type") == "click", F.concat(stamp, F.lit("Z")))
        .when(F.col("event_type") == "view", F.concat(stamp, F.lit("+02:00")))
        .when(F.col("event_type") == "error", F.lit("no time"))
        .otherwise(stamp)
    )
    rows = table(spark, sf, "events").select("event_id", spelled.alias("raw"))
    return plain(rows.select("event_id", records.parse_utc(F.col("raw")).alias("at")))


@query("staleness")
def staleness(spark, sf):
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_type") == "error", "").otherwise(stamp)
    as_of = records.ntz(EVENTS_AS_OF)
    return table(spark, sf, "events").select(
        "event_id",
        records.is_stale(raw, as_of, SETTINGS.stale_hours).alias("stale"),
        records.is_stale(raw, as_of, SETTINGS.due_hours).alias("due"),
    )


PREPARED = (
    "source_type", "post_id", "author_id", "text", "lang", "created_at", "ingested_at",
    "username", "display_name", "like_count", "urls", "hashtags", "mentions",
    "referenced_post_ids", "content_version", "cti_score", "cti_level", "cti_categories",
    "ioc_domains", "ioc_ipv4", "model_revision", "day",
)


@query("prepare_posts")
def prepare_posts(spark, sf):
    rows = ingest.prepare_posts(fixture.payloads(spark, sf), AS_OF, SETTINGS)
    return plain(rows.select(*PREPARED))


# --- vectors -------------------------------------------------------------------------------------


@query("cosine")
def cosine(spark, sf):
    """Cosine of every vector with its label's prototype."""
    chosen = prototypes(spark, sf)
    known = dict(zip(chosen.categories, chosen.vectors, strict=True))
    rows = table(spark, sf, "embeddings")
    own = F.create_map(*[
        item for name, vector in known.items()
        for item in (F.lit(name), F.lit(list(vector)))
    ])
    name = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return rows.select(
        "vec_id",
        F.round(vectors.cosine(F.col("embedding"), own[name]), 6).alias("cosine"),
    )


@query("semantic_score")
def semantic_score(spark, sf):
    scorer = vectors.VectorScorer(prototypes(spark, sf), "vectors-1")
    return scorer(table(spark, sf, "embeddings")).select("vec_id", "semantic_score")


@query("semantic_match")
def semantic_match(spark, sf):
    scorer = vectors.VectorScorer(prototypes(spark, sf), "vectors-1")
    rows = scorer(table(spark, sf, "embeddings"))
    return plain(rows.select("vec_id", F.col("semantic_categories").alias("categories")))


@query("mean_pool")
def mean_pool(spark, sf):
    """Masked mean per label, one row per dimension."""
    rows = table(spark, sf, "embeddings").withColumn(
        "mask", (F.element_at("embedding", 1) > 0).cast("int")
    )
    pooled = vectors.mean_pool(rows, ["label"], "embedding", "mask", 64)
    parts = pooled.select("label", F.posexplode("vector").alias("dim", "value"))
    return parts.select(
        big("label").alias("label"), big("dim").alias("dim"), F.round("value", 6).alias("value")
    )


# --- incremental and streaming -------------------------------------------------------------------


@query("seen_retention")
def seen_retention(spark, sf):
    sightings = table(spark, sf, "events").select(
        F.col("user_id").alias("post_id"), F.col("ts").cast("timestamp_ntz").alias("seen_at")
    )
    early = F.col("seen_at") < records.ntz(datetime(2024, 1, 2))
    seen = ledger.mark_seen(sightings.filter(early), sightings.filter(~early))
    kept = ledger.prune_seen(seen, SEEN_AS_OF, SETTINGS.seen_retention_days)
    return plain(kept)


@query("since_id")
def since_id(spark, sf):
    """Per event type: the mark at a moment, how much came after it, and the mark then."""
    events = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp_ntz")
    marks = events.filter(at < records.ntz(EVENTS_AS_OF)).groupBy("event_type").agg(
        F.max("event_id").alias("mark")
    )
    fetched = ledger.new_since(events, marks, "event_type", "event_id")
    counts = fetched.groupBy("event_type").agg(F.count(F.lit(1)).alias("fetched"))
    return ledger.advance_marks(marks, fetched, "event_type", "event_id").join(
        counts, "event_type", "left"
    )


AUTHOR_WAIT_SECONDS = 1_000_000
ADMISSION_LIMIT, ADMISSION_SECONDS, IDLE_SECONDS = 2, 86_400, 21_600


@query("admission")
def admission_batch(spark, sf):
    return admission.admit(
        fixture.event_reads(spark, sf), "user_id", "ts", "event_id", ADMISSION_LIMIT,
        ADMISSION_SECONDS,
    )


def state_tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


@query("stream_admission")
def stream_admission(spark, sf):
    events = fixture.stream(spark, sf, "events").withColumn(
        "at", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    stream = jobs.admission_stream(
        events, "user_id", "at", "event_id", ADMISSION_LIMIT, ADMISSION_SECONDS
    )
    with keyed.keyed_state(spark, state_tasks(spark)):
        return jobs.collect_stream(stream, "admission")


@query("stream_admission_idle")
def stream_admission_idle(spark, sf):
    """The same over several batches; a user who was silent for some hours starts afresh."""
    out, offsets = fresh_dir(spark, "admission"), fresh_dir(spark, "admission-offsets")

    def start(events):
        timed = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
        keyed.append_stream(jobs.admission_stream(
            timed, "user_id", "at", "event_id", ADMISSION_LIMIT, ADMISSION_SECONDS, IDLE_SECONDS,
        ), out, offsets, state_tasks(spark))

    fixture.run_landings(spark, fixture.event_batches(spark, sf, latest_first=False), start)
    return spark.read.parquet(out)


@query("stream_enrich")
def stream_enrich(spark, sf):
    arrived = fixture.stream(spark, sf, "documents")
    lines = fixture.payload_lines(arrived, table(spark, sf, "labels"))
    posts, rejects, offsets = (
        fresh_dir(spark, name) for name in ("stream-posts", "stream-rejects", "stream-offsets")
    )
    jobs.enrich_stream(
        jobs.payload_stream(lines), posts, rejects, offsets, AS_OF, SETTINGS,
        tasks=spark.sparkContext.defaultParallelism,
    )
    return plain(store.read_current(spark, posts).select(*PREPARED))


def arrivals(events: DataFrame, source: str) -> DataFrame:
    return queue_changes(events, source, keyed.ARRIVED, F.col("ts"))


def queue_changes(events: DataFrame, source: str, kind: int, at: Column) -> DataFrame:
    return events.select(
        F.col(source).cast("string").alias("source_id"), F.col("event_id").alias("id"),
        F.lit(kind).alias("kind"), at.cast("timestamp").alias("at"), F.col("event_id").alias("place"))


def queued_batches(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    out, offsets = fresh_dir(spark, "stream-queue"), fresh_dir(spark, "stream-queue-offsets")
    fixture.run_landings(spark, batches, lambda changes: jobs.queue_stream(
        changes, out, offsets, SETTINGS.retry_delay_seconds, state_tasks(spark)))
    return spark.read.parquet(out)


@query("stream_dedupe")
def stream_dedupe(spark, sf):
    """Each source id is queued once: with the first arrival of the first batch that has it."""
    batches = [arrivals(batch, "user_id") for batch in fixture.event_batches(spark, sf)]
    return queued_batches(spark, batches).select("source_id", "id")


@query("cycle_observed")
def cycle_observed(spark, sf):
    """An audit entry per collector cycle, from what the queue stream counted while it ran; days with
    reads are counted while the entry of the last cycle is made."""
    out, offsets = fresh_dir(spark, "stream-queue"), fresh_dir(spark, "stream-queue-offsets")
    audit = fresh_dir(spark, "audit")
    cycles = []

    def start(changes):
        counts = jobs.queue_stream(changes, out, offsets, SETTINGS.retry_delay_seconds, state_tasks(spark))
        cycles.append({name: counts[name] for name in ("fetched", "enqueued")})

    fixture.run_landings(
        spark, [arrivals(batch, "user_id") for batch in fixture.event_batches(spark, sf)], start)
    for number, counts in enumerate(cycles):
        store.append_audit(ledger.observed_audit(spark, "collector_cycle", counts, str(number)), audit)
    reads, seen = ledger.counting(fixture.event_reads(spark, sf), "reads", reads=F.count(F.lit(1)))
    days = ledger.daily_usage(reads, F.col("day"), F.lit(1)).count()
    store.append_audit(ledger.observed_audit(
        spark, "collector_total", {"reads": seen.get["reads"], "days": days}, str(len(cycles))), audit)
    return spark.read.schema("event_type string, detail string, created_at string").json(audit)


@query("stream_requeue")
def stream_requeue(spark, sf):
    """Purchases are acknowledged with the next batch, so their users are queued again."""
    events = fixture.event_batches(spark, sf)
    batches = [arrivals(batch, "user_id") for batch in events]
    for number, batch in enumerate(events[:-1]):
        done = batch.filter(F.col("event_type") == "purchase")
        batches[number + 1] = batches[number + 1].unionAll(
            queue_changes(done, "user_id", keyed.DONE, F.col("ts")))
    return queued_batches(spark, batches).select("source_id", "id")


@query("stream_retry")
def stream_retry(spark, sf):
    """Errors fail a minute after they came, which is heard of with the next batch; purchases are
    done. Failed rows come back after the delay."""
    events = fixture.event_batches(spark, sf, latest_first=False)
    batches = [arrivals(batch, "event_id") for batch in events]
    batches.append(batches[0].limit(0))
    for number, batch in enumerate(events):
        failed = queue_changes(batch.filter(F.col("event_type") == "error"), "event_id", keyed.FAILED,
                               F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
        done = queue_changes(batch.filter(F.col("event_type") == "purchase"), "event_id", keyed.DONE,
                             F.col("ts"))
        batches[number + 1] = batches[number + 1].unionAll(failed).unionAll(done)
    rows = queued_batches(spark, batches)
    return plain(rows.withColumns({
        "attempts": F.col("attempts").cast("bigint"),
        "available_at": records.utc_wall_clock(F.col("available_at"))}))


@query("stream_seen")
def stream_seen(spark, sf):
    """Sightings in several batches, of which the later ones are older."""
    batches = [batch.select(F.col("user_id").alias("post_id"), F.col("ts").cast("timestamp").alias("seen_at"))
               for batch in fixture.event_batches(spark, sf)]
    out, offsets = fresh_dir(spark, "stream-seen"), fresh_dir(spark, "stream-seen-offsets")
    fixture.run_landings(spark, batches, lambda sightings: jobs.seen_stream(
        sightings, out, offsets, SETTINGS.seen_retention_days, state_tasks(spark)))
    return plain(jobs.read_seen(spark, out).withColumn("seen_at", records.utc_wall_clock(F.col("seen_at"))))


def signed_posts(spark, sf, deleted: bool) -> DataFrame:
    """Signed counts of the stored posts: second and third versions first, then the first versions and
    some second ones again, at last the deletes."""
    posts = fixture.posts(spark, sf)
    later, edited = F.col("content_version") > 1, F.col("content_version") == 2
    batches = [keyed.post_changes(part, stats.measures(LOW)) for part in (
        posts.filter(later & (F.col("cti_score") % 2 == 0)), posts.filter(~later | edited),
        posts.filter(later))]
    if deleted:
        toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
        batches.append(keyed.post_deletes(toxic.select(F.col("doc_id").cast("string").alias("post_id"))))
    out, offsets = fresh_dir(spark, "stream-current"), fresh_dir(spark, "stream-current-offsets")
    fixture.run_landings(spark, batches, lambda changes: jobs.current_stream(
        changes, out, offsets, state_tasks(spark)))
    return spark.read.parquet(out)


@query("stream_daily_current")
def stream_daily_current(spark, sf):
    """Current posts per day and level, kept as a stream of signed counts."""
    return plain(keyed.current_levels(signed_posts(spark, sf, False)))


@query("overview_incremental")
def overview_incremental(spark, sf):
    """The overview after inserts, replacements and deletes, from day summaries alone."""
    days = keyed.day_summaries(signed_posts(spark, sf, True))
    return plain(stats.overview_of_days(days))


@query("stream_authors")
def stream_authors(spark, sf):
    """The join of ``author_join`` over two streams: posts land before, between and after their authors'
    records, of which the newest land first."""
    posts = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("author_id"),
        F.to_json(F.struct(F.col("c_custkey").cast("string").alias("post_id"))).alias("post"),
        F.timestamp_seconds(F.col("c_custkey")).alias("at"))
    authors = supplier_authors(spark, sf).select(
        F.col("id").alias("author_id"), F.col("page_seq").alias("seq"),
        F.to_json(F.struct("username", "balance")).alias("record"), F.timestamp_seconds("page_seq").alias("at"))
    half = F.crc32(F.col("post").cast("binary")) % 2 == 0
    newer = F.col("seq") % 3 == 2
    # At the end a time beyond all others lets the last posts go.
    ends = [rows.limit(1).withColumns({"author_id": F.lit(None).cast("string"), name: F.lit(None).cast(kind),
                                       "at": F.timestamp_seconds(F.lit(4_000_000_000))})
            for rows, name, kind in ((posts, "post", "string"), (authors, "seq", "long"))]
    landings = ([posts.filter(half), posts.filter(~half), ends[0]],
                [authors.filter(newer), authors.filter(~newer), ends[1]])
    left, right, out, offsets = (
        fresh_dir(spark, name) for name in ("post-landing", "author-landing", "authors", "author-offsets"))
    for number, (some, others) in enumerate(zip(*landings, strict=True)):
        some.write.parquet(f"{left}/{number}")
        others.write.parquet(f"{right}/{number}")
        joined_rows = keyed.with_latest_authors(
            jobs.landing_stream(spark, f"{left}/*", posts.schema),
            jobs.landing_stream(spark, f"{right}/*", authors.schema), AUTHOR_WAIT_SECONDS, parts=4)
        keyed.append_stream(joined_rows, out, offsets, state_tasks(spark))
    found = spark.read.parquet(out).select(
        F.from_json("post", "post_id string")["post_id"].alias("post_id"), "author_id",
        F.from_json("author", "username string, balance double").alias("by_author"))
    by_post = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("post_id"),
        F.struct(F.col("s_name").alias("username"), F.round("s_acctbal", 2).alias("balance")).alias("by_post"))
    author = F.coalesce("by_post", "by_author")
    return found.join(by_post, "post_id", "left").select(
        "post_id", "author_id", author["username"].alias("username"), author["balance"].alias("balance"))


@query("stream_daily_levels")
def stream_daily_levels(spark, sf):
    rows = to_posts_stream(fixture.stream(spark, sf, "documents"))
    out, offsets = fresh_dir(spark, "stream-levels"), fresh_dir(spark, "stream-levels-offsets")
    jobs.daily_level_stream(rows, out, offsets)
    return plain(jobs.read_daily_levels(spark, out))


def to_posts_stream(documents: DataFrame) -> DataFrame:
    documents = documents.repartition(documents.sparkSession.sparkContext.defaultParallelism)
    return ingest.to_stored(ingest.enrich(fixture.raw_versions(documents), SETTINGS))
