"""Posts, payloads, pages and ledgers derived from the driver tables.

``documents`` becomes raw post versions: every document has version 1; French and German ones also
an edited version 2; Spanish ones a version 3 on the next day, which is a key of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.records import ntz
from postwatch.operators.ingest import enrich, to_stored
from postwatch.operators.versions import current_posts
from postwatch.schema import LIVE_SOURCE, Settings
from postwatch.session import fresh_dir
from postwatch.sources.store import append_posts, read_versions
from postwatch.sources.token_index import append_index
from postwatch.streaming.jobs import landing_stream, payload_stream

# Sentences of our own that carry indicators; each document gets one by its number.
SENTENCES = (
    "Exploit for CVE-2031-10001 seen from 198.51.100.7 calling bad-host.example",
    "Ransomware crew posts hxxps://drop[.]badsite.example/kit.zip with "
    "d41d8cd98f00b204e9800998ecf8427e",
    "APT77 phishing wave uses T1566.002 and T1059 #phish #SOC",
    "Advisory mentions sender alerts@mail.example.org and UNC4321 loader.dll "
    "from 2001:DB8:0:0::0A 2001:db8::1:0:0:7",
    "Routine release notes for a stable build",
    "Sunny day at the community meetup",
)
START = datetime(2026, 1, 1)
AS_OF = datetime(2026, 1, 31)
EVENTS_AS_OF = datetime(2024, 1, 15, 12)
CYCLE_MINUTES = 86_400  # created_at stays within sixty days however many documents there are
SETTINGS = Settings(trusted_handles=("user_src1", "user_src2"))
EMPTY = "array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of the files it consists of."""
    schema = table(spark, sf_dir, name).schema
    return landing_stream(spark, f"{sf_dir}/{name}.parquet*", schema)


def event_batches(spark: SparkSession, sf_dir: str, latest_first: bool = True,
                  parts: int = 4) -> list[DataFrame]:
    """The events in batches by days of the month; those without a time are in the last one."""
    events = table(spark, sf_dir, "events")
    day = F.dayofmonth(F.col("ts").cast("timestamp_ntz"))
    place = F.floor(((31 - day) if latest_first else day) / (32 // parts))
    return [events.filter(F.coalesce(place, F.lit(parts - 1)) == part) for part in range(parts)]


def run_landings(spark: SparkSession, batches: list[DataFrame], start: Callable[[DataFrame], None]) -> None:
    """Land one batch after the other, in as many files as it has, and run a stream after each."""
    path = fresh_dir(spark, "landing")
    for number, batch in enumerate(batches):
        batch.write.parquet(f"{path}/{number}")
        start(landing_stream(spark, f"{path}/*", batch.schema))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = payload_lines(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return payload_stream(lines)


def sentence(number: Column) -> Column:
    listed = F.array(*[F.lit(text) for text in SENTENCES])
    return F.element_at(listed, (F.pmod(number, F.lit(len(SENTENCES))) + 1).cast("int"))


def raw_versions(documents: DataFrame) -> DataFrame:
    """All versions of all posts before enrichment: one pass over the documents, no shuffle."""
    number = F.col("doc_id")
    body = F.concat(F.col("text"), F.lit(" "), sentence(number))
    likes = F.col("n_chars") % 500

    def version(count: int, prefix: str, days: int) -> Column:
        return F.struct(
            F.lit(count).alias("content_version"),
            F.concat(F.lit(prefix), body).alias("text"),
            F.lit(days).alias("_days"),
            (likes + (count - 1)).alias("like_count"),
        )

    versions = F.array_compact(
        F.array(
            version(1, "", 0),
            F.when(F.col("lang").isin("fr", "de"), version(2, "Edited: ", 0)),
            F.when(F.col("lang") == "es", version(3, "Moved: ", 1)),
        )
    )
    minutes = F.pmod(number * 37, F.lit(CYCLE_MINUTES))
    exploded = documents.withColumn("_v", F.explode(versions)).withColumn(
        "created_at",
        F.timestamp_add("MINUTE", minutes + F.col("_v._days") * 1440, ntz(START)),
    )
    none = F.array().cast(EMPTY)
    zero = F.lit(0).cast("bigint")
    return exploded.select(
        F.when(F.col("lang") == "en", LIVE_SOURCE).otherwise("synthetic").alias("source_type"),
        number.cast("string").alias("post_id"),
        F.col("source").alias("author_id"),
        number.cast("string").alias("conversation_id"),
        F.col("_v.text").alias("text"),
        "lang",
        "created_at",
        F.timestamp_add("MINUTE", F.col("_v.content_version"), F.col("created_at")).alias(
            "ingested_at"
        ),
        F.concat(F.lit("user_"), "source").alias("username"),
        F.upper("source").alias("display_name"),
        F.lit(False).alias("author_verified"),
        F.lit(False).alias("author_protected"),
        zero.alias("reply_count"), zero.alias("repost_count"), zero.alias("quote_count"),
        F.col("_v.like_count").alias("like_count"),
        zero.alias("bookmark_count"),
        F.col("n_chars").alias("impression_count"),
        none.alias("urls"), none.alias("hashtags"), none.alias("mentions"),
        none.alias("referenced_post_ids"),
        F.col("_v.content_version").alias("content_version"),
        F.col("created_at").alias("source_updated_at"),
        F.col("created_at").alias("compliance_checked_at"),
        F.to_date("created_at").alias("day"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table; each driver folder has it in one file, so its rows are dealt out."""
    return dealt(table(spark, sf_dir, "documents"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of an unsplittable file on all cores, for work that is bound by computing."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_versions(documents(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions before enrichment, so that only they are enriched."""
    return current_posts(versions(spark, sf_dir))


def all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored columns of every version."""
    return to_stored(enrich(versions(spark, sf_dir), SETTINGS))


_STORED: dict[tuple[str, str], str] = {}


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder with every version of the posts of a driver folder, ingested once per application."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _STORED:
        path = fresh_dir(spark, "posts")
        append_posts(all_versions(spark, sf_dir), path)
        _STORED[place] = path
    return _STORED[place]


def enriched(spark: SparkSession, sf_dir: str, wanted: Column) -> DataFrame:
    """Stored columns of the wanted versions, chosen before they are enriched, for a query that stores
    them itself; posts that this application has stored already are read instead."""
    if (spark.sparkContext.applicationId, sf_dir) in _STORED:
        return posts(spark, sf_dir).filter(wanted)
    return to_stored(enrich(versions(spark, sf_dir).filter(wanted), SETTINGS))


def index_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the token index of the stored posts."""
    place = (spark.sparkContext.applicationId, f"{sf_dir}#index")
    if place not in _STORED:
        path = fresh_dir(spark, "index")
        append_index(posts(spark, sf_dir), path)
        _STORED[place] = path
    return _STORED[place]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored posts, superseded versions included."""
    return read_versions(spark, stored_path(spark, sf_dir))


# --- events as ledgers ---------------------------------------------------------------------------


def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source_id"),
        F.col("props").alias("payload"), F.lit(0).alias("attempts"),
        F.col("ts").cast("timestamp_ntz").alias("available_at"),
    )


def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    return events.withColumns({"ts": ts, "day": F.to_date(ts), "hour": F.hour(ts)})


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value writes: the newest event of a type sets the key of that type."""
    keys = {
        "click": "last_collector_success", "view": "last_compliance_success",
        "error": "last_collector_error",
    }
    known = reduce(
        lambda chain, pair: chain.when(F.col("event_type") == pair[0], pair[1]),
        list(keys.items())[1:],
        F.when(F.col("event_type") == next(iter(keys)), keys[next(iter(keys))]),
    ).otherwise("worker_scoring_mode")
    ts = F.col("ts").cast("timestamp_ntz")
    written = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    value = F.when(known == "worker_scoring_mode", "hybrid").when(
        known == "last_collector_error", ""
    ).otherwise(written)
    return event_reads(spark, sf_dir).select(
        known.alias("key"), value.alias("value"), ts.alias("updated_at"), "event_id"
    )


# --- payloads, pages, scraped rows ---------------------------------------------------------------


def payload_lines(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Queued payloads as JSON lines, from documents (also a stream of them) with their labels.

    Toxic documents have a protected author, and those of quality 0 no id, so both are rejected.
    """
    joined = documents.join(labels, "doc_id", "left")
    number = F.col("doc_id")
    toxic, poor = F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(1)) == 0
    minutes = F.pmod(number * 37, F.lit(CYCLE_MINUTES))
    created = F.timestamp_add("MINUTE", minutes, ntz(START))
    post = F.struct(
        F.when(poor & ~toxic, F.lit("")).otherwise(number.cast("string")).alias("id"),
        F.concat("text", F.lit(" "), sentence(number)).alias("text"),
        F.col("source").alias("author_id"),
        number.cast("string").alias("conversation_id"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "lang",
        F.struct(
            (F.col("n_chars") % 500).alias("like_count"), F.col("n_chars").alias("impression_count")
        ).alias("public_metrics"),
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("https://t.example/"), number).alias("url"),
                    F.when(F.col("lang") == "en", F.concat(F.lit("https://long.example/"), number))
                    .alias("expanded_url"),
                )
            ).alias("urls"),
            F.array(F.struct(F.upper("lang").alias("tag"))).alias("hashtags"),
            F.array(F.struct(F.upper("source").alias("username"))).alias("mentions"),
        ).alias("entities"),
        F.array(
            F.struct(F.lit("quoted").alias("type"), F.concat(F.lit("q"), number).alias("id"))
        ).alias("referenced_tweets"),
        F.array(number.cast("string")).alias("edit_history_tweet_ids"),
    )
    author = F.struct(
        F.col("source").alias("id"), F.concat(F.lit("User_"), "source").alias("username"),
        F.upper("source").alias("name"), toxic.alias("protected"),
    )
    return joined.select(
        F.to_json(F.struct(post.alias("post"), author.alias("author"))).alias("value")
    )


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page document per conversation turn; each turn quotes the turn before it."""
    turns = table(spark, sf_dir, "conversations")

    def turn_id(conv: Column, turn: Column) -> Column:
        return F.concat(conv.cast("string"), F.lit("-"), turn.cast("string"))

    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_before")
    )
    joined = turns.join(before, ["conv_id", "turn"], "left")
    conv, turn = F.col("conv_id"), F.col("turn")
    quotes = F.col("_before").isNotNull()
    previous = turn_id(conv, turn - 1)
    relation = F.struct(F.lit("quoted").alias("type"), previous.alias("id"))
    post = F.struct(
        turn_id(conv, turn).alias("id"), F.col("text").alias("text"),
        F.col("role").alias("author_id"), conv.cast("string").alias("conversation_id"),
        F.when(quotes, F.array(relation)).alias("referenced_tweets"),
    )
    user = F.struct(F.col("role").alias("id"), F.concat(F.lit("@"), "role").alias("username"),
                    F.initcap("role").alias("name"))
    tweet = F.struct(previous.alias("id"), F.col("_before").alias("text"))
    page = F.struct(
        F.array(post).alias("data"),
        F.struct(F.array(user).alias("users"), F.when(quotes, F.array(tweet)).alias("tweets"))
        .alias("includes"),
        F.struct(
            turn_id(conv, turn).alias("newest_id"),
            F.when(quotes, F.concat(F.lit("before-"), previous)).alias("next_token"),
        ).alias("meta"),
    )
    return joined.select("conv_id", "turn", F.to_json(page).alias("value"))


def timeline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the markup of a timeline page: German ones quote, English ones are verified."""
    number, source = F.col("doc_id").cast("string"), F.col("source")
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    chars = F.col("n_chars").cast("string")
    parts = [
        F.lit('<main><article data-testid="tweet"><div data-testid="User-Name"><a href="/'), source,
        F.lit('"><span>'), F.upper(source), F.lit("</span></a>"),
        F.when(F.col("lang") == "en", '<svg aria-label="Verified account"></svg>').otherwise(""),
        F.lit('</div><a href="/'), source, F.lit("/status/"), number,
        F.lit('?s=1"><time datetime="2026-01-15T10:00:00.000Z">now</time></a>'),
        F.lit('<div data-testid="tweetText" lang="'), F.col("lang"), F.lit('">'), escaped,
        F.lit(' <a href="/'), source, F.lit('">@'), source, F.lit('</a> <a href="/hashtag/'),
        F.upper("lang"), F.lit('">#'), F.upper("lang"), F.lit('</a> <a href="https://t.example/'),
        number, F.lit('">link</a></div><button data-testid="reply" aria-label="'), chars,
        F.lit(' Replies">7</button><button data-testid="retweet"><span>'), chars,
        F.lit('</span> Reposts</button><div data-testid="like" aria-label="9 Likes"></div>'),
        F.lit('<button data-testid="app-text-transition-container">'), number,
        F.lit("M Views</button>"),
        F.when(F.col("lang") == "de", F.concat(
            F.lit('<div role="link"><a href="/zed/status/9'), number, F.lit('">q</a> body</div>')
        )).otherwise(""),
        F.lit('<a href="https://card.example/x">card</a></article></main>'),
    ]
    return documents(spark, sf_dir).select("doc_id", F.concat(*parts).alias("html"))


def scraped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scraped rows: French ones only have a link, German ones quote another post."""
    number = F.col("doc_id").cast("string")
    thousands = (F.col("n_chars") / 1000).cast("decimal(10,1)").cast("string")
    return documents(spark, sf_dir).select(
        F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit(" "), number)).alias("post_id"),
        F.concat(F.lit("/"), "source", F.lit("/status/"), number, F.lit("?s=1")).alias("permalink"),
        F.lit("2026-01-15T10:00:00.000Z").alias("created_at"),
        F.concat(F.lit("  "), "text", F.lit("\t ")).alias("text"),
        F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("lang"),
        F.concat(F.lit("@@"), "source").alias("username"),
        F.upper("source").alias("display_name"),
        (F.col("lang") == "en").alias("verified"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" Replies")).alias("reply_label"),
        F.concat(thousands, F.lit("K Reposts")).alias("retweet_label"),
        F.concat(F.col("n_chars").cast("string"), F.lit(",000 Likes")).alias("like_label"),
        F.concat(F.col("doc_id").cast("string"), F.lit("M Views")).alias("impression_label"),
        F.array(
            F.struct(F.concat(F.lit("https://t.example/"), number).alias("url"),
                     F.lit("").alias("expanded_url")),
            F.struct(F.lit("").alias("url"), F.lit("").alias("expanded_url")),
        ).alias("urls"),
        F.array(F.col("lang"), F.lit("")).alias("hashtags"),
        F.array(F.concat(F.lit("@"), "source")).alias("mentions"),
        F.when(F.col("lang") == "de", F.concat(F.lit("9"), number)).otherwise("n/a")
        .alias("quoted_post_id"),
        F.concat(F.lit(" quote of "), number).alias("quoted_text"),
    )
