"""Page documents and scraped rows to payloads (post, author)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.records import (
    UNKNOWN_LANGUAGE,
    extract_post_id,
    numeric_text,
    parse_metric,
)
from postwatch.functions.text import strip
from postwatch.schema import (
    PAGE_DDL,
    PAGE_POST_DDL,
    PAGE_TWEET_DDL,
    PAGE_USER_DDL,
    REFERENCED,
)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _items(listed: Column, ddl: str) -> Column:
    """Items of a list that are objects, parsed."""
    objects = F.filter(listed, lambda item: F.ltrim(item).startswith("{"))
    return F.transform(objects, lambda item: F.from_json(item, ddl))


def _last_by_id(listed: Column, wanted: Column) -> Column:
    return F.try_element_at(F.filter(listed, lambda item: item["id"] == wanted), F.lit(-1))


def page_posts(pages: DataFrame, value: str = "value") -> DataFrame:
    """One payload per post of each page.

    Users and referenced posts are looked up inside the page they came with, so nothing moves
    between tasks, and a post keeps only the posts it refers to. A user listed under the post's own
    id goes before one listed under its author id. Unreadable pages give no rows and items that are
    no objects are skipped.
    """
    rest = [name for name in pages.columns if name != value]
    page = pages.select(*rest, F.from_json(value, PAGE_DDL).alias("_page"))
    posts = page.select(
        *rest,
        _items(F.col("_page.data"), PAGE_POST_DDL).alias("_posts"),
        _items(F.col("_page.includes.users"), PAGE_USER_DDL).alias("_users"),
        _items(F.col("_page.includes.tweets"), PAGE_TWEET_DDL).alias("_referenced"),
    ).select(*rest, F.explode("_posts").alias("_post"), "_users", "_referenced")
    post = F.col("_post")
    wanted = F.array_distinct(
        F.transform(post["referenced_tweets"], lambda relation: relation["id"])
    )
    entries = F.transform(
        wanted,
        lambda key: F.struct(
            key.alias("key"), _last_by_id(F.col("_referenced"), key).alias("value")
        ),
    )
    known = F.map_from_entries(
        F.filter(entries, lambda entry: entry["key"].isNotNull() & entry["value"].isNotNull())
    )
    return posts.select(
        *rest,
        post.withField("_referenced_posts", known.cast(REFERENCED)).alias("post"),
        F.coalesce(
            _last_by_id(F.col("_users"), post["id"]),
            _last_by_id(F.col("_users"), post["author_id"]),
        ).alias("author"),
    )


def page_meta(pages: DataFrame, value: str = "value") -> DataFrame:
    """Where the next fetch goes on: the newest id and the next token of each page, or null."""
    rest = [name for name in pages.columns if name != value]
    meta = F.from_json(value, PAGE_DDL)["meta"]
    return pages.select(
        *rest, *[F.nullif(meta[name], F.lit("")).alias(name) for name in ("newest_id", "next_token")]
    )


def page_authors(pages: DataFrame, sequence: str, value: str = "value") -> DataFrame:
    """All users of all pages with the sequence number of their page, for the author table."""
    users = _items(F.from_json(value, PAGE_DDL)["includes"]["users"], PAGE_USER_DDL)
    return (
        pages.select(F.col(sequence).alias("page_seq"), F.explode(users).alias("_user"))
        .filter(F.coalesce(F.length("_user.id"), F.lit(0)) > 0)
        .select("page_seq", "_user.*")
    )


def scraped_payloads(raw: DataFrame) -> DataFrame:
    """Scraped rows to payloads; rows without an id or text are dropped."""
    quoted_id = numeric_text(F.col("quoted_post_id"))
    quoted_text = strip(_or_empty(F.col("quoted_text")))
    urls = F.transform(
        F.filter(
            "urls",
            lambda item: (_or_empty(item["url"]) != "") | (_or_empty(item["expanded_url"]) != ""),
        ),
        lambda item: F.struct(
            _or_empty(item["url"]).alias("url"), _or_empty(item["expanded_url"]).alias("expanded_url")
        ),
    )

    def named(column: str, name: str, clean) -> Column:
        kept = F.filter(column, lambda value: _or_empty(value) != "")
        return F.transform(kept, lambda value: F.struct(clean(value).alias(name)))

    def without_at(value: Column) -> Column:
        return F.regexp_replace(value, "^@+", "")

    zero = F.lit(0).cast("bigint")
    post = F.struct(
        extract_post_id(F.col("post_id"), F.col("permalink")).alias("id"),
        strip(_or_empty(F.col("text"))).alias("text"),
        F.lit("").alias("author_id"),
        F.lit("").alias("conversation_id"),
        F.nullif(F.col("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.struct(
            parse_metric(F.col("reply_label")).alias("reply_count"),
            parse_metric(F.col("retweet_label")).alias("retweet_count"),
            zero.alias("quote_count"),
            parse_metric(F.col("like_label")).alias("like_count"),
            zero.alias("bookmark_count"),
            parse_metric(F.col("impression_label")).alias("impression_count"),
        ).alias("public_metrics"),
        F.struct(
            urls.alias("urls"),
            named("hashtags", "tag", lambda value: value).alias("hashtags"),
            named("mentions", "username", without_at).alias("mentions"),
        ).alias("entities"),
        F.when(
            quoted_id.isNotNull(),
            F.array(F.struct(F.lit("quoted").alias("type"), quoted_id.alias("id"))),
        ).otherwise(F.array().cast("array<struct<type: string, id: string>>"))
        .alias("referenced_tweets"),
        F.when(
            quoted_id.isNotNull() & (quoted_text != ""),
            F.create_map(quoted_id, F.struct(quoted_id.alias("id"), quoted_text.alias("text"))),
        ).otherwise(F.create_map().cast(REFERENCED)).alias("_referenced_posts"),
        F.lit(None).cast("array<string>").alias("edit_history_tweet_ids"),
    )
    author = F.struct(
        F.lit("").alias("id"),
        without_at(_or_empty(F.col("username"))).alias("username"),
        _or_empty(F.col("display_name")).alias("name"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.lit(False).alias("protected"),
    )
    return (
        raw.select(post.alias("post"), author.alias("author"))
        .filter(F.col("post.id").isNotNull() & (F.col("post.text") != ""))
    )
