"""Schemas, column lists, settings and validated search parameters.

All times are UTC wall clock stored as ``timestamp_ntz``, so no result depends on the session
time zone. ``day`` is derived from ``created_at`` and part of the version key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

# --- fixed values: stored column names and order, indicator field order -------------------------
INDICATOR_FIELDS = (
    "ipv4", "ipv6", "domains", "urls", "emails", "md5", "sha1", "sha256", "sha512",
    "cves", "attack_techniques", "filenames", "hashtags", "threat_actors",
)
METRIC_COLUMNS = {
    "replies": "reply_count",
    "reposts": "repost_count",
    "quotes": "quote_count",
    "likes": "like_count",
    "bookmarks": "bookmark_count",
    "impressions": "impression_count",
}
POST_TYPES = {
    "source_type": T.StringType(), "post_id": T.StringType(), "author_id": T.StringType(),
    "conversation_id": T.StringType(), "text": T.StringType(),
    "normalized_text": T.StringType(), "lang": T.StringType(),
    "created_at": T.TimestampNTZType(), "ingested_at": T.TimestampNTZType(),
    "username": T.StringType(), "display_name": T.StringType(),
    "author_verified": T.BooleanType(), "author_protected": T.BooleanType(),
    **{name: T.LongType() for name in METRIC_COLUMNS.values()},
    "urls": STRINGS, "hashtags": STRINGS, "mentions": STRINGS, "referenced_post_ids": STRINGS,
    "cti_score": T.IntegerType(), "cti_level": T.StringType(),
    "cti_rule_score": T.IntegerType(), "cti_semantic_score": T.FloatType(),
    "cti_scoring_mode": T.StringType(), "cti_categories": STRINGS, "cti_reasons": STRINGS,
    **{f"ioc_{name}": STRINGS for name in INDICATOR_FIELDS},
    "scorer_version": T.StringType(), "model_revision": T.StringType(),
    "content_version": T.IntegerType(),
    "source_updated_at": T.TimestampNTZType(), "compliance_checked_at": T.TimestampNTZType(),
}
LEVELS = ("low", "medium", "high", "critical")
IOC_TYPES = {
    "ip": ("ioc_ipv4", "ioc_ipv6"),
    "domain": ("ioc_domains",),
    "url": ("ioc_urls",),
    "hash": ("ioc_md5", "ioc_sha1", "ioc_sha256", "ioc_sha512"),
    "cve": ("ioc_cves",),
    "attack": ("ioc_attack_techniques",),
}
SOURCE_URL_PREFIX = "https://x.com/i/web/status/"
LIVE_SOURCE = "x_home"
NO_MODEL_SCORE = -1.0
# ------------------------------------------------------------------------------------------------

POST_COLUMNS = tuple(POST_TYPES)
IOC_COLUMNS = tuple(f"ioc_{name}" for name in INDICATOR_FIELDS)
POSTS_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in POST_TYPES.items()])
STORED_SCHEMA = T.StructType([*POSTS_SCHEMA.fields, T.StructField("day", T.DateType())])
SEARCH_COLUMNS = (
    "source_type", "post_id", "text", "username", "display_name", "lang", "created_at",
    "cti_score", "cti_level", "cti_categories", "cti_reasons", *IOC_COLUMNS,
    "cti_scoring_mode", "scorer_version", "model_revision", *METRIC_COLUMNS.values(),
)
RECENT_COLUMNS = (
    "source_type", "post_id", "text", "username", "display_name", "lang",
    "created_at", "ingested_at", "cti_score", "cti_level", "cti_categories",
)
VERSION_KEY = ("day", "post_id")

# --- fixed values: names and types of payloads, pages and scraped rows ---------------------------
# One queued payload: a post, its author, and the posts it refers to by id.
REFERENCED = "map<string, struct<id: string, text: string>>"
PAYLOAD_DDL = f"""
post struct<
  id: string, text: string, author_id: string, conversation_id: string, created_at: string,
  lang: string,
  public_metrics: struct<reply_count: bigint, retweet_count: bigint, quote_count: bigint,
    like_count: bigint, bookmark_count: bigint, impression_count: bigint>,
  entities: struct<urls: array<struct<url: string, expanded_url: string>>,
    hashtags: array<struct<tag: string>>, mentions: array<struct<username: string>>>,
  referenced_tweets: array<struct<type: string, id: string>>,
  _referenced_posts: {REFERENCED},
  edit_history_tweet_ids: array<string>>,
author struct<id: string, username: string, name: string, verified: boolean, protected: boolean>
"""
# A page: its items stay text at first, so that one odd item does not spoil the page.
PAGE_DDL = (
    "data array<string>, includes struct<users: array<string>, tweets: array<string>>, "
    "meta struct<newest_id: string, next_token: string>"
)
PAGE_POST_DDL = """
id string, text string, author_id string, conversation_id string, created_at string, lang string,
public_metrics struct<reply_count: bigint, retweet_count: bigint, quote_count: bigint,
  like_count: bigint, bookmark_count: bigint, impression_count: bigint>,
entities struct<urls: array<struct<url: string, expanded_url: string>>,
  hashtags: array<struct<tag: string>>, mentions: array<struct<username: string>>>,
referenced_tweets array<struct<type: string, id: string>>,
edit_history_tweet_ids array<string>
"""
PAGE_USER_DDL = "id string, username string, name string, verified boolean, protected boolean"
PAGE_TWEET_DDL = "id string, text string"
SCRAPED_DDL = """
post_id string, permalink string, created_at string, text string, lang string,
username string, display_name string, verified boolean,
reply_label string, retweet_label string, like_label string, impression_label string,
urls array<struct<url: string, expanded_url: string>>, hashtags array<string>,
mentions array<string>, quoted_post_id string, quoted_text string
"""
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    # --- fixed values
    medium: int = 40
    high: int = 70
    critical: int = 85

    def __post_init__(self) -> None:
        if not 1 <= self.medium < self.high < self.critical <= 100:
            raise ValueError("thresholds must satisfy 1 <= medium < high < critical <= 100")


def parse_handles(listed: str) -> tuple[str, ...]:
    """Comma separated account names, cleaned of case, blanks and leading at-signs."""
    cleaned = (entry.strip().lower().lstrip("@") for entry in listed.split(","))
    return tuple(sorted({entry for entry in cleaned if entry}))


@dataclass(frozen=True)
class Settings:
    # --- fixed values: documented defaults
    thresholds: Thresholds = field(default_factory=Thresholds)
    trusted_handles: tuple[str, ...] = ()
    daily_read_budget: int = 10_000
    queue_byte_limit: int = 536_870_912
    queue_depth_warning: int = 1_000
    queue_batch: int = 100
    retry_delay_seconds: int = 30
    seen_retention_days: int = 30
    stale_hours: int = 24
    due_hours: int = 23
    scorer_version: str = "rules-1.0.0"


@dataclass(frozen=True)
class PageKey:
    """Position after which the next page starts; carried whatever the sort is."""

    score: int
    created_at: datetime
    post_id: str


@dataclass(frozen=True)
class SearchSpec:
    """Checked search parameters; a bad value raises before any plan is built."""

    query: str
    mode: str = "all"
    sort: str = "relevance"
    limit: int = 20
    after: PageKey | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    lang: str | None = None
    min_score: int | None = None
    level: str | None = None
    category: str | None = None
    ioc_type: str | None = None
    author: str | None = None
    verbatim_terms: bool = False

    def __post_init__(self) -> None:
        from postwatch.functions.text import split_terms

        def one_of(name: str, value: str | None, allowed) -> None:
            if value is not None and value not in allowed:
                raise ValueError(f"{name} must be one of {sorted(allowed)}")

        def length(name: str, value: str | None, low: int, high: int) -> None:
            if value is not None and not low <= len(value) <= high:
                raise ValueError(f"{name} must have {low} to {high} characters")

        length("query", self.query, 3, 256)
        if len(split_terms(self.query)) > 5:
            raise ValueError("use at most five terms")
        one_of("mode", self.mode, {"all", "any", "phrase"})
        one_of("sort", self.sort, {"relevance", "newest", "cti"})
        one_of("level", self.level, set(LEVELS))
        one_of("ioc_type", self.ioc_type, set(IOC_TYPES))
        length("lang", self.lang, 2, 12)
        length("category", self.category, 0, 64)
        length("author", self.author, 0, 64)
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be between 1 and 100")
        if self.min_score is not None and not 0 <= self.min_score <= 100:
            raise ValueError("min_score must be between 0 and 100")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from must not be later than date_to")
