"""From raw payloads to stored posts: rejects, author and reference lookups, enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.indicators import with_indicators
from postwatch.functions.records import (
    EXPANDING_RELATIONS,
    UNKNOWN_LANGUAGE,
    compact,
    content_version,
    counter,
    entity_names,
    entity_urls,
    ntz,
    parse_utc,
    to_millis,
)
from postwatch.functions.scoring import Scorer, null_scorer, with_scores
from postwatch.functions.text import clean_handle, normalize_text
from postwatch.schema import (
    INDICATOR_FIELDS,
    LIVE_SOURCE,
    NO_MODEL_SCORE,
    POST_TYPES,
    Settings,
)

# Names of the counters in a raw payload, by stored column.
RAW_METRICS = {
    "reply_count": "reply_count", "repost_count": "retweet_count", "quote_count": "quote_count",
    "like_count": "like_count", "bookmark_count": "bookmark_count",
    "impression_count": "impression_count",
}


def _text(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def reject_reason(post: Column, author: Column) -> Column:
    """Why a payload is not stored, or null where it is."""
    no_id = F.coalesce(F.length(post["id"]), F.lit(0)) == 0
    no_text = F.coalesce(F.length(post["text"]), F.lit(0)) == 0
    protected = F.coalesce(author["protected"], F.lit(False))
    given = F.coalesce(F.length(post["created_at"]), F.lit(0)) > 0
    return (
        F.when(no_id, "missing_id")
        .when(no_text, "missing_text")
        .when(protected, "protected_author")
        .when(given & parse_utc(post["created_at"]).isNull(), "bad_created_at")
    )


def split_rejects(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads to store and, with a reason, payloads to set aside.

    A bad row goes to quarantine instead of making its whole batch fail and repeat.
    """
    marked = payloads.withColumn("reason", reject_reason(F.col("post"), F.col("author")))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(
        F.col("reason").isNotNull()
    )


def expanded_text(post: Column) -> Column:
    """Own text, or the first longest text of a reposted or quoted post that is longer."""
    relations = F.filter(
        post["referenced_tweets"], lambda relation: relation["type"].isin(*EXPANDING_RELATIONS)
    )
    texts = F.transform(
        relations, lambda relation: F.try_element_at(post["_referenced_posts"], relation["id"])["text"]
    )
    longest = F.aggregate(
        texts,
        post["text"],
        lambda best, text: F.when(F.length(text) > F.length(best), text).otherwise(best),
    )
    return F.coalesce(longest, post["text"])


def flatten_payloads(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Accepted payloads to the source columns of a post, before enrichment."""
    post, author = F.col("post"), F.col("author")
    metrics, entities = post["public_metrics"], post["entities"]
    now = ntz(as_of)
    created = F.coalesce(parse_utc(F.nullif(post["created_at"], F.lit(""))), now)
    ids = F.transform(
        post["referenced_tweets"], lambda relation: F.nullif(relation["id"], F.lit(""))
    )
    return payloads.select(
        F.lit(LIVE_SOURCE).alias("source_type"),
        post["id"].alias("post_id"),
        _text(post["author_id"]).alias("author_id"),
        _text(post["conversation_id"]).alias("conversation_id"),
        expanded_text(post).alias("text"),
        _text(post["lang"], UNKNOWN_LANGUAGE).alias("lang"),
        to_millis(created).alias("created_at"),
        to_millis(now).alias("ingested_at"),
        _text(F.lower(author["username"])).alias("username"),
        _text(author["name"]).alias("display_name"),
        F.coalesce(author["verified"], F.lit(False)).alias("author_verified"),
        F.lit(False).alias("author_protected"),
        *[counter(metrics, raw).alias(name) for name, raw in RAW_METRICS.items()],
        entity_urls(entities).alias("urls"),
        entity_names(entities["hashtags"], "tag").alias("hashtags"),
        entity_names(entities["mentions"], "username").alias("mentions"),
        compact(ids).alias("referenced_post_ids"),
        content_version(post["edit_history_tweet_ids"]).alias("content_version"),
        to_millis(now).alias("source_updated_at"),
        to_millis(now).alias("compliance_checked_at"),
    )


def enrich(
    df: DataFrame, settings: Settings | None = None, scorer: Scorer = null_scorer
) -> DataFrame:
    """Add folded text, indicators and scores; no shuffle.

    The steps that may call Python come first and next to each other: with expressions between
    them the optimizer would repeat those to evaluate both calls in one go.
    """
    folded = scorer(df.withColumn("normalized_text", normalize_text(F.col("text"))))
    return with_scores(with_indicators(folded), settings)


def to_stored(enriched: DataFrame) -> DataFrame:
    """The stored columns in their order and types, plus the partition column."""
    filled = enriched.withColumns(
        {
            "cti_semantic_score": F.coalesce("cti_semantic_score", F.lit(NO_MODEL_SCORE)),
            "model_revision": F.coalesce("model_revision", F.lit("")),
        }
    )
    return filled.select(
        *[F.col(name).cast(kind).alias(name) for name, kind in POST_TYPES.items()],
        F.to_date("created_at").alias("day"),
    )


def prepare_posts(
    payloads: DataFrame,
    as_of: datetime,
    settings: Settings | None = None,
    scorer: Scorer = null_scorer,
) -> DataFrame:
    """Payloads (post, author) to stored posts; rejected payloads are left out."""
    accepted, _ = split_rejects(payloads)
    return to_stored(enrich(flatten_payloads(accepted, as_of), settings, scorer))


def nest_assessment(enriched: DataFrame) -> DataFrame:
    """Score columns and indicator lists as one ``assessment`` struct."""
    indicators = F.struct(*[F.col(f"ioc_{name}").alias(name) for name in INDICATOR_FIELDS])
    scores = {
        "score": "cti_score", "level": "cti_level", "rule_score": "cti_rule_score",
        "semantic_score": "cti_semantic_score", "scoring_mode": "cti_scoring_mode",
        "categories": "cti_categories", "reasons": "cti_reasons",
        "scorer_version": "scorer_version", "model_revision": "model_revision",
    }
    struct = F.struct(
        *[F.col(column).alias(name) for name, column in scores.items()],
        indicators.alias("indicators"),
    )
    flat = [*scores.values(), *[f"ioc_{name}" for name in INDICATOR_FIELDS]]
    return enriched.withColumn("assessment", struct).drop(*flat)


def flatten_assessment(nested: DataFrame) -> DataFrame:
    """The inverse, with the stored stand-ins for a missing model."""
    part = F.col("assessment")
    flat = {
        "cti_score": part["score"], "cti_level": part["level"],
        "cti_rule_score": part["rule_score"],
        "cti_semantic_score": F.coalesce(part["semantic_score"], F.lit(NO_MODEL_SCORE)),
        "cti_scoring_mode": part["scoring_mode"], "cti_categories": part["categories"],
        "cti_reasons": part["reasons"], "scorer_version": part["scorer_version"],
        "model_revision": F.coalesce(part["model_revision"], F.lit("")),
        **{f"ioc_{name}": part["indicators"][name] for name in INDICATOR_FIELDS},
    }
    return nested.withColumns(flat).drop("assessment")


# Lookups. The looked-up side is unique per key, so a hot author or reference makes only the post
# side heavy, which adaptive execution splits (or avoids by broadcasting a side it has measured).


def latest_authors(authors: DataFrame, order: str = "page_seq") -> DataFrame:
    """One row per author id; later pages overwrite earlier ones."""
    fields = [name for name in authors.columns if name not in ("id", order)]
    newest = F.max_by(F.struct(*fields), F.col(order)).alias("_author")
    return authors.groupBy("id").agg(newest).select(
        "id", *[F.col("_author")[name].alias(name) for name in fields]
    )


def join_authors(
    posts: DataFrame, authors: DataFrame, by_post: DataFrame | None = None
) -> DataFrame:
    """Attach ``author``: by post id where known, else by author id, else an empty struct."""
    fields = [name for name in authors.columns if name != "id"]

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.struct("id", *fields).alias(name))

    joined = posts.join(side(authors, "author_id", "_by_author"), "author_id", "left")
    found = F.col("_by_author")
    if by_post is not None:
        joined = joined.join(side(by_post, "post_id", "_by_post"), "post_id", "left")
        found = F.coalesce(F.col("_by_post"), found)
    empty = F.struct(*[F.lit(None).cast(authors.schema[name].dataType).alias(name)
                       for name in ("id", *fields)])
    return joined.withColumn("author", F.coalesce(found, empty)).drop("_by_author", "_by_post")


def expand_referenced(posts: DataFrame, relations: DataFrame, references: DataFrame) -> DataFrame:
    """Replace ``text`` by the first longest referenced text that is strictly longer.

    ``posts`` (post_id, text), ``relations`` (post_id, pos, type, id), ``references`` (id, text).
    The choice is made over lengths alone; then only chosen texts that are longer are moved.
    """
    wanted = relations.filter(F.col("type").isin(*EXPANDING_RELATIONS))
    sizes = references.select("id", F.length("text").alias("_size"))
    best = (
        wanted.join(sizes, "id")
        .groupBy("post_id")
        .agg(F.max(F.struct(F.col("_size"), -F.col("pos"), F.col("id"))).alias("_best"))
        .select("post_id", F.col("_best.id").alias("id"), F.col("_best._size").alias("_size"))
    )
    own = posts.select("post_id", F.length("text").alias("_own"))
    longer = best.join(own, "post_id").filter(F.col("_size") > F.col("_own")).select("post_id", "id")
    texts = longer.distinct().join(references.select("id", F.col("text").alias("_text")), "id")
    return (
        posts.join(texts.select("post_id", "_text"), "post_id", "left")
        .withColumn("text", F.coalesce("_text", "text"))
        .drop("_text")
    )


def trusted_flag(df: DataFrame, settings: Settings, handle: str = "username") -> DataFrame:
    if not settings.trusted_handles:
        return df.withColumn("trusted", F.lit(False))
    return df.withColumn(
        "trusted", F.coalesce(clean_handle(F.col(handle)).isin(*settings.trusted_handles), F.lit(False))
    )
