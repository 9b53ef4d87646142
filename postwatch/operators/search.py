"""Token and phrase search with filters, ordering and keyset paging; ranked lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.indicators import indicator_struct
from postwatch.functions.records import ntz
from postwatch.functions.text import has_tokens_in_row, highlight_offsets, search_tokens
from postwatch.operators.versions import current_matching, latest_of_post, top_current
from postwatch.schema import (
    IOC_TYPES,
    LIVE_SOURCE,
    METRIC_COLUMNS,
    RECENT_COLUMNS,
    SEARCH_COLUMNS,
    SOURCE_URL_PREFIX,
    PageKey,
    SearchSpec,
    Settings,
)


def text_predicate(spec: SearchSpec) -> Column:
    normalized = F.col("normalized_text")
    if spec.mode == "phrase":
        return has_tokens_in_row(normalized, search_tokens(spec.query))
    tokens = search_tokens(spec.query, spec.verbatim_terms)
    hits = [has_tokens_in_row(normalized, [token]) for token in dict.fromkeys(tokens)]
    return reduce(and_ if spec.mode == "all" else or_, hits)


def has_indicator(ioc_type: str) -> Column:
    return reduce(or_, [F.size(name) > 0 for name in IOC_TYPES[ioc_type]])


def day_bounds(spec: SearchSpec) -> list[Column]:
    """Bounds on the partition column implied by the time bounds and the cursor.

    ``day`` is part of the version key, so these may be applied before versions are compared and
    prune whole partitions, which a bound on ``created_at`` cannot do there.
    """
    bounds = []
    if spec.date_from:
        bounds.append(F.col("day") >= F.to_date(ntz(spec.date_from)))
    if spec.date_to:
        bounds.append(F.col("day") <= F.to_date(ntz(spec.date_to)))
    if spec.after and spec.sort == "newest":  # what follows the cursor is not younger
        bounds.append(F.col("day") <= F.to_date(ntz(spec.after.created_at)))
    return bounds


def filters(spec: SearchSpec) -> list[Column]:
    chosen = [text_predicate(spec)]
    if spec.date_from:
        chosen.append(F.col("created_at") >= ntz(spec.date_from))
    if spec.date_to:
        chosen.append(F.col("created_at") <= ntz(spec.date_to))
    if spec.lang:
        chosen.append(F.col("lang") == spec.lang)
    if spec.min_score is not None:
        chosen.append(F.col("cti_score") >= spec.min_score)
    if spec.level:
        chosen.append(F.col("cti_level") == spec.level)
    if spec.category:
        chosen.append(F.array_contains("cti_categories", spec.category))
    if spec.author:
        chosen.append(F.col("username") == spec.author.lstrip("@").lower())
    if spec.ioc_type:
        chosen.append(has_indicator(spec.ioc_type))
    if spec.after:
        chosen.append(_after(spec))
    return chosen


def _order_columns(spec: SearchSpec) -> list[str]:
    newest = ["created_at", "post_id"]
    return newest if spec.sort == "newest" else ["cti_score", *newest]


def _after(spec: SearchSpec) -> Column:
    position = {
        "cti_score": F.lit(spec.after.score),
        "created_at": ntz(spec.after.created_at),
        "post_id": F.lit(spec.after.post_id),
    }
    names = _order_columns(spec)
    return F.struct(*names) < F.struct(*[position[name].alias(name) for name in names])


def matching(
    posts: DataFrame,
    spec: SearchSpec,
    versioned: bool = False,
    columns: Sequence[str] = SEARCH_COLUMNS,
) -> DataFrame:
    """All current posts the parameters select, without order or limit.

    ``versioned`` says that ``posts`` still holds superseded versions; then hits are found and written
    while the frame is built.
    """
    posts, predicate = _selected(posts, spec)
    if versioned:
        return current_matching(posts, predicate, columns).select(*columns)
    return posts.filter(predicate).select(*columns)


def _selected(posts: DataFrame, spec: SearchSpec) -> tuple[DataFrame, Column]:
    for bound in day_bounds(spec):
        posts = posts.filter(bound)
    return posts, reduce(and_, filters(spec))


def search_rows(
    posts: DataFrame,
    spec: SearchSpec,
    versioned: bool = False,
    columns: Sequence[str] = SEARCH_COLUMNS,
) -> DataFrame:
    """The page the parameters ask for, plus one row that tells whether another page follows.

    With ``versioned``, the leading rows are chosen while the frame is built, by two jobs in general.
    """
    posts, predicate = _selected(posts, spec)
    return top_current(
        posts, versioned, predicate, _order_columns(spec), spec.limit + 1, columns
    )


@dataclass(frozen=True)
class Page:
    """At most ``limit`` (100) result rows on the driver and the key the next page starts after."""

    rows: list
    next_key: PageKey | None


def search(posts: DataFrame, spec: SearchSpec, versioned: bool = False) -> Page:
    rows = shape_results(search_rows(posts, spec, versioned), spec.query).collect()
    if len(rows) <= spec.limit:
        return Page(rows, None)
    rows = rows[: spec.limit]
    last = rows[-1]
    return Page(rows, PageKey(last["cti_score"], last["created_at"], last["post_id"]))


def source_url() -> Column:
    return F.when(
        F.col("source_type") == LIVE_SOURCE, F.concat(F.lit(SOURCE_URL_PREFIX), F.col("post_id"))
    )


def metrics_map() -> Column:
    pairs = [item for name, column in METRIC_COLUMNS.items()
             for item in (F.lit(name), F.col(column))]
    return F.create_map(*pairs)


def shape_results(rows: DataFrame, query: str = "") -> DataFrame:
    """Stored columns to result columns: indicator struct, metric map, link and highlights."""
    spans = (
        highlight_offsets(F.col("text"), query)
        if query
        else F.array().cast("array<struct<start: int, end: int>>")
    )
    return rows.select(
        "post_id", "text", "username", "display_name", "lang", "created_at", "cti_score",
        "cti_level", "cti_categories", "cti_reasons", indicator_struct().alias("indicators"),
        F.col("cti_scoring_mode").alias("scoring_mode"), "scorer_version", "model_revision",
        spans.alias("highlights"), metrics_map().alias("metrics"),
        source_url().alias("source_url"),
    )


def recent(posts: DataFrame, limit: int = 50, versioned: bool = False) -> DataFrame:
    """Newest posts by ingest time."""
    newest = top_current(
        posts, versioned, None, ("ingested_at", "post_id"), _checked(limit), RECENT_COLUMNS
    )
    return newest.withColumn("source_url", source_url()).drop("source_type")


def top_scored(
    posts: DataFrame, limit: int = 20, settings: Settings | None = None, versioned: bool = False
) -> DataFrame:
    """Highest scores from the high threshold up."""
    high = F.col("cti_score") >= (settings or Settings()).thresholds.high
    order = ("cti_score", "created_at", "post_id")
    return top_current(posts, versioned, high, order, _checked(limit), SEARCH_COLUMNS)


def get_post(posts: DataFrame, post_id: str) -> DataFrame:
    return shape_results(latest_of_post(posts, post_id))


def _checked(limit: int) -> int:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit
