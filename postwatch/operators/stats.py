"""Dashboard aggregates. Each combines map-side, so a hot day or category shuffles little."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.records import ntz
from postwatch.operators.versions import Settled, narrow_current
from postwatch.schema import LIVE_SOURCE, Settings

# --- fixed values --------------------------------------------------------------------------------
WINDOW_DAYS = 30
TOP_CATEGORIES = 8
TIMELINE_FLOOR = 4.0
TOTALS = {
    "network": ("ioc_ipv4", "ioc_ipv6", "ioc_domains", "ioc_urls"),
    "hashes": ("ioc_md5", "ioc_sha1", "ioc_sha256", "ioc_sha512"),
    "cve_attack": ("ioc_cves", "ioc_attack_techniques"),
}
# -------------------------------------------------------------------------------------------------


def _overview(settings: Settings) -> list[Column]:
    limits = settings.thresholds
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("cti_score") >= limits.high).alias("high"),
        F.count_if(F.col("cti_score") >= limits.critical).alias("critical"),
        F.max("ingested_at").alias("latest"),
    ]


def _sizes() -> dict[str, Column]:
    return {
        name: sum((F.size(column) for column in columns[1:]), F.size(columns[0])).cast("bigint")
        for name, columns in TOTALS.items()
    }


def measures(settings: Settings | None = None) -> dict[str, Column]:
    """What one post adds to the counts of the overview besides itself, as 0/1 or a number."""
    limits = (settings or Settings()).thresholds
    levels = {"high": limits.high, "critical": limits.critical}
    return {**{name: (F.col("cti_score") >= limit).cast("long") for name, limit in levels.items()},
            **_sizes()}


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in TOTALS]


def _columns(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def overview_counts(
    posts: DataFrame, settings: Settings | None = None, versioned: bool | Settled = False
) -> DataFrame:
    rows = narrow_current(posts, versioned, **_columns("cti_score", "ingested_at"))
    return rows.agg(*_overview(settings or Settings()))


def indicator_totals(posts: DataFrame, versioned: bool | Settled = False) -> DataFrame:
    return narrow_current(posts, versioned, **_sizes()).agg(*_totals())


def _recent(posts: DataFrame, as_of: datetime, versioned: bool | Settled, *names: str) -> DataFrame:
    """Given columns of the current posts of the last days.

    The bound on the partition column prunes and is safe below the version comparison, since the
    day is part of the key; the bound on the time decides.
    """
    start = F.timestamp_add("DAY", F.lit(-WINDOW_DAYS), ntz(as_of))
    days = posts.filter(F.col("day") >= F.to_date(start))
    rows = narrow_current(days, versioned, **_columns("created_at", *names))
    return rows.filter(F.col("created_at") >= start)


def timeline(posts: DataFrame, as_of: datetime, versioned: bool | Settled = False) -> DataFrame:
    return (
        _recent(posts, as_of, versioned, "day")
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("posts"))
        .select(F.col("day").cast("string").alias("day"), "posts")
        .orderBy("day")
    )


def category_counts(posts: DataFrame, as_of: datetime, versioned: bool | Settled = False) -> DataFrame:
    return (
        _recent(posts, as_of, versioned, "cti_categories")
        .select(F.explode("cti_categories").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("posts"))
        .orderBy(F.col("posts").desc(), "category")
        .limit(TOP_CATEGORIES)
    )


def overview(
    posts: DataFrame, as_of: datetime, settings: Settings | None = None, versioned: bool | Settled = False
) -> dict:
    """The parts of the dashboard; ``summary`` is one row of counts and indicator totals.

    Both come from one pass over the posts, which is why they are one frame.
    """
    rows = narrow_current(posts, versioned, **_columns("cti_score", "ingested_at"), **_sizes())
    return {
        "summary": rows.agg(*_overview(settings or Settings()), *_totals()),
        "timeline": timeline(posts, as_of, versioned),
        "categories": category_counts(posts, as_of, versioned),
    }


def overview_of_days(days: DataFrame) -> DataFrame:
    """The summary row of :func:`overview` from one row per day (``streaming.keyed.day_summaries``)."""
    zero = F.lit(0).cast("bigint")
    names = ("high", "critical", *TOTALS)
    sums = [F.coalesce(F.sum(name), zero).cast("bigint").alias(name) for name in names]
    return days.agg(F.coalesce(F.sum("posts"), zero).cast("bigint").alias("total"), *sums[:2],
                    F.max("latest").alias("latest"), *sums[2:])


def daily_levels(posts: DataFrame, versioned: bool | Settled = False) -> DataFrame:
    """Rows per day and level.

    Of all stored rows it counts inserts, as a rollup kept on insert does; with ``versioned`` it
    compares versions first and counts posts.
    """
    rows = narrow_current(posts, versioned, **_columns("day", "cti_level"))
    return rows.groupBy("day", "cti_level").agg(F.count(F.lit(1)).alias("posts"))


def distinct_live_ids(posts: DataFrame, versioned: bool | Settled = False) -> DataFrame:
    rows = narrow_current(posts, versioned, **_columns("source_type", "post_id"))
    return rows.filter(F.col("source_type") == LIVE_SOURCE).select("post_id").distinct()


def chart_share(values: DataFrame, column: str = "posts", floor: float | None = None) -> DataFrame:
    """Percent of the largest value (at least 1), with an optional floor for thin bars.

    The largest value is a scalar subquery, so no row has to meet another.
    """
    largest = values.agg(F.greatest(F.lit(1), F.max(column)).alias("largest")).scalar()
    share = F.col(column) / largest * 100
    return values.withColumn(
        "share", share if floor is None else F.greatest(F.lit(float(floor)), share)
    )
