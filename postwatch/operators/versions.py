"""Current versions of posts: one row per (day, post_id), the highest version wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions.records import ntz
from postwatch.schema import VERSION_KEY
from postwatch.session import fresh_dir

BROADCAST_KEYS = 200_000  # about 10 MB of (day, post_id) pairs
MOST_LEADING = 4_000  # narrow rows brought to the driver at a time for a top list

# Order of the versions of one key. Spark keeps no insertion order, so equal versions are told
# apart by ingest time, then by update time and counters. Rows equal in all of these come from a
# replayed batch and are copies of each other. No text is read to compare versions.
VERSION_COLUMNS = (
    "content_version", "ingested_at", "source_updated_at", "impression_count", "like_count",
)


def version_order() -> Column:
    return F.struct(*VERSION_COLUMNS)


def current_posts(versions: DataFrame, key: Sequence[str] = VERSION_KEY) -> DataFrame:
    """Drop all but the newest row per key.

    The rank filter becomes a group limit before the shuffle, so each task sends at most one row
    per key however many versions a key has. Only filters on the key may go below this step.
    """
    newest_first = Window.partitionBy(*key).orderBy(version_order().desc())
    return (
        versions.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


@dataclass(frozen=True)
class Settled:
    """Days known to hold one version per key; given for ``versioned``, they are not compared.

    ``others`` says whether there are other days.
    """

    days: tuple[date, ...]
    others: bool = True


def narrow_current(posts: DataFrame, versioned: bool | Settled, **columns: Column) -> DataFrame:
    """Only the given columns of the current posts.

    They are computed before versions are compared, so that e.g. a count moves instead of its list.
    """
    chosen = [column.alias(name) for name, column in columns.items()]
    if not versioned:
        return posts.select(*chosen)
    if isinstance(versioned, Settled) and versioned.days:
        settled = F.col("day").isin(list(versioned.days))  # a filter on partitions
        clean = posts.filter(settled).select(*chosen)
        if not versioned.others:
            return clean
        return clean.unionByName(narrow_current(posts.filter(~settled), True, **columns))
    needed = [name for name in (*VERSION_KEY, *VERSION_COLUMNS) if name not in columns]
    return current_posts(posts.select(*needed, *chosen)).select(*columns)


def current_matching(versions: DataFrame, predicate: Column, columns: Sequence[str]) -> DataFrame:
    """Rows that satisfy the predicate and are the newest version of their key.

    Same result as ``current_posts(versions).filter(predicate)``, but the predicate reaches the
    scan and only the hits move. They are written to the shared folder, so that the texts are read
    once and a lost executor costs little. A second scan, of the key and version columns alone,
    finds hits that have been superseded; it is not shuffled while the hits are few.
    """
    key = list(VERSION_KEY)
    wanted = list(dict.fromkeys([*key, *columns]))
    spark = versions.sparkSession
    path = fresh_dir(spark, "hits")
    versions.filter(predicate).select(*wanted, version_order().alias("_version")).write.parquet(path)
    hits = spark.read.parquet(path)
    keys = hits.select(*key).distinct()
    if hits.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    newest = (
        versions.select(*key, version_order().alias("_version"))
        .join(keys, key, "left_semi")
        .groupBy(*key)
        .agg(F.max("_version").alias("_version"))
    )
    # A replayed batch may hold a row twice; both copies tie, one stays.
    return hits.join(newest, [*key, "_version"], "left_semi").dropDuplicates(key)


def top_current(
    posts: DataFrame,
    versioned: bool,
    predicate: Column | None,
    descending: Sequence[str],
    limit: int,
    columns: Sequence[str],
) -> DataFrame:
    """The first rows of the current posts by the given columns, largest first.

    With versions in the table, the leading rows of all versions are taken without shuffling the
    table, as narrow rows, and checked for newer versions on their own days. If too few are current,
    the next ones behind the last are taken in the same way, as long as there are any. The columns
    asked for are then read for the winners alone, by their days and ids. Ties end with the day.
    """
    predicate = F.lit(True) if predicate is None else predicate
    order = [F.col(name).desc() for name in dict.fromkeys([*descending, "day"])]
    if not versioned:
        return posts.filter(predicate).orderBy(*order).select(*columns).limit(limit)
    names = list(dict.fromkeys([*descending, "day", *VERSION_KEY, *VERSION_COLUMNS]))
    winners: dict[tuple, Row] = {}
    last, take = None, 2 * limit
    while True:
        rows = posts.filter(predicate)
        if last is not None:
            rows = rows.filter(F.struct(*names) < _position(posts, last, names))
        leading = (
            rows.select(*names).orderBy(*[F.col(name).desc() for name in names]).limit(take).collect()
        )
        newest = _newest(posts, leading)
        for row in leading:
            if newest.get(_key_of(row)) == tuple(row[name] for name in VERSION_COLUMNS):
                winners.setdefault(_key_of(row), row)  # a replayed batch may hold a row twice
        if len(winners) >= limit or len(leading) < take:
            break
        last, take = leading[-1], min(4 * take, MOST_LEADING)
    chosen = list(winners.values())[:limit]
    if not chosen:
        return posts.limit(0).select(*columns)
    exact = [*VERSION_KEY, *VERSION_COLUMNS]
    schema = T.StructType([posts.schema[name] for name in exact])
    wanted = posts.sparkSession.createDataFrame(
        [tuple(row[name] for name in exact) for row in chosen], schema
    )
    return (
        _around(posts, chosen).join(F.broadcast(wanted), exact, "left_semi")  # <= limit rows
        .dropDuplicates(list(VERSION_KEY)).orderBy(*order).select(*columns)
    )


def _key_of(row: Row) -> tuple:
    return tuple(row[name] for name in VERSION_KEY)


def _position(posts: DataFrame, row: Row, names: Sequence[str]) -> Column:
    def literal(name: str) -> Column:
        value = row[name]
        given = ntz(value) if isinstance(value, datetime) else F.lit(value)
        return given.cast(posts.schema[name].dataType).alias(name)

    return F.struct(*[literal(name) for name in names])


def _newest(posts: DataFrame, rows: list[Row]) -> dict[tuple, tuple]:
    """The newest version of the keys of at most ``MOST_LEADING`` rows."""
    if not rows:
        return {}
    schema = T.StructType([posts.schema[name] for name in VERSION_KEY])
    keys = posts.sparkSession.createDataFrame(sorted({_key_of(row) for row in rows}), schema)
    found = (
        _around(posts, rows).select(*VERSION_KEY, version_order().alias("_version"))
        .join(F.broadcast(keys), list(VERSION_KEY), "left_semi")
        .groupBy(*VERSION_KEY).agg(F.max("_version").alias("_version"))
    )
    return {_key_of(row): tuple(row["_version"]) for row in found.collect()}


def _around(posts: DataFrame, rows: list[Row]) -> DataFrame:
    """All versions on the days and with the ids of a few rows; both are pushed into the scan."""
    days = sorted({row["day"] for row in rows})
    ids = sorted({row["post_id"] for row in rows})
    return posts.filter(F.col("day").isin(days) & F.col("post_id").isin(ids))


def latest_of_post(posts: DataFrame, post_id: str) -> DataFrame:
    """Newest version of one id over all days, or no row."""
    if not (post_id.isascii() and post_id.isdigit() and len(post_id) <= 20):
        raise ValueError("a post id has 1 to 20 digits")
    newest = [F.col(name).desc() for name in ("content_version", "day", *VERSION_COLUMNS[1:])]
    return posts.filter(F.col("post_id") == post_id).orderBy(*newest).limit(1)
