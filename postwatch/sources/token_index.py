"""Inverted index over stored posts: which day and post a token occurs in.

The index is only a first sieve. Its candidates are checked against the stored text with the same
predicate a full scan uses, so a row of a superseded version in the index does no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.text import search_tokens, tokenize
from postwatch.operators.search import day_bounds
from postwatch.operators.versions import BROADCAST_KEYS
from postwatch.schema import VERSION_KEY, SearchSpec
from postwatch.session import fresh_dir

BUCKETS = 256
PUSHED_IDS = 1_000  # ids that are written into a scan's filter
INDEX_DDL = "token string, day date, post_id string, bucket int"


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def append_index(posts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add the tokens of newly stored rows.

    Texts are cut once. Rebalancing keeps a bucket in few files, each sorted by token, day and post,
    and splits the bucket of a common token over as many tasks and files as it needs.
    """
    tokens = F.explode(F.array_distinct(tokenize(F.col("normalized_text"))))
    (
        posts.select(tokens.alias("token"), "day", "post_id")
        .withColumn("bucket", bucket_of(F.col("token"), buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "token", "day", "post_id")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(path)


def candidates(index: DataFrame, spec: SearchSpec, buckets: int = BUCKETS) -> DataFrame:
    """Keys with all (or, for ``any``, one) of the query's tokens, by partition-pruned lookups."""
    tokens = sorted(set(search_tokens(spec.query)))
    places = {
        row["token"]: row["bucket"]
        for row in index.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        .withColumn("bucket", bucket_of(F.col("token"), buckets)).collect()
    }
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("bucket") == place) & (F.col("token") == token)
         for token, place in places.items()],
    )
    rows = index.filter(F.col("bucket").isin(*set(places.values())) & wanted)
    for bound in day_bounds(spec):
        rows = rows.filter(bound)
    if spec.mode == "any":
        return rows.select(*VERSION_KEY).distinct()
    flags = [F.max(F.col("token") == token).alias(f"_t{n}") for n, token in enumerate(tokens)]
    found = rows.groupBy(*VERSION_KEY).agg(*flags)
    every = reduce(lambda a, b: a & b, [F.col(f"_t{n}") for n in range(len(tokens))])
    return found.filter(every).select(*VERSION_KEY)


def restrict(
    posts: DataFrame, index: DataFrame, spec: SearchSpec, buckets: int = BUCKETS
) -> DataFrame:
    """Stored rows of the candidate keys, to be searched instead of the whole table.

    The keys are written once, since they are read for the text and again for newer versions. Their
    days, of which there are no more than the calendar has, go into the partition filter of every
    later scan, and few ids go into its row group filter. A checked number of keys is broadcast;
    more are joined by a shuffle.
    """
    if spec.verbatim_terms and spec.mode != "phrase":
        return posts  # uncut terms are no index tokens
    path = fresh_dir(posts.sparkSession, "candidates")
    candidates(index, spec, buckets).write.parquet(path)
    keys = posts.sparkSession.read.parquet(path)
    days = {row["day"]: row["n"] for row in
            keys.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not days:
        return posts.limit(0)
    count = sum(days.values())
    rows = posts.filter(F.col("day").isin(sorted(days)))
    if count <= PUSHED_IDS:
        rows = rows.filter(F.col("post_id").isin([row["post_id"] for row in keys.collect()]))
    if count <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, list(VERSION_KEY), "left_semi")


def remove_from_index(index: DataFrame, path: str, deleted: DataFrame) -> int:
    """Drop the tokens of the listed ids; the number of buckets that had some.

    A dynamic overwrite replaces just these buckets. The list of them is bounded by their number.
    """
    ids = deleted.select("post_id").distinct()
    touched = [row["bucket"] for row in index.join(ids, "post_id", "left_semi")
               .select("bucket").distinct().collect()]
    if touched:
        (
            index.filter(F.col("bucket").isin(touched)).join(ids, "post_id", "left_anti")
            .select("token", "day", "post_id", "bucket")
            .hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "day", "post_id")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(path)
        )
    return len(touched)
