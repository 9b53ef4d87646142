"""Stored posts: Parquet partitioned by day, versions appended and compacted."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.operators.versions import Settled, current_posts
from postwatch.schema import STORED_SCHEMA
from postwatch.session import fresh_dir

# Point lookups by id and filters by author skip row groups through bloom filters.
_WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.bloom.filter.enabled#post_id": "true",
    "parquet.bloom.filter.enabled#username": "true",
}


def _laid_out(posts: DataFrame, by_range: bool = False) -> DataFrame:
    """Few files per day and ids in order, without forcing a busy day into one task.

    Rebalancing lets adaptive execution split a large day and merge small ones. By ranges, the files
    of a busy day hold different ids, so a lookup skips most of them; the sampling this takes would
    compute new posts twice, so it is left to compaction.
    """
    rows = posts.select(*[posts[name] for name in STORED_SCHEMA.names])
    dealt = rows.repartitionByRange("day", "post_id") if by_range else rows.hint("rebalance", "day")
    return dealt.sortWithinPartitions("day", "post_id")


def append_posts(posts: DataFrame, path: str) -> None:
    _laid_out(posts).write.mode("append").options(**_WRITE_OPTIONS).partitionBy("day").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows but those that a tombstone covers."""
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    tombstones = read_tombstones(spark, path)
    if tombstones is None:
        return stored
    covered = (stored["post_id"] == F.col("_gone")) & (stored["ingested_at"] <= F.col("_upto"))
    return stored.join(tombstones, covered, "left_anti")


TOMBSTONES_DDL = "post_id string, upto timestamp_ntz"


def read_tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    """``(_gone, _upto)``: deleted ids and the ingest time up to which their rows are gone."""
    try:
        rows = spark.read.schema(TOMBSTONES_DDL).option("recursiveFileLookup", "true").parquet(
            f"{path}/_tombstones")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy(F.col("post_id").alias("_gone")).agg(F.max("upto").alias("_upto"))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return current_posts(read_versions(spark, path))


def register_views(spark: SparkSession, path: str) -> None:
    read_versions(spark, path).createOrReplaceTempView("posts")
    read_current(spark, path).createOrReplaceTempView("posts_current")


def _replace_days(
    spark: SparkSession, path: str, kept: DataFrame, days: list, by_range: bool = False
) -> None:
    """Write the kept rows of the given days in place of what is stored for them.

    A dynamic overwrite collects its output beside the table and swaps whole days when the job
    commits, so the rows may be read from the days they replace.
    """
    left = {row["day"] for row in kept.select("day").distinct().collect()}
    (
        _laid_out(kept, by_range)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**_WRITE_OPTIONS)
        .partitionBy("day")
        .parquet(path)
    )
    # The overwrite leaves a day alone that lost all its rows, so drop those folders.
    for day in days:
        if day not in left:
            _remove(spark, f"{path}/day={day.isoformat()}")


def delete_posts(spark: SparkSession, path: str, deleted: DataFrame, label: str | None = None) -> int:
    """Hide all rows of the listed ids that are stored now; the number of ids that had any.

    Only a tombstone per id is written, in a folder that scans of the posts pass over. Rows of an id
    that arrive later are visible again. The rows themselves leave when their days are purged. A
    ``label`` names the folder of these tombstones: once it is complete, a call that repeats the label
    changes nothing, so a delete that is tried again does not reach rows that came after it.
    """
    folder = f"{path}/_tombstones/{label or uuid.uuid4().hex}"
    if label and _exists(spark, f"{folder}/_SUCCESS"):
        return 0
    _remove(spark, folder)
    stored = read_versions(spark, path).select("post_id", "ingested_at")
    ids = deleted.select("post_id").distinct()
    gone = stored.join(ids, "post_id", "left_semi").groupBy("post_id").agg(
        F.max("ingested_at").alias("upto")
    )
    fresh = fresh_dir(spark, "gone")
    gone.write.parquet(fresh)
    rows = spark.read.schema(TOMBSTONES_DDL).parquet(fresh)
    found = rows.count()
    if found or label:
        rows.coalesce(1 + found // 1_000_000).write.parquet(folder)
    return found


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def _remove(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def purge_days(spark: SparkSession, path: str, days: list) -> None:
    """Rewrite the given days without the rows that tombstones hide."""
    _replace_days(spark, path, read_versions(spark, path).filter(F.col("day").isin(days)), days)


def compact_days(spark: SparkSession, path: str, days: list) -> None:
    """Keep only the current visible versions of the given days, laid out by ranges of ids.

    Nothing may be appended to these days meanwhile.
    """
    stored = read_versions(spark, path).filter(F.col("day").isin(days))
    _replace_days(spark, path, current_posts(stored), days, by_range=True)
    marks = _file_marks(spark, path).filter(F.col("day").isin(days))
    marks.coalesce(1).write.mode("append").parquet(f"{path}/_compacted")


MARKS_DDL = "day date, newest timestamp, files bigint"


def _file_marks(spark: SparkSession, path: str) -> DataFrame:
    """Per day, the number of its files and the time of the newest; no column of the posts is read."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    return rows.groupBy("day").agg(
        F.max("_metadata.file_modification_time").alias("newest"),
        F.count_distinct("_metadata.file_path").alias("files"),
    )


def settled_days(spark: SparkSession, path: str) -> Settled:
    """Days that have not changed since they were compacted, for statistics that skip comparing.

    A day is unchanged while it has the files that it had then. There is one row per calendar day.
    """
    now = _file_marks(spark, path)
    try:
        marks = spark.read.schema(MARKS_DDL).parquet(f"{path}/_compacted")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Settled(())
    same = now.join(marks.withColumn("same", F.lit(True)).distinct(), ["day", "newest", "files"], "left")
    rows = same.select("day", F.coalesce("same", F.lit(False)).alias("same")).collect()
    return Settled(tuple(sorted(row["day"] for row in rows if row["same"])),
                   not all(row["same"] for row in rows))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
