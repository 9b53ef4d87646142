"""Delete events in, post ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.operators.stats import distinct_live_ids

EVENT_DDL = "action string, id string"


def delete_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct ids to delete from JSON lines; unreadable lines and other actions are skipped."""
    event = F.from_json(value, EVENT_DDL, {"mode": "PERMISSIVE"})
    return (
        lines.select(event.alias("_event"))
        .filter((F.col("_event.action") == "delete") & (F.length("_event.id") > 0))
        .select(F.col("_event.id").alias("post_id"))
        .distinct()
    )


def read_delete_events(spark, path: str) -> DataFrame:
    return delete_events(spark.read.text(path))


def export_ids(posts: DataFrame, path: str, versioned: bool = False) -> None:
    """Ids of live posts, one per line."""
    distinct_live_ids(posts, versioned).select("post_id").write.mode("overwrite").text(path)
