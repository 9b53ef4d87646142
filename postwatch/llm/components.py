"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.session import fresh_dir


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``(a, b)``: the smallest node of its component.

    Each turn takes the smallest label among neighbours and then that label's label, so distances
    about double. Turns are written to the shared folder, which cuts lineage; nothing is collected.
    """
    spark = edges.sparkSession
    path = fresh_dir(spark, "components")
    (edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
     .distinct().write.parquet(f"{path}/edges"))
    both = spark.read.parquet(f"{path}/edges")
    label = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label"))
    turn = 0
    while True:
        label.write.parquet(f"{path}/label-{turn}")
        held = spark.read.parquet(f"{path}/label-{turn}")
        if turn and held.filter(F.col("label") != F.col("old")).isEmpty():
            return held.select("node", "label")
        around = both.join(held.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("least"))
        held.join(around, held["node"] == around["a"]).select(
            "node", F.least("label", "least").alias("label"), F.col("label").alias("old")
        ).write.parquet(f"{path}/near-{turn}")
        near = spark.read.parquet(f"{path}/near-{turn}")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("top"))
        label = near.join(up, "label").select("node", F.col("top").alias("label"), "old")
        turn += 1
