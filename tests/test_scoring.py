from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postwatch.functions import scoring, vectors
from postwatch.operators import ingest
from postwatch.schema import METRIC_COLUMNS, Settings, Thresholds, parse_handles


def fixed_scorer(score, categories=()):
    def add(df):
        return df.withColumns({
            "semantic_score": F.lit(score).cast("double"),
            "semantic_categories": F.array(*[F.lit(c) for c in categories]).cast("array<string>"),
            "model_revision": F.lit("r-7"),
        })

    return add


def assess(spark, text, username="", likes=0, scorer=scoring.null_scorer, **settings):
    df = spark.createDataFrame([(text, username)], "text string, username string")
    for name in METRIC_COLUMNS.values():
        df = df.withColumn(name, F.lit(likes if name == "like_count" else 0).cast("bigint"))
    return ingest.enrich(df, Settings(**settings), scorer).first()


def test_hybrid_score_is_explainable(spark):
    row = assess(
        spark, "Fresh exploit for CVE-2031-10001 served by hxxp://drop[.]test", "desk_one", 1000,
        fixed_scorer(80.0, ["vulnerability"]), trusted_handles=("desk_one",),
    )
    assert (row["cti_rule_score"], row["cti_score"]) == (37, 52)
    assert row["cti_scoring_mode"] == "hybrid"
    assert row["model_revision"] == "r-7"
    assert row["cti_level"] == "medium"
    assert row["cti_categories"] == ["ioc_sharing", "vulnerability"]
    assert row["cti_reasons"] == [
        "ioc_evidence:10", "cve_attack_reference:8", "threat_context:6", "trusted_source:10",
        "engagement_signal:3", "semantic_relevance:80.0",
    ]


def test_missing_model_is_named(spark):
    row = assess(spark, "plain maintenance notes")
    assert row["cti_scoring_mode"] == "rules_only"
    assert row["cti_semantic_score"] is None and row["model_revision"] is None
    assert row["cti_reasons"] == ["semantic_model:unavailable"]
    assert (row["cti_score"], row["cti_level"], row["cti_categories"]) == (0, "low", [])


def test_stand_ins_for_a_missing_model(spark):
    df = spark.createDataFrame([(None, None)], "cti_semantic_score double, model_revision string")
    flat = df.select(F.coalesce("cti_semantic_score", F.lit(-1.0)).alias("s")).first()
    assert flat["s"] == -1.0


def test_caps(spark):
    text = " ".join(f"{n:032x}" for n in range(9)) + " " + " ".join(
        f"CVE-2026-{n}" for n in range(1000, 1010)
    ) + " malware phishing ransomware exploit campaign"
    row = assess(spark, text, likes=10**7)
    assert row["cti_rule_score"] == 45 + 20 + 20 + 5
    assert row["cti_level"] == "critical"


def test_one_decimal_equals_python(spark):
    rng = random.Random(1)
    values = [n / 100 for n in range(10_001)] + [rng.random() * 100 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", scoring.one_decimal(F.col("v")).alias("s")
    ).collect()
    assert all(row["s"] == f"{row['v']:.1f}" for row in rows)


def test_blend_rounds_half_to_even(spark):
    pairs = [(r, s / 4) for r in range(0, 101, 5) for s in range(0, 401, 7)]
    rows = spark.createDataFrame(pairs, "r int, s double").select(
        "r", "s", scoring.hybrid_score(F.col("r"), F.col("s")).alias("score")
    ).collect()
    assert all(row["score"] == round(0.65 * row["r"] + 0.35 * row["s"]) for row in rows)


@pytest.mark.parametrize("limits", [(60, 50, 90), (40, 90, 85), (0, 50, 60), (40, 70, 101)])
def test_thresholds_must_rise(limits):
    with pytest.raises(ValueError):
        Thresholds(*limits)


def test_handles_are_cleaned():
    assert parse_handles("@Sample_Desk, feed_two, ,") == ("feed_two", "sample_desk")


def test_vector_scorer(spark):
    prototypes = vectors.Prototypes(("a", "a", "b"), ((1.0, 0.0), (0.6, 0.8), (0.0, 1.0)))
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 2.0])],
        "n int, embedding array<float>",
    )
    rows = vectors.VectorScorer(prototypes, "r")(df).orderBy("n").collect()
    assert [row["semantic_score"] for row in rows] == [100.0, 0.0, None, 0.0, 100.0]
    assert [row["semantic_categories"] for row in rows] == [["a"], [], None, [], ["a", "b"]]


def test_too_many_prototypes_raise(spark):
    many = spark.range(vectors.MAX_PROTOTYPES + 1).select(
        F.col("id").cast("string").alias("category"), F.array(F.lit(1.0)).alias("vector")
    )
    with pytest.raises(ValueError):
        vectors.Prototypes.read(many)


def test_mean_pool_of_masked_tokens(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 0.0], 1), (1, [0.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)],
        "k int, v array<double>, m int",
    )
    rows = vectors.mean_pool(df, ["k"], "v", "m", 2).orderBy("k").collect()
    assert [round(x, 9) for x in rows[0]["vector"]] == [0.6, 0.8]
    assert rows[1]["vector"] == [0.0, 0.0]
