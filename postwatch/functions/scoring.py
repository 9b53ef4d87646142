"""Explainable 0-100 score: rule parts, optional semantic part, level, categories, reasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.text import clean_handle
from postwatch.schema import METRIC_COLUMNS, Settings, Thresholds

# --- fixed values: lexicon, weights, caps and reason names ---------------------------------------
THREAT_TERMS = {
    "malware": ("malware", "zararlı yazılım", "trojan", "backdoor", "stealer", "botnet"),
    "phishing": ("phishing", "oltalama", "credential theft", "kimlik avı"),
    "ransomware": ("ransomware", "fidye yazılımı", "encryptor", "extortion"),
    "vulnerability": ("vulnerability", "zafiyet", "exploit", "zero-day", "0day", "rce"),
    "apt_campaign": ("threat actor", "campaign", "apt", "tehdit aktörü", "ioc", "indicator"),
}
HASH_LISTS = ("md5", "sha1", "sha256", "sha512")
NETWORK_LISTS = ("ipv4", "ipv6", "domains", "urls")
SUPPORTING_LISTS = ("emails", "filenames", "threat_actors")
HASH_POINTS, NETWORK_POINTS, SUPPORTING_POINTS, INDICATOR_CAP = 15, 5, 3, 45
CVE_POINTS, ATTACK_POINTS, REFERENCE_CAP = 8, 6, 20
CONTEXT_POINTS, CONTEXT_CAP = 6, 20
TRUST_POINTS = 10
ENGAGEMENT_CAP = 5
SCORE_CAP = 100
RULE_SHARE, SEMANTIC_SHARE = 0.65, 0.35
# -------------------------------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]
"""Adds ``semantic_score`` (double or null), ``semantic_categories`` and ``model_revision``."""


def _strings(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<string>")


def _lengths(lists: tuple[str, ...]) -> Column:
    return reduce(lambda total, name: total + F.size(f"ioc_{name}"), lists, F.lit(0))


def indicator_score() -> Column:
    points = (
        _lengths(HASH_LISTS) * HASH_POINTS
        + _lengths(NETWORK_LISTS) * NETWORK_POINTS
        + _lengths(SUPPORTING_LISTS) * SUPPORTING_POINTS
    )
    return F.least(F.lit(INDICATOR_CAP), points)


def reference_score() -> Column:
    points = F.size("ioc_cves") * CVE_POINTS + F.size("ioc_attack_techniques") * ATTACK_POINTS
    return F.least(F.lit(REFERENCE_CAP), points)


def matched_contexts(normalized: Column) -> Column:
    """Lexicon categories with at least one term anywhere in the text, also inside words."""
    flags = [
        F.when(
            reduce(lambda hit, term: hit | normalized.contains(term), terms[1:],
                   normalized.contains(terms[0])),
            F.lit(category),
        )
        for category, terms in THREAT_TERMS.items()
    ]
    return F.array_compact(F.array(*flags))


def context_score(contexts: Column) -> Column:
    return F.least(F.lit(CONTEXT_CAP), F.size(contexts) * CONTEXT_POINTS)


def trust_score(username: Column, settings: Settings) -> Column:
    if not settings.trusted_handles:
        return F.lit(0)
    return F.when(
        clean_handle(username).isin(*settings.trusted_handles), F.lit(TRUST_POINTS)
    ).otherwise(F.lit(0))


def engagement_score(*counts: Column) -> Column:
    total = reduce(
        lambda acc, count: acc + F.greatest(F.lit(0), F.coalesce(count, F.lit(0))),
        counts,
        F.lit(0).cast("bigint"),
    )
    return F.least(F.lit(ENGAGEMENT_CAP), F.log10(total + 1).cast("int"))


def hybrid_score(rule: Column, semantic: Column) -> Column:
    """Half-to-even blend, or the rule score where no model answered."""
    blend = F.bround(F.lit(RULE_SHARE) * rule + F.lit(SEMANTIC_SHARE) * semantic).cast("int")
    return F.coalesce(blend, rule)


def level_of(score: Column, thresholds: Thresholds) -> Column:
    return (
        F.when(score >= thresholds.critical, "critical")
        .when(score >= thresholds.high, "high")
        .when(score >= thresholds.medium, "medium")
        .otherwise("low")
    )


def one_decimal(value: Column) -> Column:
    """A value from 0 to 100 with one decimal, rounded by its exact binary value, ties to even.

    Formatting in the JVM rounds the shortest decimal spelling instead (1.65 would give 1.7), so
    the fraction is taken as a whole number of 2**-60 and compared with the midpoint.
    """
    whole = F.floor(value)
    fifths = ((value - whole) * float(2**60)).cast("bigint") * 5
    tenths = F.shiftright(fifths, 59)
    midpoint = (tenths * 2 + 1) * (2**58)
    up = (fifths > midpoint) | ((fifths == midpoint) & (tenths % 2 == 1))
    total = whole * 10 + tenths + up.cast("bigint")
    return F.concat((total / 10).cast("bigint").cast("string"), F.lit("."),
                    (total % 10).cast("string"))


def reasons(semantic: Column) -> Column:
    def part(name: str, column: str) -> Column:
        score = F.col(column)
        return F.when(score > 0, F.concat(F.lit(f"{name}:"), score.cast("string")))

    model = F.when(semantic.isNull(), F.lit("semantic_model:unavailable")).otherwise(
        F.concat(F.lit("semantic_relevance:"), one_decimal(semantic))
    )
    return F.array_compact(
        F.array(
            part("ioc_evidence", "_indicator_score"),
            part("cve_attack_reference", "_reference_score"),
            part("threat_context", "_context_score"),
            part("trusted_source", "_trust_score"),
            part("engagement_signal", "_engagement_score"),
            model,
        )
    )


def null_scorer(df: DataFrame) -> DataFrame:
    """No model: scores stay rule-only and say so."""
    return df.withColumns(
        {
            "semantic_score": F.lit(None).cast("double"),
            "semantic_categories": _strings(),
            "model_revision": F.lit(None).cast("string"),
        }
    )


PART_COLUMNS = ("_indicator_score", "_reference_score", "_context_score", "_trust_score",
                "_engagement_score")


def with_rule_parts(df: DataFrame, settings: Settings) -> DataFrame:
    """Add the five rule parts and the matched contexts; needs ``ioc_*`` and ``normalized_text``."""
    counts = [F.col(name) for name in METRIC_COLUMNS.values()]
    return df.withColumn("_contexts", matched_contexts(F.col("normalized_text"))).withColumns(
        {
            "_indicator_score": indicator_score(),
            "_reference_score": reference_score(),
            "_context_score": context_score(F.col("_contexts")),
            "_trust_score": trust_score(F.col("username"), settings),
            "_engagement_score": engagement_score(*counts),
        }
    )


def rule_score() -> Column:
    total = reduce(lambda acc, name: acc + F.col(name), PART_COLUMNS, F.lit(0))
    return F.least(F.lit(SCORE_CAP), total).cast("int")


def with_scores(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Add the ``cti_*`` columns to rows that a scorer has seen and that carry indicators, folded
    text and counters.
    """
    settings = settings or Settings()
    semantic = F.col("semantic_score")
    scored = (
        with_rule_parts(df, settings)
        .withColumn("cti_rule_score", rule_score())
        .withColumn("_final", hybrid_score(F.col("cti_rule_score"), semantic))
    )
    categories = F.array_union(
        F.array_union(
            F.array_compact(
                F.array(
                    F.when(F.col("_indicator_score") > 0, F.lit("ioc_sharing")),
                    F.when(F.col("_reference_score") > 0, F.lit("vulnerability")),
                )
            ),
            F.col("_contexts"),
        ),
        F.coalesce(F.col("semantic_categories"), _strings()),
    )
    return scored.withColumns(
        {
            "cti_score": F.greatest(F.lit(0), F.least(F.lit(SCORE_CAP), F.col("_final"))),
            "cti_level": level_of(F.col("_final"), settings.thresholds),
            "cti_semantic_score": semantic,
            "cti_scoring_mode": F.when(semantic.isNull(), "rules_only").otherwise("hybrid"),
            "cti_categories": F.sort_array(categories),
            "cti_reasons": reasons(semantic),
            "scorer_version": F.lit(settings.scorer_version),
            "model_revision": F.when(semantic.isNotNull(), F.col("model_revision")),
        }
    ).drop("semantic_score", "semantic_categories", "_final", "_contexts", *PART_COLUMNS)
