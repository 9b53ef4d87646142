"""Deterministic synthetic posts: every column is a function of one row number."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.records import ntz, to_millis
from postwatch.functions.scoring import level_of
from postwatch.schema import POST_TYPES, Thresholds

# --- fixed values --------------------------------------------------------------------------------
MAX_ROWS = 1_000_000_000
AUTHORS = 100_000
YEAR_SECONDS = 31_536_000
SAMPLE_IP, SAMPLE_DOMAIN, SAMPLE_URL = "203.0.113.42", "malware.example", "https://malware.example"
SAMPLE_CVE, SAMPLE_TECHNIQUE, SAMPLE_ACTOR = "CVE-2026-4242", "T1059.001", "APT42"
SYNTHETIC_REASON, SYNTHETIC_VERSION = "synthetic_benchmark_fixture", "synthetic-1.0.0"
# -------------------------------------------------------------------------------------------------

# Six texts of our own: two with indicators, one campaign report, one advisory, two harmless.
TEMPLATES = (
    "Exploit traffic for CVE-2026-4242 comes from 203.0.113.42 and calls home to malware.example.",
    "Fidye yazılımı kampanyası hxxps://malware[.]example adresinden yayılıyor.",
    "APT42 campaign pairs T1059.001 with phishing infrastructure aimed at credential theft.",
    "Advisory lists indicators and fixes for a remote code execution flaw.",
    "Maintainers shipped a small release with better documentation.",
    "Topluluk hafta sonu güneşli bir parkta buluşuyor.",
)


def synthetic_rows(
    numbers: DataFrame, as_of: datetime, templates: Sequence[str] = TEMPLATES
) -> DataFrame:
    """Stored posts from a frame with a ``number`` column; no shuffle."""
    number = F.col("number")
    kind = number % 6
    score = (number % 101).cast("int")

    def some(condition: Column, *values: str) -> Column:
        listed = F.array(*[F.lit(value) for value in values])
        return F.when(condition, listed).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    now = to_millis(ntz(as_of))
    body = F.element_at(F.array(*[F.lit(text) for text in templates]), (kind + 1).cast("int"))
    author = (number % AUTHORS).cast("string")
    values = {
        "source_type": F.lit("synthetic"),
        "post_id": F.concat(F.lit("9"), F.lpad(number.cast("string"), 19, "0")),
        "author_id": author,
        "conversation_id": number.cast("string"),
        "text": body,
        "normalized_text": F.lower(body),
        "lang": F.when(number % 2 == 0, "en").otherwise("tr"),
        "created_at": F.timestamp_add("SECOND", -(number % YEAR_SECONDS), now),
        "ingested_at": now,
        "username": F.concat(F.lit("synthetic_"), author),
        "display_name": F.lit("Synthetic Fixture"),
        "author_verified": F.lit(False),
        "author_protected": F.lit(False),
        "reply_count": number % 50,
        "repost_count": number % 20,
        "quote_count": number % 7,
        "like_count": number % 500,
        "bookmark_count": number % 10,
        "impression_count": number % 10_000,
        "cti_score": score,
        "cti_level": level_of(score, Thresholds()),
        "cti_rule_score": score,
        "cti_semantic_score": score,
        "cti_scoring_mode": F.lit("synthetic"),
        "cti_categories": some(number % 3 == 0, "vulnerability", "ioc_sharing"),
        "cti_reasons": F.array(F.lit(SYNTHETIC_REASON)),
        "ioc_ipv4": some(kind == 0, SAMPLE_IP),
        "ioc_domains": some(kind.isin(0, 1), SAMPLE_DOMAIN),
        "ioc_urls": some(kind == 1, SAMPLE_URL),
        "ioc_cves": some(kind == 0, SAMPLE_CVE),
        "ioc_attack_techniques": some(kind == 2, SAMPLE_TECHNIQUE),
        "ioc_threat_actors": some(kind == 2, SAMPLE_ACTOR),
        "scorer_version": F.lit(SYNTHETIC_VERSION),
        "model_revision": F.lit(""),
        "content_version": F.lit(1),
        "source_updated_at": now,
        "compliance_checked_at": now,
    }
    rows = numbers.select(
        *[values.get(name, none).cast(kind_).alias(name) for name, kind_ in POST_TYPES.items()]
    )
    return rows.withColumn("day", F.to_date("created_at"))


def synthetic_posts(
    spark: SparkSession, rows: int = 1_000_000, as_of: datetime | None = None
) -> DataFrame:
    if not 1 <= rows <= MAX_ROWS:
        raise ValueError(f"rows must be between 1 and {MAX_ROWS}")
    numbers = spark.range(rows).withColumnRenamed("id", "number")
    return synthetic_rows(numbers, as_of or datetime(2026, 1, 31))
