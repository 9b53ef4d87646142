"""Parsing of raw records: counters, ids, entities, timestamps."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwatch.functions.text import strip

# --- fixed values --------------------------------------------------------------------------------
SUFFIX_FACTORS = {"K": 1_000, "M": 1_000_000, "B": 1_000_000_000}
STATUS_PATH = r"/status/([0-9]+)"
EXPANDING_RELATIONS = ("retweeted", "quoted")
UNKNOWN_LANGUAGE = "und"
# -------------------------------------------------------------------------------------------------


def parse_metric(label: Column) -> Column:
    """Counter label such as ``1,234 Replies`` or ``1.2K Reposts`` to a whole number.

    The suffix must end at a word boundary, so the first letter of a following word is no factor.
    """
    bare = F.replace(label, F.lit(","), F.lit(""))
    pattern = r"(?i)([0-9.]+)(?:\s*([KMB])\b)?"
    number = F.regexp_extract(bare, pattern, 1).try_cast("double")
    suffix = F.upper(F.regexp_extract(bare, pattern, 2))
    factor = F.lit(1)
    for letter, size in SUFFIX_FACTORS.items():
        factor = F.when(suffix == letter, F.lit(size)).otherwise(factor)
    return F.coalesce((number * factor).try_cast("bigint"), F.lit(0).cast("bigint"))


def numeric_text(value: Column) -> Column:
    """The trimmed text where it is digits only, else null."""
    trimmed = strip(value)
    return F.when(trimmed.rlike("^[0-9]+$"), trimmed)


def extract_post_id(post_id: Column, permalink: Column) -> Column:
    from_link = F.nullif(F.regexp_extract(permalink, STATUS_PATH, 1), F.lit(""))
    return F.coalesce(numeric_text(post_id), from_link)


def parse_utc(value: Column) -> Column:
    """ISO-8601 text to UTC wall clock; text without a zone is taken as UTC, bad text is null."""
    zoned = value.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$") & value.contains(":")
    date_only = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    spelled = (
        F.when(zoned, value)
        .when(date_only, F.concat(value, F.lit("T00:00:00Z")))
        .otherwise(F.concat(value, F.lit("Z")))
    )
    return utc_wall_clock(F.try_to_timestamp(spelled))


def ntz(moment: datetime) -> Column:
    """Driver-side time as a UTC wall clock literal."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(UTC).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_wall_clock(instant: Column) -> Column:
    """Instant to UTC wall clock, whatever the session time zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ntz(datetime(1970, 1, 1)))


def to_millis(moment: Column) -> Column:
    """Cut a wall clock to milliseconds (truncation by unit would go through the session zone)."""
    micros = (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("int")
    return F.timestamp_add("MICROSECOND", -(micros % 1_000), moment)


def is_stale(raw: Column, as_of: Column, hours: int = 24) -> Column:
    """True where the time is missing, unreadable or older than the given hours."""
    limit = F.timestamp_add("HOUR", F.lit(-hours), as_of)
    return F.coalesce(parse_utc(F.nullif(raw, F.lit(""))) < limit, F.lit(True))


def entity_urls(entities: Column) -> Column:
    chosen = F.transform(
        entities["urls"],
        lambda item: F.coalesce(
            F.nullif(item["expanded_url"], F.lit("")), F.nullif(item["url"], F.lit(""))
        ),
    )
    return compact(chosen)


def entity_names(items: Column, name: str) -> Column:
    values = F.transform(items, lambda item: F.nullif(F.lower(item[name]), F.lit("")))
    return compact(values)


def compact(values: Column) -> Column:
    return F.coalesce(F.array_compact(values), F.array().cast("array<string>"))


def counter(metrics: Column, name: str) -> Column:
    return F.coalesce(metrics[name], F.lit(0).cast("bigint"))


def content_version(edits: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.size(edits), F.lit(1)))
