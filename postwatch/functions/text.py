"""Text functions: folding, defanging, tokens, query terms and highlight ranges."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values --------------------------------------------------------------------------------
# Order matters and matching is case-sensitive.
REFANG = (
    ("hxxps://", "https://"),
    ("hxxp://", "http://"),
    ("[.]", "."),
    ("(.)", "."),
    ("[:]", ":"),
    ("[@]", "@"),
)
# Tokens end at every ASCII character that is no letter or digit.
SEPARATOR = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"
MAX_HIGHLIGHTS = 20
BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# -------------------------------------------------------------------------------------------------

# Characters for which compatibility normalization changes nothing and case folding equals lower
# casing (but for the sharp s): ASCII, Latin-1 without its compatibility forms, Latin Extended-A
# without the ligatures and the long s.
_PLAIN = (
    r"\A[\x00-\x7f -§©«-®°±¶·»¿-ı"
    r"Ĵ-ľŁ-ňŊ-ž]*\z"
)
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def _fold(value: str) -> str:
    return unicodedata.normalize("NFKC", value).casefold()


@F.pandas_udf(T.StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    return values.map(_fold, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """Compatibility form, case fold, single blanks, no outer blanks.

    Spark has no Unicode normalization, so rows with characters outside the plain set go through
    an Arrow UDF; for all others it receives and gives a null and the JVM does the work, so that
    the characters are looked at once.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    plain = ascii_only | text.rlike(_PLAIN)
    folded = F.coalesce(
        _fold_unicode(F.when(~plain, text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    )
    return F.trim(F.regexp_replace(folded, _BLANKS, " "))


def strip(text: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def refang_text(text: Column) -> Column:
    for written, meant in REFANG:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def tokenize(normalized: Column) -> Column:
    return F.filter(F.split(normalized, SEPARATOR + "+"), lambda token: token != "")


def query_terms(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda term: term != "")


def normalize_value(value: str) -> str:
    """Driver-side twin of :func:`normalize_text` for one query string."""
    return re.sub(r"\s+", " ", _fold(value)).strip()


def split_terms(query: str) -> list[str]:
    return [term for term in normalize_value(query).split(" ") if term]


def search_tokens(query: str, verbatim: bool = False) -> list[str]:
    """Needles of a token search.

    Stored tokens end at every ASCII non-alphanumeric character, while query terms end at blanks
    only, so by default the terms are cut the same way as the text; otherwise a term such as a
    hyphenated identifier could never match.
    """
    terms = split_terms(query)
    if not verbatim:
        terms = [token for term in terms for token in re.split(SEPARATOR, term) if token]
    if not terms:
        raise ValueError("the query has no searchable token")
    return list(dict.fromkeys(terms)) if verbatim else terms


def has_tokens_in_row(normalized: Column, tokens: list[str]) -> Column:
    """True where the tokens occur next to each other.

    Equal to comparing token lists, without building one per row: a substring test (a plain byte
    scan) rejects most rows, and only the rest see the boundary-checked pattern.
    """
    contained = F.lit(True)
    for token in dict.fromkeys(tokens):
        contained = contained & normalized.contains(token)
    if any(re.search(SEPARATOR, token) for token in tokens):
        return F.lit(False)  # no stored token has such a character
    joined = (SEPARATOR + "+").join(rf"\Q{token}\E" for token in tokens)
    return contained & normalized.rlike(rf"(?:\A|{SEPARATOR}){joined}(?:\z|{SEPARATOR})")


def clean_handle(handle: Column) -> Column:
    return F.lower(F.regexp_replace(handle, "^@+", ""))


def highlight_offsets(text: Column, query: str) -> Column:
    """Character ranges of query terms in the original text, at most twenty, sorted by start.

    Folding can lengthen a character, so every folded character remembers its source position;
    that needs Unicode tables Spark lacks, hence the Arrow UDF.
    """
    terms = split_terms(query)

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: _ranges(value, terms), na_action="ignore")

    return find(text)


def _ranges(text: str, terms: list[str]) -> list[dict[str, int]]:
    pieces = [_fold(character) for character in text]
    origin = [at for at, piece in enumerate(pieces) for _ in piece]
    folded = "".join(pieces)
    found: list[dict[str, int]] = []
    for term in terms:
        for hit in re.finditer(re.escape(term), folded):
            if len(found) == MAX_HIGHLIGHTS:
                break
            found.append({"start": origin[hit.start()], "end": origin[hit.end() - 1] + 1})
    return sorted(found, key=lambda span: span["start"])


def merge_highlights(spans: Column) -> Column:
    """Join ranges that touch or overlap; expects them sorted by start."""

    def step(merged: Column, span: Column) -> Column:
        last = F.element_at(merged, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        extends = (F.size(merged) > 0) & (span["start"] <= F.try_element_at(merged, F.lit(-1))["end"])
        return F.when(
            extends,
            F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(joined)),
        ).otherwise(F.concat(merged, F.array(span)))

    empty = F.array().cast("array<struct<start: int, end: int>>")
    return F.aggregate(spans, empty, step)
