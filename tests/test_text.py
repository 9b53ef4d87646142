from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postwatch.functions import text
from postwatch.schema import SearchSpec


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_normalize_folds_and_collapses(spark):
    assert one(spark, text.normalize_text(F.lit(" \tİZMİR\nUNC-77  "))) == "i̇zmi̇r unc-77"


def test_normalize_equals_unicode_rules_on_random_text(spark):
    rng = random.Random(7)
    ranges = [(0x20, 0x7E), (0x00, 0x1F), (0x80, 0x17F), (0x180, 0x24F), (0x300, 0x36F),
              (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x3000, 0x30FF), (0xFB00, 0xFB06),
              (0xFF00, 0xFF5E)]
    values = []
    for _ in range(3000):
        low, high = rng.choice(ranges)
        values.append("".join(
            chr(rng.randint(low, high)) if rng.random() < 0.5 else chr(rng.randint(0x20, 0x7E))
            for _ in range(rng.randint(0, 12))
        ))
    values += [chr(code) for code in range(1, 0x250)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", text.normalize_text(F.col("v")).alias("n")
    ).collect()
    for row in rows:
        folded = unicodedata.normalize("NFKC", row["v"]).casefold()
        assert row["n"] == " ".join(folded.split()), repr(row["v"])


def test_refang_is_ordered_and_case_sensitive(spark):
    assert one(spark, text.refang_text(F.lit("hxxps://drop[.]test/kit a(.)b c[:]d e[@]f"))) == (
        "https://drop.test/kit a.b c:d e@f"
    )
    assert one(spark, text.refang_text(F.lit("hXXp://x[dot]y"))) == "hXXp://x[dot]y"


def test_query_terms(spark):
    assert text.split_terms(" botnet   takedown ") == ["botnet", "takedown"]
    assert one(spark, text.query_terms(F.lit(" botnet   takedown "))) == ["botnet", "takedown"]
    assert text.split_terms("loader' OR 2=2 --") == ["loader'", "or", "2=2", "--"]


def test_search_tokens_are_cut_like_the_text():
    assert text.search_tokens("CVE-2031-10001 kit") == ["cve", "2031", "10001", "kit"]
    assert text.search_tokens("CVE-2031-10001", verbatim=True) == ["cve-2031-10001"]
    with pytest.raises(ValueError):
        text.search_tokens("---")


def test_token_predicates_equal_token_lists(spark):
    rng = random.Random(3)
    words = ["apt", "apt42", "remote", "code", "é", "naïve", "42", "x"]
    separators = [" ", "-", ".", "/", "--", "_", "\t"]
    rows = []
    for _ in range(500):
        parts = [rng.choice(words) + rng.choice(separators) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice(["", "-", " "]) + "".join(parts),))
    df = spark.createDataFrame(rows, "n string")
    for needle in (["apt"], ["remote", "code"], ["é"], ["42", "x", "apt"], ["naïve", "apt42"]):
        got = df.select(
            text.tokenize(F.col("n")).alias("tokens"),
            text.has_tokens_in_row(F.col("n"), needle).alias("row"),
        ).collect()
        for row in got:
            padded = " " + " ".join(row["tokens"]) + " "
            assert row["row"] == (" " + " ".join(needle) + " " in padded)
    assert df.filter(text.has_tokens_in_row(F.col("n"), ["cve-1"])).count() == 0


def test_tokens_keep_non_ascii_letters(spark):
    assert one(spark, text.tokenize(F.lit("naïve-é_x 1.2"))) == ["naïve", "é", "x", "1", "2"]


@pytest.mark.parametrize(
    ("value", "query", "expected"),
    [
        ("watch APT and then the APT again", "Apt", [(6, 9), (23, 26)]),
        ("on İzmir report", "İZMIR", [(3, 8)]),
        ("Straße STRASSE", "strasse", [(0, 6), (7, 14)]),
        ("x" * 30, "x", [(n, n + 1) for n in range(20)]),
        ("aaa", "aa", [(0, 2)]),
        ("b a", "a b", [(0, 1), (2, 3)]),
    ],
)
def test_highlights(spark, value, query, expected):
    spans = one(spark, text.highlight_offsets(F.lit(value), query))
    assert [(span["start"], span["end"]) for span in spans] == expected


def test_merge_highlights(spark):
    spans = F.expr(
        "array(named_struct('start',1,'end',3), named_struct('start',3,'end',5),"
        " named_struct('start',4,'end',4), named_struct('start',7,'end',8))"
    )
    merged = one(spark, text.merge_highlights(spans))
    assert [(span["start"], span["end"]) for span in merged] == [(1, 5), (7, 8)]


def test_clean_handle(spark):
    assert one(spark, text.clean_handle(F.lit("@@Alice"))) == "alice"


def test_strip_equals_python(spark):
    value = "\x1c　 a b\t\x85\n"
    assert one(spark, text.strip(F.lit(value))) == value.strip() == "a b"


@pytest.mark.parametrize(
    "wrong",
    [
        {"query": "ab"}, {"query": "a b c d e f"}, {"query": "abc", "limit": 101},
        {"query": "abc", "limit": 0}, {"query": "abc", "mode": "near"},
        {"query": "abc", "sort": "oldest"}, {"query": "abc", "level": "severe"},
        {"query": "abc", "ioc_type": "mac"}, {"query": "abc", "lang": "e"},
        {"query": "abc", "min_score": 101}, {"query": "abc", "author": "x" * 65},
        {"query": "x" * 257},
    ],
)
def test_bad_search_parameters_raise(wrong):
    with pytest.raises(ValueError):
        SearchSpec(**wrong)


def test_separator_covers_exactly_ascii_non_alphanumerics():
    for code in range(128):
        matched = re.fullmatch(text.SEPARATOR, chr(code)) is not None
        assert matched == (not chr(code).isalnum())
