"""Small tables with what real ones hold: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
BODY = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

ROWS = [
    (1, f"The first line of all.\nshared line here\n{BODY}", "en"),
    (2, f"  Shared LINE here \t\nand more of the same, {PASSAGE} at the end", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t\n ", "en"),
    (6, f"The first line of all.\nshared line here\n{BODY}", "de"),
    (7, BODY.replace("word30", "Élan vital 中文 😀"), "fr"),
    (8, BODY + " tail", "fr"),
    (9, "a b c", "en"),
    (10, "A, b: C!", "en"),
    (10, "A, b: C!", "en"),
    (11, "12345 !!! ...", "en"),
    (12, LONG, "en"),
    (12, BODY + " tail", "en"),
    (None, "shared line here", "en"),
    (None, None, None),
    (13, "x" * 3000 + "'ll don't  it's <|endoftext|> aaaaaaa", "en"),
    (14, f"{PASSAGE}", "en"),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words int, "
          "lost string, doc_key string, hits string, node string, bands string")


def frame(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(i, text, lang, "src", None if text is None else len(text), -1, "l", None, "h", None, "b")
         for i, text, lang in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def key(row):
    """For sorting rows with nulls."""
    return [(x is None, str(x)) for x in row]
