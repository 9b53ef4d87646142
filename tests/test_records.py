from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postwatch.functions import records
from postwatch.operators import ingest
from postwatch.schema import PAYLOAD_DDL, SCRAPED_DDL
from postwatch.sources import html, pages

AS_OF = datetime(2026, 2, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("label", "value"),
    [("2,345 Replies", 2345), ("3.4K Reposts", 3400), ("5M Views", 5_000_000), ("", 0),
     ("no digits", 0), ("2b views", 2_000_000_000), ("12 Bookmarks", 12), ("4 Mentions", 4),
     ("1.2.3 odd", 0), ("7", 7), ("0.5k", 500)],
)
def test_parse_metric(spark, label, value):
    assert one(spark, records.parse_metric(F.lit(label))) == value


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("2026-01-15T10:00:00.123Z", datetime(2026, 1, 15, 10, 0, 0, 123000)),
        ("2026-01-15T10:00:00+02:00", datetime(2026, 1, 15, 8)),
        ("2026-01-15T10:00:00", datetime(2026, 1, 15, 10)),
        ("2026-01-15", datetime(2026, 1, 15)),
        ("soon", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_utc_ignores_the_session_zone(spark, raw, value, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = records.parse_utc(F.lit(raw)).cast("string")
        got = one(spark, text)
        assert got == (None if value is None else str(value).rstrip("0").rstrip(".")
                       if value.microsecond else str(value))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_millis_are_cut(spark):
    moment = F.lit("1965-03-04 05:06:07.123987").cast("timestamp_ntz")
    assert one(spark, records.to_millis(moment)) == datetime(1965, 3, 4, 5, 6, 7, 123000)


@pytest.mark.parametrize(
    ("raw", "stale"),
    [("", True), ("never", True), ("2026-01-31T12:00:00", False), ("2026-01-31T11:59:59Z", True),
     ("2026-02-01T11:00:00+00:00", False)],
)
def test_staleness(spark, raw, stale):
    assert one(spark, records.is_stale(F.lit(raw), records.ntz(AS_OF))) is stale


def payload(spark, post, author):
    return spark.createDataFrame([(post, author)], PAYLOAD_DDL.replace("\n", " "))


def test_protected_author_is_rejected(spark):
    df = payload(spark, {"id": "8", "text": "sample", "created_at": "2026-01-02T00:00:00Z"},
                 {"protected": True})
    accepted, rejected = ingest.split_rejects(df)
    assert accepted.count() == 0
    assert rejected.first()["reason"] == "protected_author"


@pytest.mark.parametrize(
    ("post", "reason"),
    [({"text": "x"}, "missing_id"), ({"id": "", "text": "x"}, "missing_id"),
     ({"id": "1"}, "missing_text"), ({"id": "1", "text": ""}, "missing_text"),
     ({"id": "1", "text": "x", "created_at": "noon"}, "bad_created_at"), (None, "missing_id")],
)
def test_incomplete_posts_are_rejected(spark, post, reason):
    assert ingest.split_rejects(payload(spark, post, {}))[1].first()["reason"] == reason


def test_payload_becomes_a_post(spark):
    post = {
        "id": "815", "author_id": "4", "text": "CVE-2031-10001 on drop.test",
        "created_at": "2026-01-02T00:00:00Z", "lang": "en",
        "public_metrics": {"like_count": 21, "retweet_count": 5},
        "entities": {"hashtags": [{"tag": "SOC"}, {"tag": ""}, {}],
                     "urls": [{"url": "u", "expanded_url": ""}, {"url": "a", "expanded_url": "b"}]},
        "edit_history_tweet_ids": ["814", "815"],
        "referenced_tweets": [{"type": "replied_to", "id": "9"}, {"type": "quoted"}],
    }
    author = {"id": "4", "username": "Desk_One", "name": "Desk"}
    row = ingest.prepare_posts(payload(spark, post, author), AS_OF).first()
    assert (row["like_count"], row["repost_count"], row["reply_count"]) == (21, 5, 0)
    assert row["hashtags"] == ["soc"] and row["urls"] == ["u", "b"]
    assert row["ioc_cves"] == ["CVE-2031-10001"]
    assert row["username"] == "desk_one" and row["content_version"] == 2
    assert row["referenced_post_ids"] == ["9"]
    assert row["created_at"] == datetime(2026, 1, 2) and row["ingested_at"] == AS_OF
    assert row["cti_semantic_score"] == -1.0 and row["model_revision"] == ""


def test_missing_fields_get_defaults(spark):
    row = ingest.prepare_posts(payload(spark, {"id": "1", "text": "x"}, None), AS_OF).first()
    assert row["created_at"] == AS_OF and row["lang"] == "und" and row["username"] == ""
    assert row["urls"] == row["mentions"] == [] and row["content_version"] == 1


@pytest.mark.parametrize(
    ("relations", "expected"),
    [
        ([("quoted", "a")], "longer text"),
        ([("quoted", "c"), ("retweeted", "a"), ("quoted", "b")], "longer text"),
        ([("replied_to", "a")], "own"), ([("quoted", "c")], "own"), ([("quoted", "zz")], "own"),
    ],
)
def test_first_longest_referenced_text_wins(spark, relations, expected):
    known = {key: {"id": key, "text": text} for key, text in
             {"a": "longer text", "b": "other  text", "c": "abc"}.items()}
    post = {"id": "1", "text": "own", "_referenced_posts": known,
            "referenced_tweets": [{"type": kind, "id": key} for kind, key in relations]}
    row = ingest.flatten_payloads(payload(spark, post, {}), AS_OF).first()
    assert row["text"] == expected
    posts = spark.createDataFrame([("1", "own")], "post_id string, text string")
    links = spark.createDataFrame(
        [("1", at, kind, key) for at, (kind, key) in enumerate(relations)],
        "post_id string, pos int, type string, id string",
    )
    references = spark.createDataFrame(
        [(key, value["text"]) for key, value in known.items()], "id string, text string"
    )
    assert ingest.expand_referenced(posts, links, references).first()["text"] == expected


def scraped(spark, **values):
    fields = spark.createDataFrame([], SCRAPED_DDL).schema.names
    return spark.createDataFrame([tuple(values.get(name) for name in fields)], SCRAPED_DDL)


def test_scraped_row_becomes_a_payload(spark):
    row = pages.scraped_payloads(scraped(
        spark, post_id="70707", text=" note ", lang="", username="@desk_one",
        display_name="Desk", verified=True, reply_label="31 Replies", like_label="58 Likes",
        retweet_label="7 Reposts", impression_label="2.5K Views",
        urls=[{"url": "https://s.test/q", "expanded_url": "https://long.test"}],
        hashtags=["soc", ""], mentions=["@two"], quoted_post_id="606", quoted_text=" older ",
    )).first()
    post, author = row["post"], row["author"]
    assert post["id"] == "70707" and post["text"] == "note" and post["lang"] == "und"
    metrics = post["public_metrics"]
    assert (metrics["reply_count"], metrics["retweet_count"], metrics["like_count"],
            metrics["impression_count"]) == (31, 7, 58, 2500)
    assert [tag["tag"] for tag in post["entities"]["hashtags"]] == ["soc"]
    assert [who["username"] for who in post["entities"]["mentions"]] == ["two"]
    assert [tuple(r) for r in post["referenced_tweets"]] == [("quoted", "606")]
    assert post["_referenced_posts"]["606"]["text"] == "older"
    assert (author["username"], author["name"], author["verified"]) == ("desk_one", "Desk", True)


def test_blank_scraped_text_is_rejected(spark):
    assert pages.scraped_payloads(scraped(spark, post_id="1", text="   ")).count() == 0
    assert pages.scraped_payloads(scraped(spark, post_id="x", text="a")).count() == 0
    found = pages.scraped_payloads(scraped(spark, permalink="/a/status/42?s=1", text="a")).first()
    assert found["post"]["id"] == "42"


def test_page_lookup_takes_the_last_entry_per_id(spark):
    page = """{"data": [{"id": "1", "text": "t", "author_id": "u",
      "referenced_tweets": [{"type": "quoted", "id": "r"}, {"type": "quoted", "id": "gone"}]}, 7],
      "includes": {"users": [{"id": "u", "username": "old"}, {"id": "u", "username": "new"}],
      "tweets": [{"id": "r", "text": "one"}, {"id": "r", "text": "two"}, {"id": "s", "text": "no"}]}}"""
    df = spark.createDataFrame([(page,), ("not json",), ("{}",)], "value string")
    (row,) = pages.page_posts(df).collect()
    assert row["author"]["username"] == "new"
    assert {k: v["text"] for k, v in row["post"]["_referenced_posts"].items()} == {"r": "two"}
    authors = pages.page_authors(df.withColumn("n", F.lit(1)), "n").collect()
    assert [(a["id"], a["username"]) for a in authors] == [("u", "old"), ("u", "new")]


MARKUP = """
<article data-testid="tweet"><div data-testid="User-Name"><a href="/alice"><span>Alice</span></a>
<svg aria-label="Verified account"></svg></div>
<a href="/alice/status/123?x=1"><time datetime="2026-01-15T10:00:00.000Z">now</time></a>
<div data-testid="tweetText" lang="en">Look <a href="/bob">@bob</a> <a href="/hashtag/cti">#cti</a>
<a href="https://t.example/a">link</a><br>end</div>
<button data-testid="reply" aria-label="1,234 Replies"></button>
<div data-testid="like" aria-label="no button"></div>
<button data-testid="like"><span>12</span> Likes</button><button data-testid="like">13</button>
<div role="link"><a href="/zed/status/99">q</a> quoted body</div>
<a href="https://card.example/x">card</a></article>
<article data-testid="tweet"><div data-testid="tweetText">second</div></article>
"""


def test_markup_becomes_scraped_rows(spark):
    df = spark.createDataFrame([(1, MARKUP), (2, ""), (3, None)], "page_id int, html string")
    first, second = html.html_to_raw(df).orderBy("page_id", F.col("post_id").desc()).collect()
    assert first["post_id"] == "123" and first["lang"] == "en"
    assert first["username"] == "alice" and first["display_name"] == "Alice" and first["verified"]
    assert first["hashtags"] == ["cti"] and first["mentions"] == ["bob"]
    assert first["reply_label"] == "1,234 Replies" and first["like_label"] == "12 Likes"
    assert first["retweet_label"] == first["impression_label"] == ""
    assert first["quoted_post_id"] == "99" and "quoted body" in first["quoted_text"]
    assert [u["url"] for u in first["urls"]][-2:] == ["https://t.example/a", "https://t.example/a"]
    assert "Look @bob #cti" in first["text"] and first["created_at"].startswith("2026-01-15")
    assert second["text"] == "second" and second["lang"] == "und" and second["post_id"] == ""
    payloads = pages.scraped_payloads(html.html_to_raw(df)).collect()
    assert [row["post"]["id"] for row in payloads] == ["123"]


def test_a_cut_reference_of_a_web_page_is_text(spark):
    body = "<html lang='de'><article>one &amp two &am<b> &lt;x&gt; &amp;lt; R&D</b> <a href='/a?b=1&amp=2'>l</a></article></html>"
    row = html.html_to_raw(spark.createDataFrame([(1, body)], "page_id int, html string"),
                           markup=html.WEB_PAGE).collect()[0]
    assert row["text"] == "one &amp two &am <x> &lt; R&D l"
    assert row["urls"][0]["url"] == "/a?b=1&amp=2"
    assert html.read_records(body.replace("html", "article").replace("'de'", "'' data-testid='tweet'")
                             .replace("<article>", "<div data-testid='tweetText'>"))[0]["text"].startswith("one & two")


def test_records_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(html, "PIECE", len(MARKUP))
    given = {}

    class Pages:
        schema = spark.createDataFrame([], "page_id int, html string").schema

        def select(self, *names):
            return self

        def mapInPandas(self, parse, kind):  # noqa: N802
            given["parse"] = parse

    html.html_to_raw(Pages())
    batch = pd.DataFrame({"page_id": range(5), "html": [MARKUP, MARKUP, None, MARKUP, ""]})
    pieces = list(given["parse"](iter([batch])))
    assert [set(piece["page_id"]) for piece in pieces] == [{0}, {1}, {3}]
