from __future__ import annotations

import ipaddress
import random
import re

from pyspark.sql import functions as F

from postwatch.functions import indicators as ind
from postwatch.schema import IOC_COLUMNS


def extract(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = ind.with_indicators(df).orderBy("n").collect()
    return [{name.removeprefix("ioc_"): row[name] for name in IOC_COLUMNS} for row in rows]


def test_defanged_report(spark):
    (found,) = extract(
        spark,
        "UNC77 used T1566.002 and CVE-2031-10001 from 198.51.100.7, see hxxp://drop[.]test/kit",
    )
    assert found["urls"] == ["http://drop.test/kit"]
    assert "drop.test" in found["domains"]
    assert found["ipv4"] == ["198.51.100.7"]
    assert found["cves"] == ["CVE-2031-10001"]
    assert found["attack_techniques"] == ["T1566.002"]
    assert found["threat_actors"] == ["UNC77"]


def test_known_edges(spark):
    cases = extract(
        spark,
        "payload.exe is a name and a domain",
        "1.2.3.4:80 has a port",
        "010.1.1.1 and 256.1.1.1 and 1.2.3.4. end",
        "mail a@b.example and b.example",
        "Evil.example evil.example",
        "http://user:pw@Host.example:8080/x, http://1.2.3.4/y; http://localhost)",
        "http://[::1]/z",
        "#Ab #a-b x#no ##yes #c",
        "d41d8cd98f00b204e9800998ecf8427e" * 2 + " " + "A" * 40,
        "",
    )
    assert cases[0]["domains"] == cases[0]["filenames"] == ["payload.exe"]
    assert cases[1]["ipv4"] == []
    assert cases[2]["ipv4"] == ["1.2.3.4"]
    assert cases[3]["domains"] == []
    assert cases[4]["domains"] == ["evil.example", "evil.example"]
    assert cases[5]["domains"] == ["host.example", "localhost"]
    assert cases[5]["urls"] == [
        "http://1.2.3.4/y", "http://localhost", "http://user:pw@Host.example:8080/x"
    ]
    assert cases[6]["domains"] == []
    assert cases[7]["hashtags"] == ["a-b", "ab", "yes"]
    assert cases[8]["sha256"] and cases[8]["sha1"] == ["A" * 40] and not cases[8]["md5"]
    assert all(values == [] for values in cases[9].values())


def address(run: str) -> str | None:
    """Canonical address of a candidate by the standard library, mapped v6 in hexadecimal."""
    try:
        parsed = ipaddress.ip_address(run)
    except ValueError:
        return None
    if parsed.version == 6 and parsed.ipv4_mapped:
        low = int(parsed) & 0xFFFFFFFF
        return f"::ffff:{low >> 16:x}:{low & 0xFFFF:x}"
    return str(parsed)


def test_addresses_equal_standard_library(spark):
    rng = random.Random(11)

    def group():
        return rng.choice(["0", "0", "0000", "1", "db8", "FFFF", "00a", "12345", "", "1.2.3.4"])

    runs = [":".join(group() for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    runs += [":".join(rng.choice(["0", "1", "0", "a"]) for _ in range(8)) for _ in range(2000)]
    runs += ["::".join(":".join(rng.choice(["0", "1", "b"]) for _ in range(rng.randint(0, 4)))
                       for _ in range(2)) for _ in range(2000)]
    runs += [".".join(str(rng.choice([0, 1, 10, 199, 255, 256, "01"])) for _ in range(4))
             for _ in range(500)]
    runs += ["::", "::1", "1::", "1::2::3", ":1:2", "1:2:3:4:5:6:7:8:9", "::1.2.3.4",
             "64:ff9b::1.2.3.256", "1:2:3:4:5:6:1.2.3.4"]
    df = spark.createDataFrame([(r,) for r in runs], "run string").select(
        "run", F.array("run").alias("c")
    ).select("run", ind.extract_ipv4("c").alias("v4"),
             ind.extract_ipv6(F.col("c")).alias("v6"))
    for row in df.collect():
        expected = address(row["run"])
        assert row["v4"] + row["v6"] == ([expected] if expected else []), row["run"]


# Independent check of the simple lists: each is every distinct match, some with a case change.
SIMPLE = {
    "emails": (ind.EMAIL, str), "cves": (ind.CVE, str.upper),
    "attack_techniques": (ind.ATTACK, str.upper), "filenames": (ind.FILENAME, str),
    "hashtags": (ind.HASHTAG, str.lower), "threat_actors": (ind.ACTOR, str.upper),
}


def python_pattern(pattern: str) -> re.Pattern:
    flags, body = re.match(r"\(\?(\w+)\)(.*)", pattern, re.S).groups()
    return re.compile(body, re.I if "i" in flags else 0)


def test_simple_lists_equal_python_matches(spark):
    rng = random.Random(5)
    pieces = ["CVE-2026-1234", "cve-2026-12345678", "T1059", "t1059.001", "T10590", "#tag", "é#tag",
              "#été", "APT1", "apt1234", "Fin7", "ſ", "K", "İ", "a.exe", "b.DLL.", "ünï.js", "x@y.de",
              "é@ä.com", "a_b.zip", ".", "-", " ", "\n", " ", "İ.sys", "TA505", "UNC1", "_", "9"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(8))
             for _ in range(1500)]
    for text, found in zip(texts, extract(spark, *texts), strict=True):
        for name, (pattern, change) in SIMPLE.items():
            matches = python_pattern(pattern).findall(text)
            assert found[name] == sorted({change(m) for m in matches}), (name, text)
        plain = python_pattern(ind.DOMAIN.replace("(?=[a-z0-9-]++\\.)", ""))
        hosts = {mail.split("@")[1] for mail in found["emails"]}
        assert found["domains"] == sorted(
            d.lower() for d in set(plain.findall(text)) - hosts
        ), text


def test_preview_and_total(spark):
    df = spark.createDataFrame([("T1059 T1060 #a1 #b2 x@y.de CVE-2020-1234",)], "text string")
    row = ind.with_indicators(df).select(
        ind.indicator_preview(4).alias("few"), ind.indicator_total().alias("total")
    ).first()
    assert row["few"] == ["x@y.de", "CVE-2020-1234", "T1059", "T1060"]
    assert row["total"] == 6


def test_leaving_out_plain_words_changes_nothing(spark):
    rng = random.Random(17)
    parts = ["face", "bad", "a" * 31, "a" * 32, "abcdef" * 6, "T1059", "apt28", "x.exe", "#tag", "#", "::1", "e", "É",
             "1.2.3.4", "fe80::1", "a@b.co", "hxxp://x[.]y/z", "CVE-2024-12345", "\u0661", "d.", ".com",
             "evil.example", "(evil.example)", "ſ", "-", "word", "\x1c", "http://a\x1cb.c"]
    gaps = [" ", "\n", "\t", "\u00a0", "\u3000", "", ", ", "\x1c", "\x85"]
    rows = [(n, "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 12))))
            for n in range(1500)]
    df = spark.createDataFrame(rows, "id int, text string")
    columns = ["id", *[F.col(name).cast("string") for name in IOC_COLUMNS]]
    short = ind.with_indicators(df).select(*columns).collect()
    kept = ind.PLAIN_WORD
    try:
        ind.PLAIN_WORD = "(?!)"  # nothing is left out
        whole = ind.with_indicators(df).select(*columns).collect()
    finally:
        ind.PLAIN_WORD = kept
    assert sorted(short) == sorted(whole)


def test_runs_of_plain_words_leave_one_blank(spark):
    text = "plain words " * 100_000 + "CVE-2031-10001 and\x1cthen a.example\n\n" + "more  words " * 5
    df = spark.createDataFrame([(text,), ("word",), (" x  y ",), ("",)], "text string")
    kept = [r[0] for r in df.select(ind.telling_words(F.col("text"))).collect()]
    assert kept == [" CVE-2031-10001  a.example\n\n ", " ", "  ", ""]
    found = ind.with_indicators(df).first()
    assert (found["ioc_cves"], found["ioc_domains"]) == (["CVE-2031-10001"], ["a.example"])
