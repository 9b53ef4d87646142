from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postwatch.llm import training_order, url_reputation
from tests.check_oracles import compare, connect
from tests.llm.edge import ROWS, frame, key


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097, 70_001])
def test_slots_are_a_permutation(size):
    order = training_order.Permutation(size)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.numbers(slots) == np.arange(size)).all()
    if size > 100:
        assert (training_order.Permutation(size, key=8).slots(np.arange(size)) != slots).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.15


def unpacked(rows, tokens):
    out = {}
    for row in rows:
        ids = np.frombuffer(bytes(row.payload), "<u2").reshape(-1, tokens)
        assert len(ids) == row.n_sequences and row.stride == 2 * tokens
        for i, (doc, chunk) in enumerate(zip(row.doc_ids, row.chunks, strict=True)):
            out[row.first_slot + i] = (doc, chunk, ids[i])
    return out


def test_every_token_of_odd_rows_has_a_place(spark, tmp_path):
    import public_tokenizers

    library = training_order.encoding(public_tokenizers.path(training_order.RANK_FILE))
    options = {"tokens": 16, "per_shard": 50}
    rows = training_order.ordered(frame(spark), **options).collect()
    slots = unpacked(rows, 16)
    assert sorted(slots) == list(range(len(slots)))
    assert all(r.n_sequences == 50 for r in rows[:-1] if r.shard < max(x.shard for x in rows))
    wanted = []
    for doc, text, _ in ROWS:
        ids = [*library.encode_ordinary(text or ""), training_order.END_ID]
        for chunk, start in enumerate(range(0, len(ids), 16)):
            part = ids[start: start + 16]
            wanted.append((doc, chunk, (*part, *[training_order.PAD_ID] * (16 - len(part)))))
    got = [(doc, chunk, tuple(ids.tolist())) for doc, chunk, ids in slots.values()]
    assert sorted(got, key=key) == sorted(wanted, key=key)

    path = str(tmp_path / "shards")
    training_order.write_shards(frame(spark), path, **options)
    written = unpacked(spark.read.parquet(path).collect(), 16)
    some = training_order.read_slots(spark, path, 45, 60).orderBy("slot").collect()
    assert [r.slot for r in some] == list(range(45, 105))
    assert all((r.doc_id, r.chunk) == written[r.slot][:2] for r in some)
    assert all(np.frombuffer(bytes(r.ids), "<u2").tolist() == written[r.slot][2].tolist() for r in some)


def test_the_order_is_the_keys(spark):
    def order(key_):
        rows = training_order.ordered(frame(spark).coalesce(1), tokens=16, per_shard=50, key=key_)
        return {k: v[:2] for k, v in unpacked(rows.collect(), 16).items()}

    assert order(1) == order(1) and order(1) != order(2)
    assert training_order.ordered(frame(spark, [])).collect() == []


URLS = [
    "https://example.org/es/1", "https://a.example.org/es", "http://www.example.org/en/12#x",
    "http://EXAMPLE.ORG/en/2", "http://x.org", "http://x.org/", "https://shop.com/fr/a?b=/de/",
    "http://shop.com/de/", "http://com/fr/", "http://notcom/fr/", "mailto:a", None, "", "://", "://h?x",
    "http://bad.net/1", "http://a.bad.net/2", "http://good.net/?q", "http://x.co.uk/1", "http://a://b.org/",
    "http://user@h.org:80/p#f", "HTTP://ÄB.com/fr/é", "http://bad.net/1",
]


def verdict_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:end].translate(str.maketrans(url_reputation.UPPER, url_reputation.LOWER))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fitting = [(h + p, v) for h, p, v in url_reputation.RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fitting, key=lambda x: len(x[0]), default=None)


def tables(spark, urls=URLS, outcomes=None):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, rule string")
    rows = [(i, 1, 0) for i in range(len(urls))] if outcomes is None else outcomes
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return pages, labels


def test_hosts_paths_and_rules(spark):
    rows = url_reputation.judge(*tables(spark)).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path, rule = verdict_by_hand(URLS[row.page_id])
        assert (row.host, row.path) == (host, path)
        assert row.rule == (rule and rule[0])
        assert row.verdict == (rule[1] if rule else "allow")


def test_bad_hosts_are_blocked_and_thin_evidence_is_not(spark):
    urls = [f"http://h{i % 40}.d{i % 8}.net/{i}" for i in range(4000)] + ["http://one.d1.net/x"]
    draw = random.Random(3)
    outcomes = [(i, int(draw.random() > (0.9 if i % 40 == 7 else 0.1)), 0) for i in range(4000)]
    outcomes.append((4000, 0, 1))
    rows = url_reputation.judge(*tables(spark, urls, outcomes)).collect()
    blocked = {r.host for r in rows if r.verdict == "block"}
    assert blocked == {"h7.d7.net"}
    shares = {r.host: r.bad_share for r in rows}
    assert shares["one.d1.net"] < 0.5 < shares["h7.d7.net"]


def test_labels_that_teach_nothing(spark):
    for outcomes in ([], [(None, 0, 0), (3, None, None)]):
        pages, labels = tables(spark, URLS, outcomes)
        rows = url_reputation.judge(pages, labels).collect()
        assert len(rows) == len(URLS)
        assert all(r.verdict == "allow" for r in rows if r.rule is None)
    assert url_reputation.judge(*tables(spark, [], [])).collect() == []


def test_levels_of_a_host(spark):
    rows = spark.createDataFrame([("a.b.example.co.uk",), ("example.com",), ("net",), ("x.y.org",), ("",)],
                                 "host string")
    host = F.col("host")
    found = rows.select(url_reputation.domain_of(host), url_reputation.suffix_of(host)).collect()
    assert [tuple(r) for r in found] == [("example.co.uk", "co.uk"), ("example.com", "com"),
                                         ("net", "net"), ("y.org", "org"), ("", "")]


@pytest.mark.parametrize(("host", "site", "domain", "suffix"), [
    ("www.sap.de", "www.sap.de", "sap.de", "de"), ("ard.de", "ard.de", "ard.de", "de"),
    ("a.bbc.uk", "a.bbc.uk", "bbc.uk", "uk"), ("www.bbc.co.uk", "www.bbc.co.uk", "bbc.co.uk", "co.uk"),
    ("10.1.3.4", "10.1.3.4", "10.1.3.4", "(address)"), ("192.168.3.4:80", "192.168.3.4", "192.168.3.4", "(address)"),
    ("[2001:db8::1]:443", "[2001:db8::1]", "[2001:db8::1]", "(address)"),
    ("me:secret@www.example.com:8080", "www.example.com", "example.com", "com"),
    ("example.com.", "example.com", "example.com", "com"), ("a.b.1.2", "a.b.1.2", "1.2", "2"),
    ("co.uk", "co.uk", "co.uk", "uk"), ("localhost:1", "localhost", "localhost", "localhost"),
    ("user@", "", "", "")])
def test_written_domains(spark, host, site, domain, suffix):
    found = spark.range(1).select(url_reputation.site_of(F.lit(host)).alias("site")).select(
        "site", url_reputation.domain_of(F.col("site")), url_reputation.suffix_of(F.col("site"))).first()
    assert tuple(found) == (site, domain, suffix)


def test_hosts_of_one_owner_share_evidence(spark):
    urls = [f"http://www.bad.de:{80 + i % 3}/{i}" for i in range(300)] + [f"http://good{i}.de/" for i in range(2000)]
    urls += ["http://new.bad.de/", "http://u@www.bad.de/", "http://other.de/", "http://9.9.3.4/"]
    outcomes = [(i, int(i >= 300), 0) for i in range(2300)]
    rows = url_reputation.judge(*tables(spark, urls, outcomes)).collect()
    verdicts = {r.host: r.verdict for r in rows}
    assert [verdicts[x] for x in ("new.bad.de", "u@www.bad.de", "www.bad.de:81")] == ["block"] * 3
    assert verdicts["other.de"] == "allow"


@pytest.mark.parametrize("name", sorted(entry.EXTRA_ORACLES))
def test_queries_with_sql(spark, sf_dir, name):
    found = entry.queries()[name](spark, sf_dir).toPandas()
    wanted = connect(sf_dir).execute(entry.oracle_sql()[name]).df()
    assert compare(found, wanted) is None


def test_all_are_registered():
    numbers = {int(x[2:].split("_")[0]) for x in entry.EXTRA_QUERIES if x.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.EXTRA_QUERIES
