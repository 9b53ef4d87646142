from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postwatch.llm import ngram_join, shingles, spot_signatures
from postwatch.llm.components import connected
from tests.llm.edge import BODY, ROWS, frame, key, words


def shingles_of(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1)))


def joined_by_hand(rows, least=0.8):
    sets = [shingles_of(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    out = []
    for i, (doc, _, _) in enumerate(rows):
        if not sets[i]:
            out.append((doc, 0, doc, doc, 0))
            continue
        ids = [x for x in groups[root(i)] if x is not None]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(same, default=None), min(ids, default=None), links[i]))
    return sorted(out, key=key)


def near_copies(draw, count, size=60, first=1000):
    words_ = [f"term{i}" for i in range(size)]
    rows = []
    for i in range(count):
        own = list(words_)
        for _ in range(draw.randint(0, 2)):
            own[draw.randrange(size)] = f"x{draw.randrange(9)}"
        rows.append((first + i, " ".join(own), "en"))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_joins_of_odd_rows_and_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows = [*ROWS, *near_copies(random.Random(2), 40), (900, BODY.upper(), None)]
    found = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=key) == joined_by_hand(rows)


def groups_by_hand(rows, least=0.8):
    """Row numbers of each group of linked rows; rows without words are alone."""
    sets = [shingles_of(t) for _, t, _ in rows]
    groups = [{i} for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = (next(g for g in groups if x in g) for x in (i, j))
                if a is not b:
                    a |= b
                    groups.remove(b)
    return groups


def test_one_of_each_group_stays(spark):
    own, other = (" ".join(f"{name}{i}" for i in range(40)) for name in ("own", "other"))
    rows = [*ROWS, *near_copies(random.Random(4), 12), (30, "q r s", "en"), (30, "q r s", "en"),
            (40, own, "en"), (41, own + " tail", "en"), (41, other, "en"), (None, other + " more", "en"),
            (None, "lonely " + " ".join(f"u{i}" for i in range(40)), "en"),
            (None, " ".join(f"u{i}" for i in range(40)), "en")]
    docs = frame(spark, rows)
    kept = ngram_join.first_of_each(docs)
    assert kept.schema.names == docs.schema.names
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    for group in groups_by_hand(rows):
        members = [rows[i][:2] for i in group]
        staying = [(i, t) for i, t in got if (i, t) in members]
        if not shingles_of(members[0][1]):
            assert got[members[0]] == members.count(members[0]) or len(group) == 1
            continue
        assert len(staying) == 1 and got[staying[0]] == 1
        ids = [i for i, _ in members if i is not None]
        assert staying[0][0] == min(ids, default=None)
    assert got[41, other] == 1 and got[40, own] == 1  # an id with two texts loses only the copy


def test_no_documents(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).collect() == []
    assert ngram_join.first_of_each(frame(spark, [])).collect() == []
    assert len(ngram_join.near_duplicates(frame(spark, [(1, None, None)])).collect()) == 1


def test_all_test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, None)
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = ngram_join.query(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in found), key=key) == joined_by_hand(rows)


def test_bands_reach_their_recall():
    for least, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = shingles.bands_for(least, recall, 128)
        assert 1 - (1 - least**rows) ** bands >= recall and bands * rows <= 128


def test_components_of_a_chain_a_star_and_a_pair(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100 + i, 100) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *star, (7000, 6000), (6000, 7000)], "a long, b long")
    found = {r.node: r.label for r in connected(edges).collect()}
    wanted = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {6000: 6000, 7000: 6000}
    assert found == wanted
    assert connected(edges.filter("a < 0")).collect() == []


def next_by_hand(rows):
    order = sorted(range(len(rows)), key=lambda i: (
        rows[i][0] is None, 0 if rows[i][0] is None else -rows[i][0], rows[i][1] or ""))
    texts = [rows[i][1] or "" for i in order]
    return [(rows[i][0], texts[k], texts[(k + 1) % len(order)]) for k, i in enumerate(order)]


def test_next_documents_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "RANGE_ROWS", 2)
    for rows in (ROWS, ROWS[:1], [(i * i, f"{i} the lone word", None) for i in range(-300, 300)]):
        found = spot_signatures.with_next(frame(spark, rows)).select("doc_id", "text", "next_text")
        assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(next_by_hand(rows), key=key)
    assert spot_signatures.edited_fingerprints(frame(spark, [])).collect() == []


def signatures_by_hand(text):
    """Sets of readable signatures by the same rule."""
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    anchors, out, starts = set(spot_signatures.ANCHORS), set(), []
    for i, word in enumerate(w):
        if word in anchors:
            content = [x for x in w[i + 1: i + 1 + spot_signatures.REACH] if x not in anchors]
            if len(content) >= spot_signatures.CHAIN:
                out.add((word, *content[: spot_signatures.CHAIN]))
                starts.append(i)
    if not w:
        return {text} if text else set()
    width = spot_signatures.CHAIN + 1
    for i in range(len(w)):
        if not any(i - spot_signatures.REACH <= start <= i for start in starts):
            first = max(0, min(i, len(w) - width))
            out.add(("run", *w[first: first + width]))
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_a_plain_version(spark, sf_dir):
    import hashlib

    rows = [(r.doc_id, r.text, None)
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for some, found in (
        (ROWS, spot_signatures.edited_fingerprints(frame(spark))),
        (rows, spot_signatures.query(spark, sf_dir)),
    ):
        wanted = []
        for doc, text, following in next_by_hand(some):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            mine, theirs = signatures_by_hand(text), signatures_by_hand(edited)
            wanted.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(mine),
                           len(theirs), alike(mine, theirs),
                           alike(mine, signatures_by_hand(following))))
        got = found.select(
            "doc_id", "n_chars", "edited_sha256", (F.length("fingerprint") / 8).cast("int"),
            (F.length("edited_fingerprint") / 8).cast("int"), "near_edited", "near_next")
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(wanted, key=key)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spot_signatures.fingerprints(frame(spark)).select("doc_id", "fingerprint").collect()
    prints = defaultdict(set)
    for row in rows:
        prints[row.doc_id].add(row.fingerprint)
    assert prints[1] == prints[6] and prints[3] == prints[4] == {""} and len(prints[10]) == 1


def test_no_stretch_of_a_text_is_left_out(spark):
    footer = " the terms of use of the site are in the page that is linked below"
    draw = random.Random(1)
    russian, chinese = (" ".join("".join(chr(first + draw.randrange(30)) for _ in range(5))
                                 for _ in range(200)) for first in (0x430, 0x4E00))
    code = " ".join(f"x{i} = call{i % 13}({i})" for i in range(120))
    rows = [(1, russian + footer, None), (2, chinese + footer, None), (3, code + footer, None)]
    found = {r.doc_id: r for r in spot_signatures.edited_fingerprints(frame(spark, rows)).collect()}
    assert len({r.fingerprint for r in found.values()}) == 3
    for row in found.values():
        assert row.near_next < 0.5 and 0.2 < row.near_edited < 0.8


def test_alike_fingerprints_are_found(spark):
    draw = random.Random(6)
    rows = [*ROWS]
    for i in range(30):
        body = [f"{a} c{draw.randrange(40)} d{draw.randrange(40)}" for a in ("the", "of", "and") * 8]
        rows.append((2000 + 2 * i, " ".join(body), None))
        body[draw.randrange(len(body))] = "the other thing"
        rows.append((2001 + 2 * i, " ".join(body), None))
    member, pairs = spot_signatures.similar_pairs(frame(spark, rows))
    classes = {r.doc_id: r.class_id for r in member.collect() if r.doc_id is not None}
    sets = {i: signatures_by_hand(t) for i, t, _ in rows if t and i is not None and i != 12}
    ids = sorted(i for i in sets if classes[i] == i)
    wanted = {(a, b) for a in ids for b in ids
              if a < b and alike(sets[a], sets[b]) >= 0.8}
    got = {(r.class_a, r.class_b) for r in pairs.collect()}
    assert {x for x in got if 12 not in x and None not in x} == wanted and len(wanted) > 10
