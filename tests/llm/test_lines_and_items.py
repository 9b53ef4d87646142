from __future__ import annotations

import hashlib

import numpy as np
import pytest

from postwatch.llm import decontaminate, line_dedup
from tests.llm.edge import LOWER, PASSAGE, ROWS, frame, key, words

BLANKS = " \t\n\x0b\x0c\r"


def kept_by_hand(rows):
    def name(i):
        return 1 << 62 if i is None else i

    holders: dict[str, set[int]] = {}
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            k = line.strip(BLANKS).translate(LOWER)
            if len(k) >= 10:
                holders.setdefault(k, set()).add(name(i))
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines
                if len(holders.get(x.strip(BLANKS).translate(LOWER), ())) < 2
                or min(holders[x.strip(BLANKS).translate(LOWER)]) == name(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=key)


def test_lines_of_odd_rows(spark):
    rows = [tuple(r) for r in line_dedup.drop_lines(frame(spark)).collect()]
    assert sorted(rows, key=key) == kept_by_hand(ROWS)


def test_a_line_that_all_share_stays_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COPY_PROBES", 16)  # many copies of its shard
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = [(i, f"the line that all share\nown line number {i % 40}", "en") for i in range(300)]
    found = [tuple(r) for r in line_dedup.drop_lines(frame(spark, rows)).collect()]
    assert sorted(found, key=key) == kept_by_hand(rows)


def test_rows_without_an_id_or_with_one_id_are_no_one_group(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COPY_PROBES", 16)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    rows = [(1, "the line that all share\nits footer", "en")]
    rows += [(name, f"the line that all share\nown line number {i}\nits footer", "en")
             for name in (None, 7) for i in range(150)]
    rows += [(None, "the line that all share\nits footer", "en")] * 40
    docs = frame(spark, rows)
    lost = line_dedup.losses(docs).collect()
    assert len(lost) == 301 and max(len(r.lost) for r in lost) <= 3
    found = [tuple(r) for r in line_dedup.drop_lines(docs).collect()]
    assert sorted(found, key=key) == kept_by_hand(rows)
    texts = line_dedup.without_shared_lines(docs).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in texts), key=key) == [r[:2] for r in kept_by_hand(rows)]


def test_texts_are_replaced_and_other_columns_stay(spark):
    docs = frame(spark)
    out = line_dedup.without_shared_lines(docs)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    wanted = {(i, t) for i, t, _, _ in kept_by_hand(ROWS)}
    assert {(r.doc_id, r.text or "") for r in rows} == wanted
    assert all(r.lost == "l" and r.n_words == -1 for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert sum(r.text is None for r in rows) == sum(t is None for _, t, _ in ROWS)


def test_no_lines_at_all(spark):
    assert line_dedup.drop_lines(frame(spark, [])).collect() == []
    rows = line_dedup.drop_lines(frame(spark, [(1, None, None), (2, "", None)])).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "", 1, 0), (2, "", 1, 0)]


def test_the_perfect_hash_is_minimal():
    draw = np.random.default_rng(1)
    for size in (1, 2, 100, 5000):
        high, low = draw.integers(0, 2**63, (2, size)).astype(np.uint64)
        shard = line_dedup.Shard(*line_dedup.Shard.build(high, low, np.arange(size) + 2, np.arange(size)))
        count, first = shard.probe(high, low)
        assert sorted(first.tolist()) == list(range(size)) and len(shard.count) == size
        assert (count == first + 2).all()
        assert (shard.probe(high + np.uint64(1), low)[0] == 0).all()


ITEMS = [
    ("i1", f"Alpha BETA, gamma {PASSAGE[17:]} and then some more words for it"),
    ("i2", "a b c"),
    ("i10", "a b c"),
    ("i3", None),
    ("i4", "..."),
    (None, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"),
    ("i5", "one two three four five six seven eight nine ten eleven"),
    ("i5", "one two three four five six seven eight nine ten eleven"),
    ("i6", "line here"),
]


def windows_by_hand(items, width=10):
    out = []
    for item, text in items:
        w = words(text)
        n = min(len(w), width)
        out += [(item, tuple(w[j: j + n])) for j in range(len(w) - n + 1) if n]
    return out


def contamination_by_hand(rows, items):
    found = windows_by_hand(items)
    out = []
    for i, text, _ in rows:
        w, hit, names = words(text), set(), set()
        places: dict[tuple, list[int]] = {}
        for n in {len(x) for _, x in found}:
            for p in range(len(w) - n + 1):
                places.setdefault(tuple(w[p: p + n]), []).append(p)
        for item, window in found:
            for p in places.get(window, ()):
                hit.update(range(p, p + len(window)))
                if item is not None:
                    names.add(item)
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=key)


def benchmark(spark, items=None):
    return spark.createDataFrame([(i, t, "x") for i, t in (ITEMS if items is None else items)],
                                 "item_id string, text string, doc_id string")


@pytest.mark.parametrize("group_bytes", [decontaminate.GROUP_BYTES, 60])
def test_contamination_of_odd_rows(spark, group_bytes):
    rows = [*ROWS, (20, "One two three four five six seven eight nine ten ELEVEN twelve", None),
            (21, "one two three four five six seven eight nine one two", None)]
    found = decontaminate.contamination(frame(spark, rows), benchmark(spark), group_bytes=group_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=key)
    assert got == contamination_by_hand(rows, ITEMS)
    clean = decontaminate.remove_contaminated(frame(spark, rows), benchmark(spark),
                                              group_bytes=group_bytes)
    assert clean.schema.names == frame(spark, rows).schema.names
    assert sorted((r.doc_id for r in clean.collect()), key=lambda x: key([x])) == [
        i for i, _, hit, _ in got if not hit]


def test_longest_matches_and_their_places(spark):
    tail = " ".join(ITEMS[6][1].split()[:10])
    docs = frame(spark, [(1, f"zero {ITEMS[6][1]} twelve. {tail}", None)])
    rows = decontaminate.matches(docs, benchmark(spark)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, "i5", 0, 11), (1, 13, "i5", 0, 10)]


def test_nothing_to_compare_with(spark):
    rows = decontaminate.contamination(frame(spark), benchmark(spark, [])).collect()
    assert len(rows) == len(ROWS) and not any(r.n_hit or r["items"] or r.longest for r in rows)
    assert decontaminate.contamination(frame(spark, []), benchmark(spark)).collect() == []


def test_suffixes_are_sorted():
    draw = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        sequence = draw.integers(0, 3, size).astype(np.uint64)
        order = decontaminate.suffix_array(sequence, size + 1)
        held = [tuple(sequence[i:].tolist()) for i in order]
        assert held == sorted(held) and sorted(order.tolist()) == list(range(size))


def test_digest_of_no_items(spark, sf_dir):
    rows = decontaminate.query(spark, sf_dir).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == empty) == (r.n_items == 0) == (not r.contaminated) for r in rows)
