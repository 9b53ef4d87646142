from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postwatch.llm import language, masked_lm
from tests.llm.edge import ROWS, frame

SMALL = masked_lm.Shape(own=200, shared=55, group=16, hidden=12, batch=64, rate=0.1)


@pytest.fixture(scope="module")
def judged(spark):
    return language.query(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()


def test_held_out_documents_are_recognised(judged):
    held = [r for r in judged if r.held_out]
    assert 100 < len(held) < 300 and len(judged) == 1000
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in judged)


def test_the_fold_is_a_checksum(spark):
    import zlib

    rows = spark.range(200).select("id", language.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_odd_rows_have_a_language_or_none(spark):
    net = language.learned(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = language.predict(frame(spark), net).collect()
    assert len(rows) == len(ROWS)
    unknown = sum(1 for _, t, _ in ROWS if not any(map(str.isalpha, t or "")))
    assert sum(r.lang_pred == "und" and r.score == 0 for r in rows) == unknown
    docs = frame(spark)
    kept = language.with_known_language(docs, net)
    assert kept.schema.names == docs.schema.names and kept.count() == len(ROWS) - unknown
    assert language.predict(frame(spark, []), net).collect() == []


def test_nothing_to_learn_from(spark):
    net = language.learned(frame(spark, [(1, None, "en"), (2, "x", None), (3, "12", "de")]))
    assert net is None
    assert {r.lang_pred for r in language.predict(frame(spark), net).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    rows = [(i, f"text number {i} " * 300, "en" if i % 3 else "de") for i in range(200)]
    found = language.sample(frame(spark, rows), per_language=10).collect()
    assert len(found) == 20 and all(len(r.part) <= language.SAMPLE_CHARS for r in found)


def test_gradients_follow_the_loss():
    shape = language.Shape(embedding=3, filters=2, widths=(2, 3))
    net = language.ByteNet(["a", "b"], shape)
    for name, held in net.weights.items():
        net.weights[name] = held.astype(np.float64)
    draw = np.random.default_rng(0)
    windows, target = draw.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        held = net.probabilities(windows)
        return -np.log(held[np.arange(6), target]).mean()

    slopes = net.gradients(windows, target)
    for name, at in (("out", (1, 0)), ("kernel", (2, 1)), ("bias", (1,)), ("prior", (0,)),
                     ("embedding", (int(windows[0, 3]), 1))):
        before = net.weights[name][at]
        net.weights[name][at] = before + 1e-5
        up = loss()
        net.weights[name][at] = before - 1e-5
        down = loss()
        net.weights[name][at] = before
        assert slopes[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_windows_cover_whole_texts():
    data = np.arange(1, 701, dtype=np.int64).astype(np.uint8)
    windows, owner, length = language.cut(data, np.array([0, 0, 300, 700]))
    assert owner.tolist() == [1, 1, 2, 2] and length.tolist() == [256, 44, 256, 144]
    joined = b"".join(w[:n].tobytes() for w, n in zip(windows, length, strict=True))
    assert joined == data.tobytes()


def grammar(draw, count):
    pairs = [(f"a{i}", f"b{i}", f"c{i}") for i in range(12)]
    return [" ".join(w for _ in range(20) for w in draw.choice(pairs)) for _ in range(count)]


def test_order_of_words_is_learned(spark):
    draw = random.Random(1)
    docs = frame(spark, [(i, t, None) for i, t in enumerate(grammar(draw, 600))])
    vocabulary = masked_lm.vocabulary_of(docs, SMALL)
    net = masked_lm.train(docs, vocabulary)
    fresh = grammar(draw, 30)
    mixed = []
    for text in fresh:
        w = text.split()
        draw.shuffle(w)
        mixed.append(" ".join(w))
    rows = masked_lm.score(frame(spark, [(i, t, None) for i, t in enumerate([*fresh, *mixed])]),
                           vocabulary, net).collect()
    mean = {r.doc_id: r.mean_log_likelihood for r in rows}
    assert np.mean([mean[i] for i in range(30)]) > np.mean([mean[i] for i in range(30, 60)]) + 1


def test_probabilities_add_up_to_one():
    net = masked_lm.Network.drawn(SMALL)
    net.parts["groups_bias"][...] = np.arange(SMALL.groups) / 9
    context = np.array([[3, 0, 7, 9]])
    total = sum(np.exp(net.log_probabilities(context, np.array([c])))[0]
                for c in range(SMALL.groups * SMALL.group))
    assert total == pytest.approx(1, abs=1e-5)


def test_training_starts_from_the_shares_of_the_classes():
    frequency = np.arange(SMALL.classes) ** 2.0
    net = masked_lm.Network.drawn(SMALL, frequency)
    net.parts["embedding"][...] = 0  # nothing is known about the context
    context, target = np.zeros((SMALL.classes, 4), int), np.arange(SMALL.classes)
    wanted = (frequency + 1) / (frequency.sum() + SMALL.groups * SMALL.group)
    assert np.exp(net.log_probabilities(context, target)) == pytest.approx(wanted, rel=1e-4)


def test_groups_are_padded_to_alike_sizes():
    draw = np.random.default_rng(0)
    group = np.sort(draw.geometric(0.05, 5000))
    seen = []
    for numbers, rows, filled in masked_lm.padded(group):
        assert rows.shape == filled.shape == (len(numbers), rows.shape[1])
        assert (group[rows] == numbers[:, None]).all()
        assert filled.sum() * masked_lm.ALIKE + len(numbers) >= filled.size
        seen += rows[filled].tolist()
    assert sorted(seen) == list(range(5000)) and not list(masked_lm.padded(group[:0]))


def test_training_lowers_the_loss_of_a_batch():
    net, squares = masked_lm.Network.drawn(SMALL), masked_lm.Network(SMALL)
    draw = np.random.default_rng(2)
    context, target = draw.integers(0, SMALL.classes, (64, 4)), draw.integers(0, SMALL.classes, 64)
    before = net.log_probabilities(context, target).mean()
    for _ in range(30):
        net.train(context, target, squares)
    assert net.log_probabilities(context, target).mean() > before + 1


def test_a_batch_is_worked_on_in_pieces(monkeypatch):
    """No product takes in more places than stay in the cache; pieces change nothing."""
    shape = masked_lm.Shape()
    draw = np.random.default_rng(4)
    target = np.minimum(draw.geometric(0.01, shape.batch), shape.classes) - 1
    context = draw.integers(0, shape.classes, (shape.batch, 4))
    exponentials, sizes, seen = masked_lm.exponentials, [], []
    monkeypatch.setattr(masked_lm, "exponentials", lambda x: (sizes.append(len(x)), exponentials(x))[1])
    for most in (masked_lm.CACHED_PLACES, 1 << 20):
        monkeypatch.setattr(masked_lm, "CACHED_PLACES", most)
        net, squares = masked_lm.Network.drawn(shape), masked_lm.Network(shape)
        for _ in range(2):
            net.train(context, target, squares)
        seen.append((net.flat, net.log_probabilities(context, target), max(sizes)))
    (flat, logs, largest), (whole_flat, whole_logs, whole) = seen
    assert largest <= 2_048 < whole
    assert np.abs(flat - whole_flat).max() < 1e-3 and np.abs(logs - whole_logs).max() < 1e-3


def test_rows_of_runs_are_added_up():
    draw = np.random.default_rng(5)
    classes = np.minimum(draw.zipf(1.3, 3000), 500)
    values, order = draw.normal(size=(3000, 3)), masked_lm.sorted_places(classes, 501)
    held = classes[order]
    heads = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    wanted = np.zeros((501, 3))
    np.add.at(wanted, classes, values)
    assert {1, 2, masked_lm.SHORT_RUN + 1} & set(np.bincount(classes).tolist())
    assert masked_lm.sums_of_runs(values, order, heads) == pytest.approx(wanted[held[heads]])


def test_scores_of_odd_rows(spark):
    docs = frame(spark)
    rows = masked_lm.pseudo_likelihood(docs, SMALL).collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        assert (row.n_words == 0) == (row.mean_log_likelihood is None)
        assert row.log_likelihood <= 0
        if row.n_words:
            assert row.mean_log_likelihood == pytest.approx(row.log_likelihood / row.n_words)
    assert sum(r.n_words == 0 for r in rows) == sum(
        1 for _, t, _ in ROWS if not (t or "").strip(" \n\t"))
    assert masked_lm.pseudo_likelihood(frame(spark, []), SMALL).collect() == []


def test_words_of_one_class_are_told_apart_by_their_counts(spark):
    texts = [f"one two w{i} w{i % 40} w{i % 7}" for i in range(900)]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    shape = masked_lm.Shape(own=20, shared=3, group=8, hidden=4, batch=64)
    vocabulary = masked_lm.vocabulary_of(docs, shape)
    assert vocabulary.shape.own > 100 and vocabulary.shape.groups > shape.groups
    net = masked_lm.train(docs, vocabulary)
    names = [f"w{i}" for i in range(900)]
    sequence, places, _, hashes = masked_lm.hashed(pa.array(names), vocabulary)
    counts = {r.word: r.n for r in vocabulary.counts(spark).collect()}
    rows = masked_lm.score(frame(spark, [(i, t, None) for i, t in enumerate(names)]), vocabulary, net)
    score = {r.doc_id: r.log_likelihood for r in rows.collect()}
    classes, shared = sequence[places], 0
    alone = net.log_probabilities(masked_lm.context_of(sequence, places, vocabulary.shape), classes)
    for i, word in enumerate(hashes.view(np.int64).tolist()):
        share = 1
        if classes[i] > vocabulary.shape.own:
            shared += 1
            share = counts[word] / vocabulary.totals[classes[i]]
        assert score[i] == pytest.approx(alone[i] + np.log(share), abs=1e-3)
    assert shared > 500


def test_every_place_is_masked_once():
    batches = list(masked_lm.masks(np.arange(5, 1005), SMALL, 3))
    assert sorted(np.concatenate(batches).tolist()) == list(range(5, 1005))
    assert all(len(set((b - 5) % SMALL.masked_every)) == 1 and len(b) <= SMALL.batch for b in batches)


def test_words_are_hashed_byte_by_byte(monkeypatch):
    """The hash of a word does not depend on the words that are hashed together with it."""
    from postwatch.llm import words as module

    draw = random.Random(6)
    texts = [None, "", "one", *(" ".join("é" + "xY9"[i % 3] * draw.randrange(63) for i in range(40))
                                for _ in range(30)), "a" * 64 + "\n" + "b" * 65]
    wanted = []
    for text in texts:
        for word in (text or "").lower().encode().split():
            held = module.SEED
            for byte in word:
                held = (held ^ byte) * module.BASE % 2**64
                held ^= held >> 29
            long = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            wanted.append((held if len(word) <= module.LONG_WORD else long) | 1)
    for most in (7, module.HASHED_AT_ONCE):
        monkeypatch.setattr(module, "HASHED_AT_ONCE", most)
        hashes, starts = module.words(*masked_lm.common.ragged(pa.array(texts)))
        assert hashes.tolist() == wanted
        assert np.diff(starts).tolist() == [len((t or "").split()) for t in texts]


def test_counts_cover_all_documents(spark):
    rows = masked_lm.word_counts(frame(spark)).agg(F.sum("n")).first()[0]
    from tests.llm.edge import words

    assert rows == sum(len(words(t)) for _, t, _ in ROWS)


def test_copies_are_averaged_by_places(spark):
    docs = frame(spark, [(i, f"one two three four {i % 5}", None) for i in range(200)])
    vocabulary = masked_lm.vocabulary_of(docs, SMALL)
    several = masked_lm.train(docs.repartition(70), vocabulary)  # more copies than one sum takes
    assert np.isfinite(several.flat).all() and several.flat.shape == masked_lm.Network(SMALL).flat.shape
    sequence, places, owner = masked_lm.laid_out(pa.array(["a b", "", None, "c"]), vocabulary)
    assert owner.tolist() == [0, 0, 3] and (sequence[places] > 0).all()
    assert (masked_lm.context_of(sequence, places, SMALL)[-1] == 0).all()


def plain_network(shape, frequency=None):
    net = masked_lm.Network.drawn(shape, frequency)
    return {name: part.astype(np.float64) for name, part in net.parts.items()}


def plain_softmax(values):
    held = np.exp(values - values.max(1, keepdims=True))
    return held / held.sum(1, keepdims=True)


def plain_parts(p, context, target, shape):
    """Hidden values and the probabilities of both steps, each place with its own group's matrix."""
    hidden = np.tanh(p["bias"] + sum(p["embedding"][i, context[:, i]] for i in range(context.shape[1])))
    group = target // shape.group
    first = plain_softmax(hidden @ p["groups"] + p["groups_bias"])
    second = plain_softmax(np.einsum("nh,nhm->nm", hidden, p["members"][group]) + p["members_bias"][group])
    return hidden, group, target % shape.group, first, second


def plain_step(p, squares, context, target, shape):
    n, at = len(target), np.arange(len(target))
    hidden, group, member, first, second = plain_parts(p, context, target, shape)
    first[at, group] -= 1
    second[at, member] -= 1
    slopes = {name: np.zeros_like(part) for name, part in p.items()}
    slopes["groups"], slopes["groups_bias"] = hidden.T @ first, first.sum(0)
    np.add.at(slopes["members"], group, np.einsum("nh,nm->nhm", hidden, second))
    np.add.at(slopes["members_bias"], group, second)
    back = first @ p["groups"].T + np.einsum("nm,nhm->nh", second, p["members"][group])
    back *= 1 - hidden**2
    slopes["bias"] = back.sum(0)
    for i in range(context.shape[1]):
        np.add.at(slopes["embedding"][i], context[:, i], back)
    for name, slope in slopes.items():
        squares[name] += (slope / n) ** 2
        p[name] -= shape.rate * (slope / n) / (np.sqrt(squares[name]) + 1e-8)


def test_the_whole_query_against_a_plain_version(spark, tmp_path):
    """Counts, classes, training of one copy and scores, written down place by place in doubles."""
    from tests.llm.edge import words

    rows = [(i, t, lang) for i, t, lang in ROWS if t is None or len(t) < 10_000] * 3
    shape = masked_lm.Shape(own=30, shared=9, group=8, hidden=6, batch=50, rate=0.1)
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/docs")  # one order of rows for both
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = masked_lm.pseudo_likelihood(docs, shape).collect()

    vocabulary = masked_lm.vocabulary_of(docs, shape)
    shape, pad = vocabulary.shape, 2
    texts = [r.text for r in docs.collect()]
    hashes = {w: int(masked_lm.words(*masked_lm.common.ragged(pa.array([w])))[0][0]) for t in texts for w in words(t)}
    counts = {}
    for text in texts:
        for w in words(text):
            counts[w] = counts.get(w, 0) + 1
    signed = {w: int(np.uint64(x).view(np.int64)) for w, x in hashes.items()}
    own = sorted(counts, key=lambda w: (-counts[w], signed[w]))[: shape.own]
    classes = {w: int(vocabulary.classes(np.array([x], np.uint64))[0]) for w, x in hashes.items()}
    assert [classes[w] for w in own] == list(range(1, len(own) + 1))
    totals = {}
    for w, c in classes.items():
        assert (w in own) == (c <= shape.own)
        totals[c] = totals.get(c, 0) + counts[w]

    sequence = [0] * pad
    spans = []
    for text in texts:
        spans.append((len(sequence), len(words(text))))
        sequence += [classes[w] for w in words(text)] + [0] * pad
    sequence = np.array(sequence)
    places = np.concatenate([np.arange(a, a + n) for a, n in spans])
    frequency = np.zeros(shape.classes)
    for c, n in totals.items():
        frequency[c] = n
    p = plain_network(shape, frequency)
    squares = {name: np.zeros_like(part) for name, part in p.items()}
    for at in masked_lm.masks(places, shape, 0):
        plain_step(p, squares, masked_lm.context_of(sequence, at, shape), sequence[at], shape)
    wanted = []
    for text, (a, n) in zip(texts, spans, strict=True):
        at = np.arange(a, a + n)
        _, group, member, first, second = plain_parts(
            p, masked_lm.context_of(sequence, at, shape), sequence[at], shape)
        each = np.log(first[np.arange(n), group]) + np.log(second[np.arange(n), member])
        share = sum(np.log(counts[w] / totals[classes[w]]) for w in words(text) if w not in own)
        wanted.append((n, each.sum() + share))
    assert len(got) == len(wanted)
    for (n, total), row in zip(sorted(wanted), sorted((r.n_words, r.log_likelihood) for r in got), strict=True):
        assert row[0] == n and row[1] == pytest.approx(total, rel=2e-3, abs=2e-2)
