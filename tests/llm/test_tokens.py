from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from postwatch.llm import byte_bpe, token_counts
from postwatch.llm.pieces import pieces
from tests.llm.edge import ROWS, frame, key

ALPHABET = "ab stmdrevl'  \n\t.,!19éß中 　x’½Ⅷ\x1c\x85😀aaaa"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load(byte_bpe.rank_path())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks.ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    out = ["".join(draw.choice(ALPHABET) for _ in range(draw.choice((0, 1, 2, 3, 8, 30, 200))))
           for _ in range(1500)]
    return [*out, "a" * 2000, " " * 400, "ab" * 500, "x<|endoftext|> <|endoftext|>\n<|endoftext|>"]


def test_pieces_are_those_of_the_pattern(texts):
    rule = regex.compile(public_tokenizers.PATTERN)
    for start in range(0, len(texts), 7):
        some = [x.encode() for x in texts[start: start + 7]]
        found, bounds = pieces(b"".join(some), np.cumsum([0, *map(len, some)]))
        for i, text in enumerate(texts[start: start + 7]):
            assert [x.decode() for x in found[bounds[i]: bounds[i + 1]]] == rule.findall(text)


def test_another_pattern_is_run_as_it_is():
    found, bounds = pieces(b"ab cdef", np.array([0, 3, 7]), r"\w|\s")
    assert found == [b"a", b"b", b" ", b"c", b"d", b"e", b"f"] and bounds.tolist() == [0, 3, 7]


def test_encoding_is_the_librarys(texts, ranks, library):
    for text, ids in zip(texts, byte_bpe.encoded(pa.array(texts), ranks), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert byte_bpe.decode(ids, ranks) == text.encode()


def test_emptied_memories_change_no_ids(texts, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 40)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 30)
    small = byte_bpe.Ranks(ranks.ranks)
    for start in range(0, len(texts), 25):
        some = texts[start: start + 25]
        for text, ids in zip(some, byte_bpe.encoded(pa.array(some), small), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_every_character(ranks, library):
    text = " ".join("x" + chr(c) + "y" for c in (*range(0xD800), *range(0xE000, 0x110000)))
    ids = next(byte_bpe.encoded(pa.array([text]), ranks))
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_prefix_tables_append_and_edit(ranks):
    draw = random.Random(9)
    for _ in range(150):
        data = bytes(draw.choice(b"abcthe  ing") for _ in range(draw.randint(0, 200)))
        table = byte_bpe.PrefixTable(ranks, data)
        start = draw.randint(0, len(data))
        stop = draw.randint(start, len(data))
        new = bytes(draw.choice(b"abcthe") for _ in range(draw.randint(0, 5)))
        table.replace(start, stop, new)
        table.append(b"thing")
        whole = byte_bpe.PrefixTable(ranks, data[:start] + new + data[stop:] + b"thing")
        assert table.last == whole.last and table.data == whole.data


def test_an_edit_leaves_distant_rows_alone(ranks):
    table = byte_bpe.PrefixTable(ranks, b"the thing and another " * 60)
    assert table.replace(10, 11, b"x") < 500


def test_merging_counts_as_the_library_does(texts):
    name = public_tokenizers.path("byte_bpe_50k.json")
    library, merges = Tokenizer.from_file(name), token_counts.load(name)
    size, tokens = token_counts.count_texts(pa.array(texts), merges)
    wanted = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.tolist() == wanted
    assert size.tolist() == [len(x.encode()) for x in texts]


def test_encode_and_round_trip_of_odd_rows(spark, library):
    ids = {text: library.encode_ordinary(text or "") for _, text, _ in ROWS}
    rows = byte_bpe.encode(frame(spark)).collect()
    packed = [(i, np.array(ids[t], "<u4").tobytes(), len(ids[t])) for i, t, _ in ROWS]
    assert sorted(((r[0], bytes(r[1]), r[2]) for r in rows), key=key) == sorted(packed, key=key)
    back = byte_bpe.decoded(byte_bpe.encode(frame(spark))).collect()
    assert sorted(((r[0], bytes(r[1])) for r in back), key=key) == sorted(
        ((i, (t or "").encode()) for i, t, _ in ROWS), key=key)
    digests = byte_bpe.round_trip(frame(spark)).collect()
    assert sorted((tuple(r) for r in digests), key=key) == sorted(
        ((i, n, hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
         for (i, data, n), (_, t, _) in zip(packed, ROWS, strict=True)), key=key)


def test_counts_of_odd_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(frame(spark)).collect()
    wanted = []
    for i, text, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((i, len((text or "").encode()), n, n > 512))
    assert sorted((tuple(r) for r in rows), key=key) == sorted(wanted, key=key)


def test_empty_tables(spark):
    assert byte_bpe.encode(frame(spark, [])).collect() == []
    assert byte_bpe.round_trip(frame(spark, [])).collect() == []
    assert token_counts.count_tokens(frame(spark, [])).collect() == []


def test_queries_on_the_test_tables(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = byte_bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    counted = {r.doc_id: r.n_tokens for r in token_counts.query(spark, sf_dir).collect()}
    assert counted == {row.doc_id: row.n_tokens for row in rows}


def test_many_special_strings_are_found_in_one_pass(spark):
    import time

    merges = token_counts.load(public_tokenizers.path(token_counts.VOCABULARY_FILE))
    mark = merges.special[0].decode()
    texts = [f"a {mark} b" * 3, mark * 5, mark[:-1] + mark, "x " * 100_000 + f"{mark} y" * 200_000, None]
    start = time.monotonic()
    _, counts = token_counts.count_texts(pa.array(texts), merges)
    assert time.monotonic() - start < 20
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY_FILE))
    wanted = [len(library.encode(text or "", add_special_tokens=False).ids) for text in texts]
    assert counts.tolist() == wanted
