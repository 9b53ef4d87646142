"""SentencePiece ids, spans and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from postwatch.llm import common, sentence_pieces
from postwatch.llm.sentence_pieces import Model, fields
from tests.llm import edge

LETTERS = "abcdefgh  ▁éßﬁ①½ﾊﾞｶﾞ한글中文字漢😀\n\t 　ıİ¨´xxxx1234…™́\x00<s>Ａ"


def varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def file() -> bytes:
    with open(public_tokenizers.path(sentence_pieces.MODEL_FILE), "rb") as held:
        return held.read()


def with_rule(rule: str, **flags: int) -> bytes:
    """The model file with another character map and other switches, which later fields override."""
    given = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = dict(fields(dict(fields(given))[sentence_pieces.NORMALIZER]))
    extra = field(sentence_pieces.CHARACTER_MAP, spec.get(sentence_pieces.CHARACTER_MAP, b""))
    extra += b"".join(field(getattr(sentence_pieces, name), value) for name, value in flags.items())
    return file() + field(sentence_pieces.NORMALIZER, extra)


def odd_texts(count: int = 800) -> list[str]:
    pick = random.Random(3)
    made = ["".join(pick.choices(LETTERS, k=pick.randrange(40))) for _ in range(count)]
    return made + ["", " ", "  ", "▁", "▁ a", " a  b ", "a▁", "x" * 3000, "ab" * 500, "中" * 300,
                   " ".join(f"w{i}" for i in range(3000)), "中文" * 200 + "a" * 90 + " b"]


@pytest.mark.parametrize("raw", [
    pytest.param(lambda: file(), id="as given"),
    pytest.param(lambda: with_rule("nmt_nfkc"), id="compatibility forms"),
    pytest.param(lambda: with_rule("nmt_nfkc_cf", REMOVE_SPACES=1), id="folded, spaces removed"),
    pytest.param(lambda: with_rule("identity", REMOVE_SPACES=1, DUMMY_PREFIX=0), id="no prefix"),
])
def test_ids_spans_and_text_are_those_of_the_library(raw):
    raw = raw()
    model, library = Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = odd_texts()
    found = list(model.encode(*common.ragged(pa.array(texts, pa.string()))))
    for text, (ids, begins, ends) in zip(texts, found, strict=True):
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [x.id for x in want.pieces], text[:80]
        assert begins.tolist() == [x.begin for x in want.pieces], text[:80]
        assert ends.tolist() == [x.end for x in want.pieces], text[:80]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()).encode()


def test_any_ids_decode_as_in_the_library():
    model, library = Model(file()), sentencepiece.SentencePieceProcessor(model_proto=file())
    pick = random.Random(4)
    for _ in range(2000):
        ids = [pick.choice([pick.randrange(300), pick.randrange(32000)])
               for _ in range(pick.randrange(12))]
        assert model.decode(ids) == library.decode(ids).encode()


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT_CHUNKS", 5)
    model, whole = Model(file()), Model(file())
    for start in range(0, 800, 40):
        block = common.ragged(pa.array(odd_texts()[start: start + 40], pa.string()))
        assert [x[0].tolist() for x in model.encode(*block)] == [x[0].tolist() for x in whole.encode(*block)]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Model(file() + field(sentence_pieces.TRAINER, field(sentence_pieces.MODEL_TYPE, 1)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def check_rows(rows, held):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL_FILE))
    want = []
    for doc_id, text in held:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows]
    assert sorted(got, key=edge.key) == sorted(want, key=edge.key)


def test_query_equals_the_library(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_rows(sentence_pieces.query(spark, sf_dir).collect(), held)


def test_edge_rows(spark):
    docs = edge.frame(spark)
    rows = sentence_pieces.round_trip(docs).collect()
    check_rows(rows, [(i, text) for i, text, _ in edge.ROWS])
    assert sum(x.n_covered for x in rows) == sum(len((text or "").encode()) for _, text, _ in edge.ROWS)
    assert sentence_pieces.round_trip(edge.frame(spark, [])).count() == 0


def test_encoded_rows_decode(spark):
    docs = edge.frame(spark)
    encoded = sentence_pieces.encode(docs)
    row = encoded.filter("doc_id = 7").first()
    text = docs.filter("doc_id = 7").first().text.encode()
    assert b"".join(text[a:b] for a, b in zip(row.begins, row.ends, strict=True)) == text
    back = sorted((tuple(x) for x in sentence_pieces.decode(encoded).collect()), key=edge.key)
    assert back == sorted(((i, text or "") for i, text, _ in edge.ROWS), key=edge.key)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {x.text for x in sentence_pieces.decode(none).collect()} == {""}
