from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.edge import ROWS, frame, key
from tests.llm.test_lines_and_items import contamination_by_hand, kept_by_hand
from tests.llm.test_similar import groups_by_hand, shingles_of


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest tables with odd rows among the documents."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = frame(spark, [(None if i is None else i + 10_000, t, lang) for i, t, lang in ROWS])
    docs.unionByName(odd.select(docs.columns)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(frame_):
    return [(r.doc_id, r.text, None) for r in frame_.collect()]


def test_every_stage_against_a_plain_version(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{name}")
        outs[name] = (before, spark.read.parquet(f"{tmp_path}/{name}"))
        before = outs[name][1]
    for name in ("language", "line_dedup", "near_duplicates", "decontaminate"):
        assert outs[name][1].columns == docs.columns

    given, kept = map(rows_of, outs["language"])
    lettered = sorted((r for r in given if any(map(str.isalpha, r[1] or ""))), key=key)
    assert len(kept) >= 0.98 * len(lettered) and all(any(map(str.isalpha, t)) for _, t, _ in kept)

    given, kept = map(rows_of, outs["line_dedup"])
    wanted = [(i, t, lost) for i, t, _, lost in kept_by_hand(given) if not lost or t.strip()]
    assert any(lost for *_, lost in wanted)
    assert sorted(((i, t) for i, t, _ in kept), key=key) == [(i, t) for i, t, _ in wanted]

    given, kept = map(rows_of, outs["near_duplicates"])
    staying = {(i, t) for i, t, _ in kept}
    assert len(kept) == sum(1 if shingles_of(given[min(group)][1]) else len(group)
                            for group in groups_by_hand(given))
    for group in groups_by_hand(given):
        members = {given[i][:2] for i in group}
        least = min((i for i, _ in members if i is not None), default=None)
        assert [i for i, t in staying & members] == [least]

    given, kept = map(rows_of, outs["decontaminate"])
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [i for i, _, hit, _ in contamination_by_hand(given, items) if not hit]
    assert sorted((i for i, _, _ in kept), key=lambda x: key([x])) == clean

    given = rows_of(outs["byte_bpe"][0])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    wanted = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in given]
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist())
           for r in outs["byte_bpe"][1].collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)

    assert sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()
                  if r.doc_id is not None) == sorted(
        (i, np.array(x, "<u4").tobytes()) for i, x in wanted if i is not None)


def test_copies_do_not_get_through(spark, folder):
    """Of documents and as many exact copies, also without an id, one of each stays."""
    texts = ["\n".join(f"document {n} says in its line {i} what no other one does {n * i}" for i in range(6))
             for n in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t, "en") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en"), (None, "\n\n", "en"), (5, "another text under the id of five " * 3, "en")]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, folder)
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
    assert kept == sorted([*enumerate(texts), (None, "\n\n"), rows[-1][:2]], key=key)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
