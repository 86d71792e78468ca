import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import packing, quality, simhash

from . import cases
from .test_fingerprints import slow_components, slow_fingerprint
from .test_learning import boilerplate_rows, slow_kept, toxic_rows
from .test_repeats import slow_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = toxic_rows()
    rows = [(r[0] + 1000, *r[1:]) for r in rows] + [r for r in boilerplate_rows() if r[0] not in (None, 9, 12)]
    shared = cases.prose(4242, 70)
    rows += [(3000 + i, f"{cases.prose(5000 + i, 60)} {shared} {cases.prose(6000 + i, 60)}", "en", "s9", 1) for i in range(6)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(a + 1000, q, t) for a, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_equal_brute_force(spark, folder, tmp_path):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # 1: the toxic ones go, and no other
    left = {r.doc_id for r in held["toxicity"]}
    assert left == {r[0] for r in rows} - {1000 + i for i in range(0, 400, 5)}
    # 2
    now = [tuple(r) for r in held["toxicity"]]
    kept = {k[1] for k in slow_kept(now) if k[-1]}
    assert {r.doc_id for r in held["quality"]} == kept
    # 3: the smallest id of each component
    now = [tuple(r) for r in held["quality"]]
    roots = slow_components(now, [slow_fingerprint(r[1]) for r in now], 4)
    assert {r.doc_id for r in held["near_duplicates"]} == set(roots)
    # 4
    now = [tuple(r) for r in held["near_duplicates"]]
    masks = slow_bytes(now, 100)
    for r in held["substrings"]:
        before = next(x[1] for x in now if x[0] == r.doc_id)
        want = np.frombuffer(before.encode(), np.uint8)[~masks[(r.doc_id, before)]].tobytes().decode("utf-8", "ignore")
        assert (r.text, r.n_chars) == (want, len(want))
    assert any(m.any() for m in masks.values())
    # 5
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = set()
    for r in held["substrings"]:
        ids = tok.encode(r.text, add_special_tokens=False).ids + [2]
        at = 0
        for n in packing.piece_lengths(len(ids), 4096):
            want.add((r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert {(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in held["packing"]} == want


def test_run_gives_the_last_stage(spark, folder):
    d, _ = folder
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)
    assert quality.MAX_DOCS and simhash.TILE


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    cases.empty(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
