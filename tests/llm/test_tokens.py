import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bpe, packing
from quire.llm._core import words_of

from . import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_encode_equals_tiktoken_and_decodes(spark):
    enc = reference()
    rows = bpe.decode(bpe.encode(cases.odd(spark), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = sorted((r[0] is None, r[0] or 0, enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in cases.odd_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(cases.empty(spark), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_segment_tree_on_a_long_match():
    ranks, enc = bpe.load_ranks(RANKS), reference()
    for piece in ("ab" * 3000, "aaaaab" * 700 + "zq", "x", "日本語" * 50):
        assert bpe.merge_piece(piece.encode(), ranks) == enc._core_bpe.encode_single_piece(piece.encode())


def test_pieces_hold_every_id_once(spark):
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    rows = packing.pack(cases.odd(spark), WORDS, max_len=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    want = []
    for d, t, *_ in cases.odd_rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for n in packing.piece_lengths(len(ids), 64):
            want.append((d is None, d or 0, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens) for r in rows) == sorted(want)
    assert packing.pack(cases.empty(spark), WORDS).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    tok, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    tok.encode_special_tokens = True
    for i in range(6):
        odd = "Élan, don't. (x) a|b élan!! o'er's. É'S, ÿÞß ß. 7up; 12, i\u0307 I\u0307x. <|endoftext|> --, ...".split()
        words = sorted({w.lower() if w.isascii() else w for w in [*cases.prose(i, 40).split(), *odd]})
        words = [w.encode() for w in words]
        got = encoder.ids_of(words)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(w.decode(), add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    pieces = bpe.PieceEncoder(RANKS, public_tokenizers.PATTERN)
    for i in range(6):
        assert pieces.encode([cases.prose(i, 40)])[0].tolist() == reference().encode_ordinary(cases.prose(i, 40))


def test_words_are_split_at_ascii_white_space_only():
    import pyarrow as pa

    rows = ["  A b\tA\n", None, "", "x\u00a0y\x1cz\x0b\x0c\rw", " "]
    starts, codes, distinct = words_of(pa.array(rows), lower=True)
    got = [[distinct[c] for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    assert got == [[b"a", b"b", b"a"], [], [], ["x\u00a0y\x1cz".encode(), b"w"], []]
    assert words_of(pa.array([], pa.string()))[0].tolist() == [0]


def test_the_fast_splitter_splits_alike():
    import random

    import regex

    assert bpe.USUAL == public_tokenizers.PATTERN
    every, split = regex.compile(bpe.USUAL).findall, bpe.splitter(bpe.USUAL)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([chr(rng.randrange(256)), rng.choice("'sd  ré1"), " "]) for _ in range(rng.randrange(60)))
        assert split(text) == every(text)
    assert split("naïve 你好  x") == every("naïve 你好  x") and bpe.splitter("a|b")("abc") == ["a", "b"]
