import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import anchors, bpe, digest, packing
from quire.llm.suffixes import equal_windows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODER = bpe.PieceEncoder(RANKS, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
TEXTS = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("αβγяжы中文字かな🙂 \n\t'sd1²")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_encoding_equals_tiktoken(texts):
    flat, starts = ENCODER.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [OTHER.encode_ordinary(t) for t in texts]


@settings(deadline=None)
@given(st.integers(1, 10**6), st.integers(0, 13))
def test_pieces_are_powers_of_two_in_falling_order(n, k):
    sizes = packing.piece_lengths(n, 1 << k)
    assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 and s <= 1 << k for s in sizes)
    assert len([s for s in sizes if s < 1 << k]) == len({s for s in sizes if s < 1 << k})


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=400), st.integers(1, 5))
def test_windows_are_equal_where_their_bytes_are(data, repeats):
    import numpy as np

    data = np.frombuffer((data * repeats)[:900], np.uint8) % 3
    starts = np.arange(len(data) - 20 + 1)
    got = equal_windows(data, starts, 20)
    seen: dict[bytes, int] = {}
    for i, g in zip(starts.tolist(), got.tolist()):
        assert seen.setdefault(data[i : i + 20].tobytes(), g) == g
    assert len(set(got.tolist())) == len(seen)


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(1, 20)), max_size=30))
def test_merged_spans_cover_the_same(spans):
    import numpy as np

    keys, low = np.array([s[0] for s in spans], np.uint64), np.array([s[1] for s in spans], np.int64)
    high = low + np.array([s[2] for s in spans], np.int64)
    k, a, b = anchors.merged(keys, low, high)
    cover = lambda ks, xs, ys: {(int(q), p) for q, x, y in zip(ks, xs, ys) for p in range(x, y)}
    assert cover(k, a, b) == cover(keys, low, high)
    assert all(k[i] != k[i + 1] or b[i] < a[i + 1] for i in range(len(k) - 1))


@settings(deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=600))
def test_likeness_is_symmetric_and_bounded(a, b):
    x, y = digest.digest(a), digest.digest(b)
    assert 0 <= digest.likeness(x, y) <= 1 and digest.likeness(x, y) == digest.likeness(y, x) and digest.likeness(x, x) == 1
    assert digest.from_hex(digest.to_hex(x)) == x
