import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import kneser_ney as kn

from . import cases


class Slow:
    """The same model from dictionaries."""

    def __init__(self, train):
        self.uni, self.big = Counter(), Counter()
        for t in train:
            w = ["<s>", *t, "</s>"]
            self.uni.update(w[1:])
            self.big.update(zip(w, w[1:]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.before = Counter(w for _, w in self.big)
        self.ctx, self.followers = Counter(), defaultdict(Counter)
        for (u, _), c in self.big.items():
            self.ctx[u] += c
            self.followers[u][min(c, 3)] += 1
        self.d2 = kn.discounts([sum(c == k for c in self.big.values()) for k in (1, 2, 3, 4)])
        self.d1 = kn.discounts([sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)])

    def low(self, w):
        kinds = len(self.big)
        left = sum(self.d1[min(c, 3)] for c in self.before.values()) / kinds
        c = self.before[w]
        return max(c - self.d1[min(c, 3)], 0) / kinds + left / (self.v + 1)

    def p(self, u, w):
        if not self.ctx[u]:
            return self.low(w)
        c = self.big[(u, w)]
        share = sum(self.d2[k] * n for k, n in self.followers[u].items()) / self.ctx[u]
        return max(c - self.d2[min(c, 3)], 0) / self.ctx[u] + share * self.low(w)

    def row(self, t):
        w = ["<s>", *t, "</s>"]
        base = sum(math.log10((self.uni[x] + 1) / (self.n + self.v + 1)) for x in w[1:])
        return len(w) - 1, sum(self.uni[x] > 0 for x in w[1:]), base, sum(math.log10(self.p(a, b)) for a, b in zip(w, w[1:]))


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("mb", [16.0, 0.001])
def test_model_equals_brute_force(spark, monkeypatch, mb):
    monkeypatch.setattr(kn, "MB_EACH", mb)
    rows = cases.odd_rows() + [(200 + i, cases.prose(i % 13, 50 + i), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    train = [words(r[1]) for r in rows if r[0] is not None and r[0] % 3]
    slow, model = Slow(train), kn.learn(df.where("doc_id % 3 <> 0"))
    assert (model.tokens, model.vocabulary) == (slow.n, slow.v)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in kn.score(df, model).collect()), key=str)
    want = sorted(((r[0] is None, r[0] or 0, *slow.row(words(r[1]))) for r in rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    # probabilities of all words and the unknown one add up to one
    for u in ("<s>", "the", "never-seen"):
        assert sum(slow.p(u, w) for w in [*slow.uni, "never-seen-either"]) == pytest.approx(1)


@pytest.mark.parametrize("mb,many", [(16.0, 32), (0.001, 1)])
def test_order_three_equals_brute_force(spark, monkeypatch, mb, many):
    monkeypatch.setattr(kn, "MB_EACH", mb)
    monkeypatch.setattr(kn, "MANY", many)
    rows = cases.odd_rows() + [(200 + i, cases.prose(i % 13, 50 + i), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    tri = Counter()
    train = [words(r[1]) for r in rows if r[0] is not None and r[0] % 3]
    for t in train:
        w = ["<s>", "<s>", *t, "</s>"]
        tri.update(zip(w, w[1:], w[2:]))
    slow = Slow(train)
    slow.big = Counter((v, w) for _, v, w in tri)  # distinct predecessors
    slow.before = Counter(w for _, w in slow.big)
    slow.ctx, slow.followers = Counter(), defaultdict(Counter)
    for (v, _), c in slow.big.items():
        slow.ctx[v] += c
        slow.followers[v][min(c, 3)] += 1
    slow.d2 = kn.discounts([sum(c == k for c in slow.big.values()) for k in (1, 2, 3, 4)])
    d3 = kn.discounts([sum(c == k for c in tri.values()) for k in (1, 2, 3, 4)])
    ctx, followers = Counter(), defaultdict(Counter)
    for (u, v, _), c in tri.items():
        ctx[u, v] += c
        followers[u, v][min(c, 3)] += 1

    def p(u, v, w):
        if not ctx[u, v]:
            return slow.p(v, w)
        c = tri[u, v, w]
        return max(c - d3[min(c, 3)], 0) / ctx[u, v] + sum(d3[k] * n for k, n in followers[u, v].items()) / ctx[u, v] * slow.p(v, w)

    def total(t):
        w = ["<s>", "<s>", *t, "</s>"]
        return sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:]))

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in kn.score(df, kn.learn(df.where("doc_id % 3 <> 0"), order=3)).collect()), key=str)
    want = sorted(((r[0] is None, r[0] or 0, len(words(r[1])) + 1, total(words(r[1]))) for r in rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)
    for u, v in (("<s>", "<s>"), ("<s>", "the"), ("river", "the")):
        assert sum(p(u, v, w) for w in [*slow.uni, "never-seen-either"]) == pytest.approx(1)
    nothing = kn.score(df, kn.learn(cases.empty(spark), order=3)).collect()
    assert len(nothing) == len(rows) and all(r.score == 0 for r in nothing)


def test_odd_empty_and_untaught(spark):
    model = kn.learn(cases.empty(spark))
    got = kn.score(cases.odd(spark), model).collect()
    assert len(got) == len(cases.odd_rows()) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert kn.score(cases.empty(spark), model).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 17, 21, 32])
def test_pairs_are_scrambled_one_to_one(bits):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << bits, 1000) for _ in range(2))
    code = kn.Pairs(bits)
    keys = code.keys(a, b)
    back = code.words(keys)
    assert np.array_equal(back[0], a) and np.array_equal(back[1], b)
    assert len(np.unique(keys)) == len(set(zip(a.tolist(), b.tolist())))
    for bucket_bits in (2, 5, 14):
        ranked = np.sort(np.unique(keys))
        bucket = ranked >> np.uint64(64 - bucket_bits)
        part, low = code.split(ranked, bucket_bits)
        assert (part < code.parts(bucket_bits)).all() and len(set(zip(bucket.tolist(), part.tolist(), low.tolist()))) == len(ranked)
        order = np.lexsort((low, part, bucket))
        assert np.array_equal(order, np.arange(len(ranked)))
    with pytest.raises(OverflowError):
        kn.Pairs.of((1 << 32) + 1)


def test_numbers_come_back(tmp_path):
    for values in ([], [0], [1, 2, 300, 1 << 40], list(range(1000)), [(1 << 64) - 1, 0]):
        x = np.array(values, np.uint64)
        assert np.array_equal(kn.unplanes(kn.planes(x)), x)
        assert np.array_equal(kn.unsteps(kn.steps(np.sort(x))), np.sort(x))
        assert np.array_equal(kn.narrow(x).astype(np.uint64), x)
    n = np.array([1, 255, 3, 1 << 33, 254, 0, 256, 7], np.int64)
    kn.save_counts(str(tmp_path), "c", 0, n)
    at = np.array([3, 0, 6, 1, 4, 3])
    assert np.array_equal(kn.counts_at(str(tmp_path), "c", 0, at), n[at])


def test_places_are_found_part_by_part_and_in_ranges_that_close():
    import numpy as np

    from quire.llm import kneser_ney as kn

    rng = np.random.default_rng(9)
    sizes = rng.integers(0, 256, 1000, dtype=np.uint8)
    place = np.arange(1000)
    assert kn.sums_before(sizes, place).tolist() == [int(sizes[p // kn.STEP * kn.STEP : p].sum()) for p in place]
    parts = [np.unique(rng.integers(0, 500, n)).astype(np.uint32) for n in (300, 0, 40, 1)]
    held, begin = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    for n in (20, 4000):  # few values a part, many
        asked = np.unique(rng.integers(0, 2000, n))
        part, low = asked // 500, (asked % 500).astype(np.uint32)
        at, hit = kn.search(held, low, part, begin)
        assert hit.tolist() == [x in parts[p] for p, x in zip(part, low)] and (held[at[hit]] == low[hit]).all()
    looked = []
    low, high = np.array([0, 0]), np.array([1, 1024])
    kn.bisect(lambda i: looked.append(len(i)) or i, np.array([0, 700]), low, high)
    assert looked[0] == 2 and set(looked[1:]) == {1}  # a closed range isn't looked at again
    for spare in (0, 24):
        contexts, words = rng.integers(0, 30, 3000).astype(np.uint64) << np.uint64(24), rng.integers(0, 20, 3000).astype(np.uint32)
        want, times = np.unique(np.stack([contexts, words.astype(np.uint64)], 1), axis=0, return_counts=True)
        c, w, n = kn._distinct_triples(contexts, words, spare)
        assert (c == want[:, 0]).all() and (w == want[:, 1]).all() and (n == times).all()
        c, w, n = kn._distinct_triples(contexts, words, spare, np.full(3000, 2))
        assert (c == want[:, 0]).all() and (w == want[:, 1]).all() and (n == 2 * times).all()
