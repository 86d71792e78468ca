import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import anchors, suffixes

from . import cases


def rows_of(seed):
    rng = random.Random(seed)
    base = [cases.prose(i, 60).encode().decode() for i in range(6)]
    rows = list(cases.odd_rows())
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 130))
            piece = b[a : a + rng.randint(20, 260)]
            if rng.random() < 0.4:
                k = rng.randint(0, len(piece) - 1)
                piece = piece[:k] + "é" + piece[k + 1 :]
            parts.append(piece)
        rows.append((20 + i, " ".join(parts), "en", "s", 1))
    rows.append((70, "ab" * 400 + cases.prose(2, 30), "en", "s", 1))
    rng.shuffle(rows)
    return rows


def slow_bytes(rows, length):
    """doc key -> marked mask"""
    docs = sorted({(-(1 << 63) if d is None else d, __import__("xxhash").xxh3_64_intdigest((t or "").encode()), t or "") for d, t, *_ in rows})
    seen, out = set(), {}
    for d, h, t in docs:
        data = t.encode()
        mask = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                mask[i : i + length] = True
            seen.add(w)
        out[(d, t)] = mask
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(suffixes, "TEXT", 500)
        monkeypatch.setattr(suffixes, "ROWS", 3)
    if seed == 3:
        monkeypatch.setattr(anchors, "HOT", 2)
        monkeypatch.setattr(suffixes, "ROWS", 2)
        monkeypatch.setattr(suffixes, "REMEMBERED", 300)
    rows = rows_of(seed)
    want = slow_bytes(rows, 100)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, cases.SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    expect = []
    for d, t, *_ in rows:
        mask = want[(-(1 << 63) if d is None else d, t or "")]
        data = np.frombuffer((t or "").encode(), np.uint8)
        expect.append((d is None, d or 0, len(data), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), data[~mask].tobytes()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, sum(s.high - s.low for s in r.removed), len(r.removed), bytes(r.kept)) for r in got) == sorted(expect)


def test_every_mark_comes_from_the_transform(monkeypatch):
    texts = [t.encode() for t in (cases.prose(1, 80), cases.prose(1, 80), cases.prose(1, 80) + cases.prose(2, 40), cases.prose(3, 50))]
    symbols, starts = suffixes._symbols(texts)
    found = anchors.runs(symbols, starts, 100, 32)
    ids, hashes = np.arange(4), np.arange(4).astype(np.uint64)

    def both():
        marks, lead_texts, values = suffixes.mark_batch(found, texts, ids, hashes, 100, 1 << 19, suffixes.Sent(1 << 20))
        row = {n: suffixes.packed(values[n]) for n, _ in suffixes.FIELDS} | {"text": suffixes.packed(b"".join(lead_texts))}
        spans = anchors.merged(*(np.concatenate(x) for x in zip(marks, suffixes.mark_bucket([row], 100, 1 << 19))))
        gone = Counter()
        for k, a, b in zip(*spans):
            gone[int(np.flatnonzero(anchors.key_of(ids, hashes) == k)[0])] += int(b - a)
        return gone

    assert both() == {1: len(texts[1]), 2: len(texts[0])}
    monkeypatch.setattr(suffixes, "equal_windows", lambda data, starts, length: np.arange(len(starts)))
    assert not both()


def test_odd_and_empty(spark):
    assert suffixes.remove_repeats(cases.odd(spark)).count() == len(cases.odd_rows())
    assert suffixes.remove_repeats(cases.empty(spark)).count() == 0
    cut = suffixes.cut_texts(spark.createDataFrame(cases.odd_rows(), cases.SCHEMA))
    texts = {r.doc_id: r for r in cut.collect()}
    assert texts[0].text == cases.odd_rows()[0][1] and texts[1].text == "" and texts[1].n_chars == 0


def test_depths_are_common_prefixes():
    rng = np.random.default_rng(3)
    data = np.frombuffer(bytes(rng.integers(97, 99, 300, dtype=np.uint8)) * 2 + bytes(rng.integers(97, 100, 500, dtype=np.uint8)), np.uint8)
    order, parted = suffixes.depths(data, 24)
    ring = data.tobytes() * 2
    tops = [ring[i : i + 24] for i in order.tolist()]
    assert tops == sorted(tops)
    for i in range(1, len(tops)):
        common = next((k for k in range(24) if tops[i][k] != tops[i - 1][k]), 24)
        assert parted[i] == (24 if common == 24 else common // 4 * 4)


def test_intervals_are_extended_by_whole_names():
    rng = np.random.default_rng(5)
    half = bytes(rng.integers(97, 99, 700, dtype=np.uint8))
    data = np.frombuffer(half + half[:350] + b"x" + half[351:], np.uint8)
    order, parted = suffixes.depths(data, 100)
    ring = data.tobytes() * 2
    tops = [ring[i : i + 100] for i in order.tolist()]
    assert tops == sorted(tops) and 100 in parted
    for i in range(1, len(tops)):
        common = next((k for k in range(100) if tops[i][k] != tops[i - 1][k]), 100)
        assert parted[i] == common // 20 * 20  # five steps, not twenty-five


def test_equal_windows_share_anchors():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 255, 3000).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 255, 777).astype(np.uint8), a[500:2500]])
    key, row, first, last = anchors.runs(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 100, 32)
    own = {(r, s): k for k, r, x, y in zip(key, row, first, last) for s in range(x, y)}
    assert len(own) == len(a) + len(b) - 198
    assert all(own[(0, 500 + i)] == own[(1, 777 + i)] for i in range(1901))
    keys, low, high = anchors.merged(np.array([2, 1, 1, 1, 2], np.uint64), np.array([5, 0, 3, 9, 1]), np.array([6, 4, 9, 10, 2]))
    assert (keys.tolist(), low.tolist(), high.tolist()) == ([1, 2, 2], [0, 1, 5], [10, 2, 6])


def passage_rows(seed):
    rng = random.Random(seed)
    base = [cases.prose(i, 120).split() for i in range(5)]
    rows = list(cases.odd_rows())
    for i in range(50):
        words = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, 60)
            piece = b[a : a + rng.randint(10, 110)]
            if rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = f"odd{rng.randint(0, 3)}"
            words += piece
        rows.append((rng.choice([20 + i, 21]), rng.choice([" ", "\n", " \t "]).join(words), "en", "s", 1))
    rows.append((90, "la " * 130, "en", "s", 1))
    rows.append((91, "la " * 70, "en", "s", 1))
    rng.shuffle(rows)
    return rows


def slow_words(rows, length):
    first = {}
    split = [((-(1 << 63) if d is None else d), (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        mask = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                mask[i : i + length] = True
        out.append((d, len(w), int(mask.sum()), b" ".join(x for x, m in zip(w, mask) if not m).decode()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_equal_brute_force(spark, seed, monkeypatch):
    from quire.llm import passages

    if seed == 2:
        monkeypatch.setattr(passages, "WINDOWS", 60)
        monkeypatch.setattr(passages, "ROWS", 3)
    if seed == 3:
        monkeypatch.setattr(anchors, "HOT", 2)
        monkeypatch.setattr(passages, "ROWS", 2)
        monkeypatch.setattr(passages, "REMEMBERED", 300)
    rows = passage_rows(seed)
    got = passages.remove_passages(spark.createDataFrame(rows, cases.SCHEMA).repartition(5)).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, sum(s.high - s.low for s in r.removed), r.kept) for r in got) == sorted(slow_words(rows, 50))


def passage_marks(texts, ids):
    from quire.llm import passages

    column = passages.pa.array(texts)
    starts, codes, distinct, _, (key, row, first, last) = passages._runs(column, 50, 8)
    words = [" ".join([distinct[c].decode() for c in codes[starts[r] + a : starts[r] + b + 49]]).encode() for r, a, b in zip(row, first, last)]
    owners = anchors.key_of(ids, ids.astype(np.uint64))
    f = dict(zip([n for n, _ in passages.FIELDS], (key, ids[row], owners[row], first, last - first)))
    marks, lead = passages.mark_batch(key, words, f, 50, 1 << 17, suffixes.Sent(1 << 20))
    sent = {n: suffixes.packed(f[n][lead]) for n, _ in passages.FIELDS} | {"text": suffixes.packed(b"".join(words[i] + b"\n" for i in lead))}
    spans = anchors.merged(*(np.concatenate(x) for x in zip(marks, passages.mark_bucket([sent], 50, 1 << 17))))
    gone = Counter()
    for k, a, b in zip(*spans):
        gone[int(ids[np.flatnonzero(owners == k)[0]])] += int(b - a)
    return gone


def test_every_passage_comes_from_the_automaton(monkeypatch):
    from quire.llm import passages

    a, b = cases.prose(1, 80), cases.prose(2, 70)
    texts, ids = [a, a, f"{a} {b}", b, a, cases.prose(9, 60)], np.array([3, 5, 7, 9, 11, 12])
    assert passage_marks(texts, ids) == {5: 80, 7: 80, 9: 70, 11: 80}

    class Silent:
        def add_word(self, *_):
            pass

        def make_automaton(self):
            pass

        def iter(self, *_):
            return iter(())

    monkeypatch.setattr(passages.ahocorasick, "Automaton", Silent)
    assert not passage_marks(texts, ids)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    from quire.llm import passages

    a, b = cases.prose(1, 80), cases.prose(2, 70)
    texts, ids = [a, a, f"{a} {b}", b, cases.prose(9, 60)], np.array([3, 5, 7, 9, 12])
    want = passage_marks(texts, ids)
    monkeypatch.setattr(passages, "kgrams", lambda symbols, k: np.zeros(max(0, len(symbols) - k + 1), np.uint64))
    assert passage_marks(texts, ids) == want and want


def test_passages_odd_and_empty(spark):
    from quire.llm import passages

    assert passages.remove_passages(cases.odd(spark)).count() == len(cases.odd_rows())
    assert passages.remove_passages(cases.empty(spark)).count() == 0


def test_phrases_without_passages(spark):
    from quire.llm import passages

    shared = cases.prose(1, 20)
    rows = [(i, f"{cases.prose(50 + i, 60)} {shared} {cases.prose(90 + i, 60)}") for i in range(4)]
    got = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(not r.removed and r.kept == " ".join(dict(rows)[r.doc_id].split()) for r in got) and len(got) == 4


def test_split_keys_keep_every_window_and_equal_ones_together():
    rng = np.random.default_rng(8)
    phrase = rng.integers(0, 255, 40).astype(np.uint8)
    rows = [np.concatenate([rng.integers(0, 255, 90).astype(np.uint8), phrase, rng.integers(0, 255, 90).astype(np.uint8)]) for _ in range(30)]
    rows.append(rows[0][20:])
    starts, data = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    found = anchors.runs(data, starts, 100, 32)
    split = anchors.split_hot(data, starts, 100, 32, found, np.ones(len(found[0]), bool))
    windows = lambda f: {(r, s): k for k, r, a, b in zip(*f) for s in range(a, b)}
    before, after = windows(found), windows(split)
    assert before.keys() == after.keys() and sum(b - a for _, _, a, b in zip(*split)) == len(after)
    assert all(after[(0, 20 + i)] == after[(30, i)] for i in range(len(rows[30]) - 99))
    most = lambda f: np.unique(f[0], return_counts=True)[1].max()
    assert most(split) < most(found)
