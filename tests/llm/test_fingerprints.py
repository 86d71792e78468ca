import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from quire.llm import digest, simhash
from quire.llm.components import stars, union_pairs

from . import cases


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, fps, radius):
    n, parent = len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            low[k] = r[0] if low[k] is None else min(low[k], r[0])
    return [low[find(i)] for i in range(n)]


@pytest.mark.parametrize("tile", [8192, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = cases.odd_rows() + [(100 + i, cases.prose(1, 200).replace("lamp", f"lamp{i}", i % 4), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] is None for r in rows], [r[0] or 0 for r in rows], fps, [c if c is not None else -99 for c in slow_components(rows, fps, 4)], strict=True))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), -99 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_odd_and_empty(spark):
    assert simhash.near_duplicates(cases.odd(spark)).count() == len(cases.odd_rows())
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = {r[0] for r in simhash.keep_first(cases.odd(spark)).collect()}
    assert 0 in kept and 1 not in kept


def test_tiles_compare_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    rows = np.unique(np.concatenate([base ^ np.uint64(int(rng.integers(0, 64) and 1) << int(rng.integers(0, 64))) for _ in range(40)]))
    a, b = simhash.compare(rows, np.zeros(len(rows)), 4, False)
    place = {int(x): i for i, x in enumerate(rows)}
    got = union_pairs(np.arange(len(rows)), np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    near = np.bitwise_count(rows[:, None] ^ rows[None]) <= 4
    i, j = np.nonzero(near)
    assert np.array_equal(got, union_pairs(np.arange(len(rows)), i, j))


def test_stars(spark):
    chain = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 70), (80, 80)]
    got = {r.node: r.root for r in stars(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {60: 50, 70: 50}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_against_next(spark):
    rows = cases.odd_rows()
    got = digest.against_next(cases.odd(spark), mb_each=0.0001).collect()
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r)
    plain = {r[0]: r[1] or "" for r in rows if r[0] not in (9, None)}
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    for d in (8, 7, 6, 5, 4, 3, 2, 1, 0):
        text, following = plain[d], plain[ids[(ids.index(d) + 1) % len(ids)]]
        half = len(text) // 2
        mixed = text[: len(text) - half] + following[:half]
        r = seen[d][0]
        assert (r.n_chars, r.edited) == (len(text), mixed)
        assert r.fingerprint == digest.to_hex(digest.digest(text.encode()))
        assert r.edited_fingerprint == digest.to_hex(digest.digest(mixed.encode()))
        assert r.near_next == digest.likeness(digest.digest(text.encode()), digest.digest(following.encode()))
    assert seen[None][0].edited == "id is mis" + (max(r[1] for r in rows if r[0] == 12))[:9]
    assert digest.against_next(cases.empty(spark)).count() == 0
    one = digest.against_next(spark.createDataFrame([(7, "lonely words here")], "doc_id long, text string")).first()
    assert one.edited == "lonely wolonely w"


def test_digest_is_bounded_and_round_trips():
    a, b = digest.digest(cases.prose(1, 500).encode()), digest.digest(b"\x00" * 4000)
    assert digest.from_hex(digest.to_hex(a)) == a and digest.likeness(a, a) == 1.0
    assert 0.0 <= digest.likeness(a, b) <= 1.0 and digest.likeness(a, b) == digest.likeness(b, a)
    near = digest.digest(cases.prose(1, 500).replace("river", "brook", 2).encode())
    assert digest.likeness(a, near) > digest.likeness(a, digest.digest(cases.prose(77, 500).encode())) > 0
    assert digest.digest(b"") == bytes(129)


def test_ranges_hold_every_row_once_and_are_even(spark):
    ids = [i * i for i in range(300)] + [77] * 400  # one id of more than half of the rows
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    key, hash_ = F.col("doc_id"), F.xxhash64("text")
    bounds = digest._bounds(df, key, 16)
    rows = df.select(key.alias("k"), hash_.alias("h"), digest._range_of(bounds, key, hash_).alias("r")).collect()
    assert all(r.r == sum(b > (r.k, r.h) for b in bounds) for r in rows)
    assert max(Counter(r.r for r in rows).values()) < 150
    deal = digest._dealing(spark, 16, 16)
    at = spark.createDataFrame([(v,) for v in deal], "v int").select(F.pmod(F.hash("v"), F.lit(16)).alias("p")).collect()
    assert sorted(r.p for r in at) == list(range(16))


@pytest.mark.parametrize("extra,tile", [(1, 20), (2, 20), (3, 8192)])
def test_links_are_whole_for_every_choice_of_blocks(spark, monkeypatch, extra, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 25).astype(np.uint64) & np.uint64(0xFFFF)  # most blocks agree: meetings are large
    rows = [base]
    for _ in range(6):
        flips = np.zeros(len(base), np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            flips |= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        rows.append(base ^ flips)
    rows = np.unique(np.concatenate(rows))
    near = np.bitwise_count(rows[:, None] ^ rows[None]) <= 4
    want = union_pairs(np.arange(len(rows)), *np.nonzero(near))
    fps = spark.createDataFrame([(int(x),) for x in rows.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(rows.view(np.int64))}
    found = simhash.links(fps, 4, extra).collect()
    assert all(near[place[r.a], place[r.b]] or want[place[r.a]] == want[place[r.b]] for r in found)
    got = union_pairs(np.arange(len(rows)), np.array([place[r.a] for r in found]), np.array([place[r.b] for r in found]))
    assert np.array_equal(got, want)


def test_spread_join_splits_heavy_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 1500)], "k long, v long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as w")
    got = simhash.spread_join(left, right, "k").select("k", "v", "w").collect()
    assert sorted((r.k, r.v, r.w) for r in got) == sorted((r.k, r.v, r.k * 10) for r in left.collect())
