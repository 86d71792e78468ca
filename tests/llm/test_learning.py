import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quire.llm import language, quality, toxicity
from quire.llm._core import fold

from . import cases

# ---------------------------------------------------------------- language


def slow_profile(texts, top):
    grams = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f" {w} "
            for n in (1, 2, 3):
                grams.update(g for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")
    key = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))[:top]]


LANGS = {"en": "the river of stone and bread was in winter", "de": "der fluss und das brot im winter ist nicht groß", "fr": "la rivière et le pain de l'hiver n'est pas grand"}


def language_rows():
    rows = []
    for i in range(90):
        lang = list(LANGS)[i % 3]
        words = LANGS[lang].split()
        rows.append((i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(9 + i % 20)), lang if i % 10 else None, "s", 1))
    return rows + [(100, None, "en", "s", 1), (101, "123 !! ²", "en", "s", 1), (102, "", None, "s", 1)]


def test_language_equals_brute_force(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    model = language.learn(df.where(fold(df.doc_id, 3) != 1), top=120)
    import zlib

    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}
    profiles = {x: slow_profile([r[1] for r in rows if r[1] and r[2] == x and not held[r[0]]], 120) for x in LANGS}
    right = total = 0
    for r in language.predict(df, model).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        own = slow_profile([text or ""], 120)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {x: sum(abs(i - p.index(g)) if g in p else 120 for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert (r.lang_pred, r.score) == (best, pytest.approx(1 - away[best] / (120 * len(own))))
        total += 1
        right += best == list(LANGS)[r.doc_id % 3]
    assert right / total > 0.95


def test_language_odd_and_empty(spark):
    model = language.learn(cases.odd(spark))
    assert language.predict(cases.odd(spark), model).count() == len(cases.odd_rows())
    nothing = language.learn(cases.empty(spark))
    assert {(r.lang_pred, r.score) for r in language.predict(cases.odd(spark), nothing).collect()} == {("und", 0.0)}
    assert language.predict(cases.empty(spark), model).count() == 0


# ---------------------------------------------------------------- quality


def slow_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def boilerplate_rows():
    rows = list(cases.odd_rows())
    notice = "All rights reserved by the house.\nPlease accept our small notice."
    for i in range(60):
        own = cases.prose(100 + i, 80)
        rows.append((200 + i, f"{notice}\n{own}", "en", "big" if i % 2 else None, 1))
    for i in range(30):  # nothing but notices, and a few words of its own
        rows.append((300 + i, "\n".join([notice] * 6 + [f"word{i}"]), "en", "big", 1))
    copy = cases.prose(7, 120)
    for i in range(50):  # copies of one document, some with an edit
        rows.append((400 + i, copy.replace("river", f"river{i}", 1 if i % 3 == 0 else 0), "en", "big", 1))
    return rows


def slow_kept(rows):
    low = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x)
    norm = lambda x: " ".join(w.decode() for w in low(x).encode().split())
    lines = [[norm(x) for x in (r[1] or "").split("\n") if x.encode().split()] for r in rows]
    holders = defaultdict(set)
    for r, own in zip(rows, lines):
        for x in own:
            holders[(r[3], x)].add(r[1])
    common = {k for k in holders if len(holders[k]) > quality.MAX_DOCS}
    out = []
    for r, own in zip(rows, lines):
        b = slow_base(r[1])
        gone = sum(len(x.encode().split()) for x in own if (r[3], x) in common)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((r[0] is None, r[0] or 0, *b, gone, failed, not failed and b[0] - gone >= 0.2 * b[0]))
    return out


def test_quality_equals_brute_force(spark):
    rows = boilerplate_rows()
    got = quality.judge(spark.createDataFrame(rows, cases.SCHEMA).repartition(5)).collect()
    want = slow_kept(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_removed_words, r.base_failed, r.kept) for r in got) == sorted(want)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[400 + i] for i in range(50)) and all(kept[201 + 2 * i] for i in range(20))
    assert any(r.n_removed_words for r in got) and not any(kept[300 + i] for i in range(30))


def test_quality_cleans_texts(spark):
    rows = boilerplate_rows()
    out = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert "rights reserved" not in out[201].text and out[201].n_chars == len(out[201].text)
    assert out[201].text == cases.prose(101, 80) and 300 not in out and 3 not in out
    assert quality.judge(cases.empty(spark)).count() == 0 and quality.judge(cases.odd(spark)).count() == len(cases.odd_rows())


@pytest.mark.parametrize("notices,own", [(1, 5), (5, 1), (10, 5), (12, 1), (20, 5), (50, 10)])
def test_quality_counts_documents_of_few_own_lines(spark, notices, own):
    notice = [f"notice {j} " + cases.prose(900 + j, 12) for j in range(notices)]
    rows = [(i, "\n".join([*notice, *(f"own {i} {j} " + cases.prose(5000 + 7 * i + j, 12) for j in range(own))]), "en", "host", 1) for i in range(60)]
    got = quality.judge(spark.createDataFrame(rows, cases.SCHEMA).repartition(3)).collect()
    words = sum(len(x.split()) for x in notice)
    assert [r.n_removed_words for r in got] == [words] * 60


def test_quality_copies_count_once(spark):
    rows = [(i, "\n".join(f"line {j} " + cases.prose(700 + 20 * (i % 20) + j, 14) for j in range(8)), "en", "host", 1) for i in range(400)]
    got = quality.judge(spark.createDataFrame(rows, cases.SCHEMA).repartition(3)).collect()
    assert len(got) == 400 and not any(r.n_removed_words for r in got)


def test_quality_copies_do_not_shield_a_line(spark):
    notice = [f"notice {j} " + cases.prose(900 + j, 12) for j in range(6)]
    rows = [(i, "\n".join([*notice, f"own {min(i, 30)} " + cases.prose(5000 + 7 * min(i, 30), 12)]), "en", "host", 1) for i in range(80)]
    got = quality.judge(spark.createDataFrame(rows, cases.SCHEMA).repartition(3)).collect()
    words = sum(len(x.split()) for x in notice)
    removed = {r.n_removed_words for r in got}
    own = {len(r[1].split("\n")[-1].split()) for r in rows if r[0] >= 30}
    assert removed == {words} and len(own) == 1 and not any(r.kept for r in got)


# ---------------------------------------------------------------- toxicity


def slow_toxicity(rows, labels, k):
    """doc_id -> (score, evidence) by all cosines; rows have distinct ids and texts that aren't null."""
    tokens = {r[0]: Counter(re.findall(r"\w+", r[1].lower())) for r in rows}
    taught = {i: y for i, _, y in labels}
    n0, n1 = (sum(y == c for y in taught.values()) for c in (0, 1))
    df = Counter(t for c in tokens.values() for t in c)
    held = [Counter(t for i, y in taught.items() if y == c for t in tokens[i]) for c in (0, 1)]
    weight = {}
    for t in held[0] | held[1]:
        a, b, n = held[0][t], held[1][t], n0 + n1
        gap = max(abs(a * n1 - b * n0) - n / 2, 0)
        chi2 = n * gap * gap / ((a + b) * (n - a - b) * n0 * n1) if a + b < n else 0
        weight[t] = math.log(len(rows) / df[t]) * math.sqrt(1 + max(0, chi2 - 3.84))

    def unit(i):
        v = {t: weight[t] * (1 + math.log(c)) for t, c in tokens[i].items() if weight.get(t, 0) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    units = {r[0]: unit(r[0]) for r in rows}
    place = {t: i for i, t in enumerate(sorted(weight, key=lambda t: xxhash.xxh3_64_intdigest(t.encode())))}
    lead = {i: max(((x, -place[t]) for t, x in units[i].items()), default=(0, 1)) for i in taught}
    ranked = sorted(taught, key=lambda i: (-lead[i][1], taught[i], i))

    def nearest(i, skip):
        cos = [(round(sum(x * units[j].get(t, 0) for t, x in units[i].items()), 12), -n, j) for n, j in enumerate(ranked) if j != skip]
        best = [(c, j) for c, _, j in sorted(cos, reverse=True)[:k] if c > 0]
        return sum(c * taught[j] for c, j in best) / sum(c for c, _ in best) if best else -1, [j for _, j in best]

    votes = {i: nearest(i, i)[0] for i in taught}
    seen = [i for i in taught if votes[i] >= 0]
    curve = toxicity.calibration(np.array([votes[i] for i in seen]), np.array([taught[i] for i in seen], float), np.ones(len(seen)))
    lone = [taught[i] for i in taught if votes[i] < 0]
    none = sum(lone) / len(lone) if lone else n1 / (n0 + n1)
    out = {}
    for r in rows:
        vote, best = nearest(r[0], None)
        out[r[0]] = (1 / (1 + math.exp(-curve[0] - curve[1] * vote)) if vote >= 0 else none, best)
    return out


@pytest.mark.parametrize("block", [4, 32])
def test_toxicity_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows, labels = toxic_rows()
    rows += [(500 + i, cases.prose(1000 + 3 * i, 60), "en", "s", 1) for i in range(9)] + [(600, "nothing known heretofore", "en", "s", 1), (601, "...", "en", "s", 1)]
    want = slow_toxicity(rows, labels, toxicity.NEIGHBOURS)
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) > 20
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][0], abs=1e-9) and r.evidence == want[r.doc_id][1], r.doc_id
    assert all(r.evidence for r in got if r.doc_id < 600)


def test_index_is_exact_over_several_buckets(spark, monkeypatch):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(2)
    taught = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.score(docs, toxicity.learn(docs, taught)).collect()
    monkeypatch.setattr(toxicity, "bucket_bits", lambda *_, **__: 3)
    many = toxicity.score(docs, toxicity.learn(docs, taught)).collect()
    key = lambda got: sorted((r.doc_id, round(r.score, 9), r.evidence) for r in got)
    assert key(one) == key(many)


def test_calibration_fits_and_stays_finite():
    rng = np.random.default_rng(6)
    x, w = rng.random(4000), rng.random(4000) + 0.5
    y = (rng.random(4000) < 1 / (1 + np.exp(3 - 8 * x))).astype(float)
    assert toxicity.calibration(x, y, w) == pytest.approx((-3, 8), rel=0.2)
    a, b = toxicity.calibration(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0.0, 0, 1, 1]), np.ones(4))
    assert np.isfinite(a) and b > 5
    assert np.isfinite(toxicity.calibration(np.full(5, 0.3), np.ones(5), np.ones(5))).all()


def toxic_rows():
    rows, labels = [], []
    for i in range(400):
        text = cases.prose(1000 + i, 60)
        bad = i % 5 == 0
        if bad:
            text = text.replace(" ", [" zorgish ", " zorgon ", " blatherskite "][i // 15 % 3], 1 + i % 2)
        rows.append((i, text, "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_documents_are_found(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows + [(900, None, "en", "s", 1), (901, "", "en", "s", 1)], cases.SCHEMA).repartition(3)
    taught = spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, taught)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].score >= 0.7) == (i % 5 == 0) for i in range(400))
    assert got[900].score == got[901].score < 0.3 and got[900].evidence == [] and len(got[0].evidence) > 0
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {i for i in range(400) if i % 5} | {900, 901}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(cases.odd(spark), none)
    assert {r.score for r in toxicity.score(cases.odd(spark), model).collect()} == {0.0}
    one = toxicity.learn(cases.odd(spark), spark.createDataFrame([(0, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(cases.odd(spark), one).collect()} == {1.0}
    assert toxicity.score(cases.empty(spark), model).count() == 0
