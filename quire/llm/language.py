"""Language by rank-order profiles: a document's most frequent character n-grams against each language's, by out-of-place distance.

N-grams are runs of one to three letters of a lower-cased word between two marks of its ends. A profile is the TOP most
frequent, ties by the n-gram's code points. The distance of a document to a language is the sum, over the document's
profile, of the difference of ranks, or TOP where the language lacks the n-gram; the least distance wins, ties by the
language's name. The score is 1 - distance / greatest possible distance.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is all where nothing was learned;
rows without a language teach nothing; repeated rows count as often as they occur; very long texts are counted whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._core import pick, texts

TOP = 300
#: Parts into which a language's n-grams are dealt for their first ranking.
PARTS = 16
LETTERS = re.compile(r"[^\W\d_]+")
MARK = ord(" ")
UNKNOWN = "und"


def ngram_counts(words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, 21 bits a code point, sorted, and how often each occurs."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # times[i]: of the word whose leading mark or letter is at i; the last mark belongs to none
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths)
    letter = codes[:-1] != MARK
    two = codes[:-1] | codes[1:] << 21
    inner = codes[1:-1] != MARK  # no trigram reaches over a mark
    keys = np.concatenate([codes[:-1][letter], two, (two[:-1] | codes[2:] << 42)[inner]])
    weights = np.concatenate([times[letter], times, times[:-1][inner]])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(weights, start)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    if len(keys) > 4 * top:  # sort only what can be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:top]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    keys: np.ndarray  # of all languages, sorted
    ranks: np.ndarray  # key x language, `top` where it lacks the key
    top: int

    def predict(self, text: str) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower()))
        if not self.languages or not any(c.isalpha() for w in words for c in w):  # numerals such as a superscript two aren't letters
            return UNKNOWN, 0.0
        own = ranked(*ngram_counts(words), self.top)
        i = np.searchsorted(self.keys, own)
        i[i == len(self.keys)] = 0
        there = self.keys[i] == own
        away = np.where(there[:, None], np.abs(self.ranks[i] - np.arange(len(own))[:, None]), self.top)
        away[self.ranks[i] == self.top] = self.top
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return self.languages[best], float(1.0 - total[best] / (self.top * len(own)))


def learn(docs: DataFrame, top: int = TOP) -> Profiles:
    """From text and lang; the driver gets at most PARTS x top n-grams a language."""
    docs = pick(docs, "text", "lang").where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words[lang].update(LETTERS.findall(text.lower()))
            for lang, counted in words.items():
                if counted:
                    keys, counts = ngram_counts(counted)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "key", "n"])

    counted = docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(PARTS))).orderBy(F.desc("n"), "key")
    rows = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top).collect()
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((-r["n"], r["key"]))
    languages = tuple(sorted(by))
    profiles = [[k for _, k in sorted(by[x])[:top]] for x in languages]
    keys = np.array(sorted({k for p in profiles for k in p}), np.int64)
    ranks = np.full((len(keys), len(languages)), top, np.int64)
    for j, p in enumerate(profiles):
        ranks[np.searchsorted(keys, np.array(p, np.int64)), j] = np.arange(len(p))
    return Profiles(languages, keys, ranks, top)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
