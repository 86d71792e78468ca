"""Repeated passages by phrase automata.

A window is `length` words in a row. Each word covered by a window that also starts in a document of smaller id is removed.
Windows are dealt by anchors (see anchors.py), over hashes of words, in three passes over the texts:

1. anchors are counted, only those that occur twice or more can lie in a recurring passage;
2. the runs of windows of such anchors are put together with their like: runs of one anchor and the same words are a class,
   for which one member of the smallest id and, once more, one of a greater id stand. A shard holds the classes of some
   anchors. It confirms, word by word, which windows recur, and joins those that have their first document in one run to
   passages. Of each passage it takes the words that all its windows share, compiles these phrases to an Aho-Corasick
   automaton (a character stands for a word) and streams every run through it; where a phrase occurs, the passage is
   compared word by word to the left and right, which gives the windows that occur there. What is located in a member goes
   for all of its class with its id or, in the one of a greater id, for all of greater ids. This is done with the classes of
   each batch first, together with what its task has sent on before, so that thousands of copies in a task send on one, and
   then, with what stands for the classes of all tasks, by bucket of anchors. All documents' recurring runs reach some shard, so every occurrence is located, while
   no automaton grows with the corpus;
3. spans are kept in the shared folder, sorted by document; workers map them and drop words.

Defined cases: a null text has no words; rows that repeat an id are one document, so they don't repeat each other; null ids
come before all others; texts of fewer words than `length` lose nothing; very long texts are cut into runs like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._core import U64, bucket_bits, cuts, join_arrays, join_packed, merge_by_bucket, packed, pick, sliced, unpacked, utf8, words_of
from .anchors import SpanStore, key_of, kgrams, recurring, recurring_runs, row_keys, runs, scatter_keys, scatter_spans, span_store
from .suffixes import REMEMBERED, ROWS, Sent, classes, ragged

LENGTH, ANCHOR = 50, 8
MB_EACH = 8.0
#: Windows of runs that one automaton works on, unless one anchor has more.
WINDOWS = 1 << 17


def _runs(column: pa.Array, length: int, anchor: int) -> tuple:
    starts, codes, distinct = words_of(column)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))
    symbols = hashes[codes] if len(codes) else np.empty(0, U64)
    return starts, codes, distinct, symbols, runs(symbols, starts, length, anchor)


FIELDS = (("key", U64), ("doc", np.int64), ("owner", U64), ("at", np.int64), ("windows", np.int64))


class Shard:
    """Runs of some anchors as word numbers, one after another."""

    def __init__(self, texts: list[bytes], doc: np.ndarray, windows: np.ndarray, length: int):
        numbers: dict[bytes, int] = {}
        split = [t.split() for t in texts]
        self.words = np.array([numbers.setdefault(w, len(numbers)) for t in split for w in t], np.int64)
        self.begin = np.append(0, np.cumsum([len(t) for t in split]))
        self.doc, self.windows, self.length = doc, windows, length
        codes = (self.words % (1 << 20) + 0x10000).astype("<u4")  # two words may share a character: what is found is compared
        self.stream = codes.tobytes().decode("utf-32-le")

    def confirm(self) -> list[tuple[int, int, int]]:
        """(run, first, last window) of passages: windows that occur in two documents at least, held by the run of the
        smallest id that has them. Equal hashes are compared word by word."""
        at = ragged(self.begin[:-1], self.windows)
        run = np.repeat(np.arange(len(self.windows)), self.windows)
        hashes = kgrams(self.words.astype(U64), self.length)[at]
        order = np.lexsort((at, self.doc[run], hashes))
        same = np.append(False, hashes[order][1:] == hashes[order][:-1])
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(order) else order
        step = np.arange(self.length)
        for low in range(0, len(order), 1 << 14):
            i = np.flatnonzero(same[low : low + (1 << 14)]) + low
            a, b = at[order[i]], at[order[head[i]]]
            if (self.words[a[:, None] + step] != self.words[b[:, None] + step]).any():  # two windows share a hash: ranked by their words
                exact = np.unique(self.words[at[:, None] + step], axis=0, return_inverse=True)[1].reshape(-1)
                order = np.lexsort((at, self.doc[run], exact))
                same = np.append(False, exact[order][1:] == exact[order][:-1])
                head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                break
        later = same & (self.doc[run[order]] > self.doc[run[order[head]]])
        firsts = np.zeros(len(at), bool)
        firsts[order[head[later]]] = True
        hit = np.flatnonzero(firsts)
        if not len(hit):
            return []
        new = np.append(True, (run[hit][1:] != run[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(hit)) - 1
        return [(int(run[hit[a]]), int(at[hit[a]] - self.begin[run[hit[a]]]), int(at[hit[b]] - self.begin[run[hit[b]]])) for a, b in zip(start, stop, strict=True)]

    def locate(self) -> Iterator[tuple[int, int, int]]:
        """(run, first, last window) of every occurrence, in a document of greater id, of windows of passages."""
        phrases: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for run, first, last in self.confirm():
            while first <= last:  # all windows of a part share length - (end - first) words
                end = min(last, first + self.length // 2)
                base = int(self.begin[run])
                phrases[self.stream[base + end : base + first + self.length]].append((run, first, end))
                first = end + 1
        if not phrases:
            return
        automaton = ahocorasick.Automaton()
        for phrase, passages in phrases.items():
            automaton.add_word(phrase, (len(phrase), passages))
        automaton.make_automaton()
        words, n = self.words, self.length
        for i in range(len(self.windows)):
            low, high = int(self.begin[i]), int(self.begin[i + 1])
            for stop, (size, passages) in automaton.iter(self.stream, low, high):
                here = stop + 1 - size
                for run, first, last in passages:
                    if self.doc[run] >= self.doc[i]:
                        continue
                    there = int(self.begin[run]) + last  # the phrase in its passage
                    if not np.array_equal(words[here : here + size], words[there : there + size]):
                        continue
                    left = _common(words[max(low, here - (last - first)) : here][::-1], words[there - (last - first) : there][::-1])
                    right = _common(words[here + size : min(high, here + n)], words[there + size : there + n])
                    # windows that begin at here - left .. and end by here + size + right
                    a, b = here - left, here + size + right - n
                    if a <= b:
                        yield i, a - low, b - low


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def mark(group: np.ndarray, of: np.ndarray, texts: list[bytes], f: dict[str, np.ndarray], length: int, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Keys of documents and their spans of words to remove, and which rows have the smallest id of their class. group: of each
    class, whose windows are compared; of: each run's class; texts: of the classes; most: windows of one automaton."""
    order = np.lexsort((f["at"], f["owner"], f["doc"], of))
    number = of[order]
    lead = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    ends = np.append(lead[1:], len(order))
    place = np.cumsum(np.append(False, number[1:] != number[:-1]))  # of each row's class, in this order
    later = f["doc"][order] > f["doc"][order[lead[place]]]
    second = ends - np.add.reduceat(later.astype(np.int64), lead)  # the first row of a greater id; the end where there is none
    # items: what stands for the smallest id, and for the greater ones; each stands for the rows low .. high
    low, high = np.concatenate([lead, second[second < ends]]), np.concatenate([second, ends[second < ends]])
    many = np.bincount(group[number[low]], minlength=int(group.max()) + 1)[group[number[low]]] > 1
    low, high = low[many], high[many]
    rank = np.lexsort((f["doc"][order[low]], group[number[low]]))
    low, high = low[rank], high[rank]
    own = group[number[low]]
    windows = f["windows"][order[low]]
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    stops, reach = np.append(begins[1:], len(own)), np.append(0, np.cumsum(windows))
    marks = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))]
    g = 0
    while g < len(begins):
        h = max(g + 1, int(np.searchsorted(reach[stops], reach[begins[g]] + most, "right")))
        c = slice(int(begins[g]), int(stops[h - 1]))
        g = h
        shard = Shard([texts[i] for i in number[low[c]].tolist()], f["doc"][order[low[c]]], windows[c], length)
        found = np.array(list(shard.locate()), np.int64).reshape(-1, 3)
        if not len(found):
            continue
        count = (high - low)[c][found[:, 0]]
        rows = order[ragged(low[c][found[:, 0]], count)]
        first, last = np.repeat(found[:, 1], count), np.repeat(found[:, 2], count)
        marks.append((f["owner"][rows], f["at"][rows] + first, f["at"][rows] + last + length))
    return tuple(np.concatenate(x) for x in zip(*marks, strict=True)), order[~later]


def mark_bucket(rows: list[dict], length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what stands for the classes of all batches: keys of documents and their spans of words to remove."""
    f = {n: join_packed(rows, n, t) for n, t in FIELDS}
    if not len(f["key"]):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    texts = [t for r in rows for t in unpacked(r["text"]).split(b"\n")[:-1]]
    of, first = classes(f["key"].tolist(), texts)
    group = np.unique(f["key"][first], return_inverse=True)[1]
    return mark(group, of, [texts[i] for i in first.tolist()], f, length, most)[0]


def mark_batch(key: np.ndarray, texts: list[bytes], f: dict[str, np.ndarray], length: int, most: int, sent: Sent) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Marks of a batch's equal runs, and the runs (by key) with the smallest id of their class, which are to be sent on."""
    if not len(key):
        return (np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)), np.empty(0, np.int64)
    texts, f = sent.joined(key, texts, f)
    of, one = classes(f["key"].tolist(), texts)
    marks, lead = mark(np.arange(len(one)), of, [texts[i] for i in one.tolist()], f, length, most)
    lead = lead[lead < len(key)]  # rows of this batch
    lead = lead[np.argsort(key[lead], kind="stable")]
    sent.keep([texts[i] for i in lead.tolist()], {n: v[lead] for n, v in f.items()})
    return marks, lead


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> SpanStore:
    """Spans of words to remove."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"))
    bits = bucket_bits(docs, MB_EACH)
    most, at_once, remembered = WINDOWS, ROWS, REMEMBERED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at_once):
            yield scatter_keys(_runs(batch.column(0), length, anchor)[-1][0], bits)

    again = recurring(docs.select("text").mapInArrow(count, "bucket int, keys binary, times binary"), bits, "phrases")
    columns = "bucket int, key binary, doc binary, owner binary, at binary, windows binary, text binary, keys binary, low binary, high binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent(remembered)
        for batch in sliced(batches, at_once):
            ids, _, owners = row_keys(batch.column(0), utf8(batch.column(1)))
            starts, codes, distinct, symbols, found = _runs(batch.column(1), length, anchor)
            key, row, first, last = recurring_runs(again, symbols, starts, length, anchor, found)
            low, high = starts[row] + first, starts[row] + last + length - 1
            texts = [b" ".join([distinct[c] for c in codes[x:y].tolist()]) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            f = dict(zip([n for n, _ in FIELDS], (key, ids[row], owners[row], first, last - first), strict=True))
            marks, lead = mark_batch(key, texts, f, length, most, sent)
            empty = dict.fromkeys(names[1:], b"")
            out = [empty | s for s in scatter_spans(*marks, bits)]
            at = cuts(key[lead], bits)
            for b in np.flatnonzero(np.diff(at)):
                s = lead[at[b] : at[b + 1]]
                out.append(empty | {"bucket": int(b), "text": packed(b"".join(texts[i] + b"\n" for i in s.tolist()))} | {n: packed(f[n][s]) for n, _ in FIELDS})
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.int32() if n == "bucket" else pa.binary()) for n in names], names=names)

    def merge(_: int, rows: list[dict]) -> Iterator[dict]:
        marked = mark_bucket(rows, length, most)
        kept = [join_arrays(rows, n, t) for n, t in (("keys", U64), ("low", np.int64), ("high", np.int64))]
        yield from scatter_spans(*(np.concatenate(x) for x in zip(marked, kept, strict=True)), bits)

    marked = merge_by_bucket(docs.mapInArrow(collect, columns), bits, merge, "bucket int, keys binary, low binary, high binary")
    return span_store(marked, bits, "passages")


def remove_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, kept string (words joined by one space), removed array<struct<low, high>>: runs of words."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"))
    spans = repeated(docs, length, anchor)
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = utf8(batch.column(1))
            counts, kept, removed = [], [], []
            for text, found in zip(held, spans.of(row_keys(batch.column(0), held)[2]), strict=True):
                words = text.split()
                counts.append(len(words))
                gone = [] if found is None else list(zip(found[0].tolist(), found[1].tolist(), strict=True))
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words).decode("utf-8"))
                removed.append([{"low": a, "high": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kind)], names=["doc_id", "n_words", "kept", "removed"])

    return docs.mapInArrow(run, "doc_id long, n_words long, kept string, removed array<struct<low:long,high:long>>")
