"""Quality rules: lines that many documents of a host share are removed, and documents that this depletes are rejected.

A line is normalised (A-Z lower-cased, ASCII white space collapsed) and hashed. For every host (column `source`) and line the
distinct documents that hold it are counted, over all documents; a document is known by a hash of its whole text, so that
exact copies of one count once. A line is removed where more than MAX_DOCS documents of the host hold it, and a document is
depleted if less than KEEP_SHARE of its words remain. Pairs of line and document are made distinct within a batch, dealt by
both, counted, and only then added up by line: a line of a third of all documents meets in no task. Removed lines are a store
of sorted hashes in the shared folder, which workers map into memory; texts aren't shuffled.

Base rule: fewer than MIN_WORDS words, or more than half of the words in repeated three-word windows.

Defined cases: a null or empty text has no words and fails the base rule; a null source is a host of its own; repeated
rows are judged alike (and count as one distinct document); very long texts are documents like others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._core import LOWER_AZ, U64, SortedStore, bucket_bits, build_store, cuts, join_arrays, merge_by_bucket, mix64, pick, rewrite_rows, utf8

MIN_WORDS, MAX_DOCS, KEEP_SHARE = 50, 20, 0.2
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_words long, base_failed boolean, kept boolean"


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Hash (the first 64 bits of MD5, which SQL has too) and number of words of each line that has a word."""
    hashes, sizes = [], []
    for line in text.translate(LOWER_AZ).split(b"\n"):
        words = line.split()
        if words:
            hashes.append(int.from_bytes(hashlib.md5(b" ".join(words), usedforsecurity=False).digest()[:8], "big"))
            sizes.append(len(words))
    return hashes, sizes


def _host(source: str | None) -> int:
    return xxhash.xxh3_64_intdigest("\x00" if source is None else "s" + source)


def _keys(hashes: np.ndarray, host: int) -> np.ndarray:
    return mix64(hashes ^ U64(host))


def _scatter(keys: list[np.ndarray], marks: list[int], bits: int) -> pa.RecordBatch:
    """Distinct pairs of a line's key and a document's mark, dealt by both, so that a very common line is spread."""
    pairs = np.stack([np.concatenate(keys), np.repeat(np.array(marks, U64), [len(k) for k in keys])], axis=1)
    deal = mix64(pairs[:, 0] + pairs[:, 1] * U64(0x9E3779B97F4A7C15))
    order = np.argsort(deal)
    pairs, deal = pairs[order], deal[order]
    new = np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))
    pairs = pairs[new]
    at = cuts(deal[new], bits)
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), *[pa.array([np.ascontiguousarray(pairs[at[b] : at[b + 1], i]).tobytes() for b in full], pa.binary()) for i in (0, 1)]], names=["bucket", "keys", "marks"]
    )


def common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> SortedStore:
    """Keys of (host, line) to remove."""
    docs = pick(docs, "text", "source")
    bits = bucket_bits(docs, 64.0)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = [], []
            for text, source in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                h = np.unique(np.array(line_hashes(text)[0], U64))
                if len(h):
                    keys.append(_keys(h, _host(source)))
                    marks.append(xxhash.xxh3_64_intdigest(text))
            if keys:
                yield _scatter(keys, marks, bits)

    def count(_: int, rows: list[dict]) -> Iterator[dict]:
        keys, marks = join_arrays(rows, "keys", U64), join_arrays(rows, "marks", U64)
        order = np.lexsort((marks, keys))
        keys, marks = keys[order], marks[order]
        keys = keys[np.append(True, (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1]))]
        own, n = np.unique(keys, return_counts=True)
        at = cuts(own, bits)
        for b in np.flatnonzero(np.diff(at)):
            s = slice(at[b], at[b + 1])
            yield {"bucket": int(b), "keys": own[s].tobytes(), "n": n[s].astype(np.int64).tobytes()}

    def judge(rows: list[dict]) -> tuple[np.ndarray, dict]:
        keys, n = join_arrays(rows, "keys", U64), join_arrays(rows, "n", np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[start][np.add.reduceat(n, start) > max_docs], {}

    dealt = docs.mapInArrow(pairs, "bucket int, keys binary, marks binary")
    return build_store(merge_by_bucket(dealt, bits, count, "bucket int, keys binary, n binary"), bits, "lines", judge)


def _judge(texts: list[bytes], sources: list[str | None], common: SortedStore) -> list[np.ndarray]:
    """For each text a mask of its lines with words: which are removed."""
    hashes = [np.array(line_hashes(t)[0], U64) for t in texts]
    keys = [_keys(h, _host(s)) for h, s in zip(hashes, sources, strict=True)]
    found = common.index(np.concatenate(keys) if keys else np.empty(0, U64)) >= 0
    return np.split(found, np.cumsum([len(h) for h in hashes])[:-1]) if hashes else []


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row a document: SCHEMA."""
    docs = pick(docs, "doc_id", "text", "source")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"), docs.source.cast("string"))
    common = common_lines(docs, max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = utf8(batch.column(1))
            masks = _judge(held, batch.column(2).to_pylist(), common)
            out = [[] for _ in range(8)]
            for text, mask in zip(held, masks, strict=True):
                b = base(text)
                gone = int(np.array(line_hashes(text)[1], np.int64)[mask].sum()) if mask.any() else 0
                failed = base_fails(b[0], b[4])
                for column, value in zip(out, (*b, gone, failed, not failed and b[0] - gone >= keep_share * b[0]), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The documents that are kept, without their removed lines; columns stay (n_chars, where present, is counted anew)."""
    common = common_lines(docs, max_docs)
    at_source = docs.columns.index("source")
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(batch: pa.RecordBatch, _: int, at_text: int) -> pa.RecordBatch:
        held = utf8(batch.column(at_text))
        masks = _judge(held, batch.column(at_source).to_pylist(), common)
        keep, out = [], []
        for text, mask in zip(held, masks, strict=True):
            b = base(text)
            gone = int(np.array(line_hashes(text)[1], np.int64)[mask].sum()) if mask.any() else 0
            keep.append(not base_fails(b[0], b[4]) and b[0] - gone >= keep_share * b[0])
            if gone:
                verdict = iter(mask.tolist())
                text = b"\n".join(x for x in text.split(b"\n") if not (x.split() and next(verdict)))
            out.append(text.decode("utf-8", "replace"))
        columns = list(batch.columns)
        columns[at_text] = pa.array(out, batch.schema.field(at_text).type)
        if at_chars is not None:
            columns[at_chars] = pa.array([len(t) for t in out], batch.schema.field(at_chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return rewrite_rows(docs, change)
