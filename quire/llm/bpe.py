"""Byte-level BPE: text to ids by a rank file, and ids back to bytes.

Each match of the splitting pattern is merged separately. A segment tree over the match's byte positions keeps, for every
range, the least rank of a pair of neighbours and, among equals, the leftmost; a merge takes the root, joins two live
neighbours and updates three leaves, each in logarithmic time, so that one very long match costs n log n.

Defined cases: a null or empty text has no ids and decodes to no bytes; special-token strings are ordinary text; repeated
rows are encoded row by row; very long texts and matches are encoded whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._core import gather, pick, texts

NONE = (1 << 62) - 1
#: Distinct matches whose ids a worker keeps in each of two generations (when the younger is full it becomes the older), and
#: the length up to which it keeps them.
CACHE_PIECES, CACHE_CHARS = 600_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    shift = n.bit_length()  # a node: rank << shift | position, so that the least is the leftmost of the least rank
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))
    place = (1 << shift) - 1
    while (least := tree[1]) != NONE:
        i = least & place
        j = after[i]
        end = after[i] = after[j]  # the joined token is piece[i:end]
        before[end] = i
        r = get(piece[i : after[end]]) if end < n else None
        tree[size + i] = NONE if r is None else r << shift | i
        h = before[i]
        if h >= 0:
            r = get(piece[h:end])
            tree[size + h] = NONE if r is None else r << shift | h
        k = size + j
        if k < 2 * size:  # else j was the last position, which pairs with nothing
            tree[k] = NONE
        else:
            k = size + i
        # all leaves are set: a path that meets one already brought up to date ends there
        for k in (k, size + i, size + h):  # noqa: B020, PLR1704
            k >>= 1  # noqa: PLW2901
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1  # noqa: PLW2901
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


#: The usual splitting pattern, and its classes among the first 256 characters.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern; the usual one takes less time on texts of the first 256 characters."""
    every = regex.compile(pattern).findall
    if pattern != USUAL:
        return every
    latin = re.compile(LATIN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return split


class PieceEncoder(dict):
    """match -> its ids as little-endian 32-bit integers."""

    def __init__(self, rank_path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(rank_path)
        self.older: dict[str, bytes] = {}
        self.find = splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(merge_piece(piece.encode("utf-8"), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and where each text's begin (one more at the end). A distinct match is looked up once."""
        found = list(map(self.find, texts))
        counts = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        coded = pc.dictionary_encode(pa.array(list(chain.from_iterable(found)), pa.string()))
        del found
        flat, each = gather(coded.indices.to_numpy(zero_copy_only=False), list(map(self.__getitem__, coded.dictionary.to_pylist())), 4)
        return flat, np.append(0, np.append(0, np.cumsum(each))[counts])


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}
_TOKENS: dict[str, list[bytes]] = {}


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (rank_path, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = PieceEncoder(rank_path, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                flat, starts = encoder.encode(texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.view("<i4")))], names=["doc_id", "ids"])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """Adds `decoded` binary to doc_id and ids; an id outside the rank file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rank_path not in _TOKENS:
            ranks = load_ranks(rank_path)
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            _TOKENS[rank_path] = table
        table = _TOKENS[rank_path]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        data, begin = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = part.column(1)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                each = sizes[flat]
                ends = np.cumsum(each)
                joined = data[np.arange(int(each.sum())) - np.repeat(ends - each - begin[flat], each)]
                counts = np.append(0, np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)))
                bounds = np.append(0, ends)[counts].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
