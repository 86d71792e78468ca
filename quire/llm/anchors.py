"""Windows dealt by their content, and spans of documents kept in the shared folder.

A window of `length` symbols is assigned to the least hash among its k-grams (the leftmost of equals): two equal windows
have the same anchor at the same place, wherever they lie. Windows next to each other mostly share an anchor, so a document
becomes a few runs (key, first window, one past the last), and equal windows can be searched key by key.

A key that occurs in more than HOT runs is split: its windows are dealt by their anchor together with a second one, the least
of another hash, which lies in their surroundings or further along the passage. Equal windows agree in both, so nothing is
lost, and a phrase that a third of all documents hold doesn't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._core import U64, SortedStore, bucket_of, build_store, cuts, join_arrays, join_packed, mix64, open_array, packed

PLACE_BITS = 24
PLACE = U64((1 << PLACE_BITS) - 1)
C1, C2, C3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
#: Symbols worked on at a time: what fits the processor's cache.
BLOCK = 1 << 16
#: Runs of one key beyond which it is split.
HOT = 4096
SECOND = U64(0xA0761D6478BD642F)


def kgrams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k symbols (bytes or 64-bit values) in a row."""
    if symbols.dtype == np.uint8 and k >= 8:
        x = np.ndarray((len(symbols) - 7,), "<u8", np.ascontiguousarray(symbols), strides=(1,)) * C1
        n = 8
    else:
        x = (symbols.astype(U64) + U64(1)) * C1
        n = 1
    x ^= x >> U64(32)
    while n < k:
        step = min(n, k - n)
        y = x[:-step] * (C2 + U64(2 * n))
        y += x[step:]
        y ^= y >> U64(29)
        x, n = y, n + step
    x = x * C3
    x ^= x >> U64(32)
    return x


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n < w:
        step = min(n, w - n)
        x = np.minimum(x[:-step], x[step:])
        n += step
    return x


def runs(symbols: np.ndarray, starts: np.ndarray, length: int, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, row, first and one past the last window (places within the row) of every run; starts: of rows, one more at the end."""
    parts: list[tuple] = []
    sizes = np.diff(starts)
    row = 0
    while row < len(sizes):
        end = int(np.searchsorted(starts, starts[row] + BLOCK, "right")) - 1
        end = max(row + 1, min(end, len(sizes)))
        low, high = int(starts[row]), int(starts[end])
        if end - row == 1 and high - low > 1 << 22:  # one very long row, in overlapping parts
            for at in range(low, high - length + 1, 1 << 22):
                stop = min(high, at + (1 << 22) + length - 1)
                parts.append(_block(symbols[at:stop], np.array([0, stop - at]), length, k, row, at - low, second))
        elif high - low >= length:
            parts.append(_block(symbols[low:high], starts[row : end + 1] - low, length, k, row, 0, second))
        row = end
    if not parts:
        return np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _block(symbols: np.ndarray, starts: np.ndarray, length: int, k: int, row: int, at: int, second: bool) -> tuple:
    h = kgrams(symbols, k)
    if second:
        h = mix64(h ^ SECOND)
    packed = (h & ~PLACE) | np.arange(len(h), dtype=U64)
    least = sliding_least(packed, length - k + 1)
    whole = np.ones(len(least), bool)
    for e in starts[1:-1].tolist():
        whole[max(0, e - length + 1) : e] = False
    s = np.flatnonzero(whole)
    if not len(s):
        return np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3))
    own = least[s]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)))
    last = np.append(first[1:], len(s)) - 1
    local = np.searchsorted(starts, s[first], "right") - 1
    key = mix64(h[(own[first] & PLACE).astype(np.int64)])  # least hashes are small: scrambled, they spread over the buckets
    return key, local + row, s[first] - starts[local] + at, s[last] + 1 - starts[local] + at


def split_hot(symbols: np.ndarray, starts: np.ndarray, length: int, k: int, found: tuple, hot: np.ndarray) -> tuple:
    """found (key, row, first, last) with the runs that are hot dealt anew by both anchors."""
    if not hot.any():
        return found
    key, row, first, last = (x[hot] for x in found)
    size = last - first + length - 1
    begin = starts[row] + first
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1])) + np.repeat(begin - ends + size, size)
    other, run, low, high = runs(symbols[place], np.append(0, ends), length, k, second=True)
    parts = (mix64(key[run] ^ mix64(other)), row[run], first[run] + low, first[run] + high)
    return tuple(np.concatenate([x[~hot], y]) for x, y in zip(found, parts, strict=True))


# ---------------------------------------------------------------- keys that recur


def scatter_keys(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """A batch's distinct keys by bucket, and how often each occurs."""
    own, times = np.unique(keys, return_counts=True)
    at = cuts(own, bits)
    full = np.flatnonzero(np.diff(at))
    times = times.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([own[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([packed(times[at[b] : at[b + 1]]) for b in full], pa.binary())],
        names=["bucket", "keys", "times"],
    )


def recurring(keys: DataFrame, bits: int, label: str) -> SortedStore:
    """Keys that occur twice or more, with a field `hot`: more than HOT times; from rows of scatter_keys."""

    def merge(rows: list[dict]) -> tuple[np.ndarray, dict]:
        own, times = join_arrays(rows, "keys", U64), join_packed(rows, "times", np.uint32).astype(np.int64)
        order = np.argsort(own)
        own, times = own[order], times[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
        times = np.add.reduceat(times, start) if len(own) else start
        again = times > 1
        return own[start][again], {"hot": (times[again] > HOT).astype(np.uint8)}

    return build_store(keys, bits, label, merge)


def recurring_runs(store: SortedStore, symbols: np.ndarray, starts: np.ndarray, length: int, k: int, found: tuple) -> tuple:
    """The runs whose keys recur, hot ones split."""
    place = store.index(found[0])
    hit = place >= 0
    found = tuple(x[hit] for x in found)
    return split_hot(symbols, starts, length, k, found, store.field("hot", place[hit], np.uint8) > 0)


# ---------------------------------------------------------------- spans


def row_keys(doc_ids: pa.Array, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its id (the least number where null), a hash of its text, and a key of both."""
    ids = doc_ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), U64, len(texts))
    return ids, hashes, key_of(ids, hashes)


def key_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(mix64(ids) ^ hashes)


def scatter_spans(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Iterator[dict]:
    """Spans of rows (by key) as dictionaries with bucket, keys, low and high."""
    keys, low, high = merged(keys, low, high)
    at = cuts(keys, bits)
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        yield {"bucket": int(b), "keys": keys[s].tobytes(), "low": low[s].astype(np.int64).tobytes(), "high": high[s].astype(np.int64).tobytes()}


def merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by key and place; those of a key that touch or overlap made one."""
    if not len(keys):
        return keys, low, high
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order], high[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(new_key) - 1
    # the farthest end so far within the key: offsets keep a running maximum from reaching over to the next key
    reach = int(high.max()) + 1
    far = np.maximum.accumulate(high + group * reach) - group * reach
    new = new_key.copy()
    new[1:] |= low[1:] > far[:-1]
    start = np.flatnonzero(new)
    return keys[start], low[start], far[np.append(start[1:], len(keys)) - 1]


@dataclass(frozen=True)
class SpanStore:
    """Spans of rows, in files that workers map into memory."""

    store: SortedStore

    def of(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        place = self.store.index(keys)
        at = bucket_of(keys, self.store.bits)
        first = self.store.offsets
        out: list = [None] * len(keys)
        for i in np.flatnonzero(place >= 0).tolist():
            b = int(at[i])
            j = int(place[i] - first[b])
            s = slice(int(open_array(self.store.uri, f"from.{b}")[j]), int(open_array(self.store.uri, f"to.{b}")[j]))
            out[i] = (np.array(open_array(self.store.uri, f"low.{b}")[s]), np.array(open_array(self.store.uri, f"high.{b}")[s]))
        return out


def span_store(rows: DataFrame, bits: int, label: str) -> SpanStore:
    """From rows of scatter_spans."""

    def merge(held: list[dict]) -> tuple[np.ndarray, dict]:
        keys, low, high = merged(join_arrays(held, "keys", U64), join_arrays(held, "low", np.int64), join_arrays(held, "high", np.int64))
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[start], {"from": start, "to": np.append(start[1:], len(keys)).astype(np.int64), "low": low, "high": high}

    return SpanStore(build_store(rows, bits, label, merge))


def without(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> bytes:
    if spans is None:
        return data
    out, at = [], 0
    for a, b in zip(spans[0].tolist(), spans[1].tolist(), strict=True):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)
