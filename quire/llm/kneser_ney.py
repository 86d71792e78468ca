"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and kept as sorted hash arrays.

Two counting passes. The first counts tokens (words, A-Z lower-cased, and one end a text) by hash; a token's place in the
sorted hashes is its number. The second counts pairs of neighbours (a begin mark stands before the first token) as scrambled
numbers, merged bucket by bucket: pairs of one frequent word are spread over all buckets, and each task sends its own
distinct pairs only. From the merged pairs come, for each word, its number of distinct predecessors (the lower order) and,
as a context, its total and how many followers it has once, twice and more often. All arrays lie in the shared folder, in
buckets; workers map them into memory and look up a batch's distinct tokens and pairs by binary search.

Of order 3, the second pass counts triples (two begin marks), dealt by their first two words; pairs come from the distinct triples and
have their number of distinct predecessors as count, so they are the lower order of the triples:
p(w | t u) = max(c(tuw) - D(c(tuw)), 0) / c(tu) + g(tu) p(w | u); a context never seen leaves the next to p(w | u). The contexts are
the pairs that don't end a text (and the two begin marks), so one array of keys serves both.

Numbers take few bytes: a pair of words is a number of twice a word's bits, scrambled one to one, of which a bucket keeps the
low 32 bits in order, with a directory of the others; counts are bytes, larger ones stand apart in 64 bits; what is shuffled
are differences, byte by byte, compressed. More than 2^32 distinct words are refused.

p(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + g(u) p(w), and p(w) likewise from counts of predecessors, interpolated with
1 / (V + 1), the share of every word and of the unknown one. D comes from counts of counts (Chen and Goodman); where these
are too few for a discount, 0.5, 1 and 1.5 serve.

Defined cases: a null or empty text is its end alone; an unknown word has the unknown word's share and, as a context, leaves
the next to the lower order; without training rows every score is 0; repeated rows count as often as they occur; very long
texts are scored as one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._core import U64, SortedStore, bucket_bits, build_store, cuts, merge_by_bucket, open_array, packed, pick, save_array, sliced, unpacked, words_of
from .suffixes import ragged

BEGIN, END = xxhash.xxh3_64_intdigest(b" begin"), xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
MB_EACH = 16.0
#: Rows whose tokens are looked up together.
ROWS = 4000
#: Tokens whose n-grams a task counts before it sends them on.
TOKENS = 1 << 22
#: Keys between two stored places of followers; contexts of more followers have their figures stored.
STEP, MANY = 32, 32
#: Bits of the bytes before each place of a step.
BEFORE = (np.tril(np.ones((STEP, STEP), np.uint8), -1) * np.uint8(255)).view("<u8")
#: Values a part, from which parts are searched one by one.
EACH = 16
LOW = U64(0xFFFFFFFF)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of a batch (the end and the begin mark last), each row's tokens as places among them with
    its end, and where each row begins (one more at the end)."""
    starts, codes, distinct = words_of(column, lower=True)
    hashes = np.fromiter((*map(xxhash.xxh3_64_intdigest, distinct), END, BEGIN), U64, len(distinct) + 2)
    codes = np.insert(codes.astype(np.int64), starts[1:], len(distinct))
    return hashes, codes, starts + np.arange(len(starts))


def before(codes: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """The token before each; begin at the start of a row."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[starts[:-1]] = begin
    return out


# ---------------------------------------------------------------- numbers in few bytes


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as their lowest bytes, then their second ones, and so on, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([wide]) + packed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :wide].T))


def unplanes(blob: bytes) -> np.ndarray:
    wide = blob[0]
    flat = np.frombuffer(unpacked(blob[1:]), np.uint8).reshape(wide, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :wide] = flat.T
    return out.reshape(-1).view("<u8").astype(U64)


def steps(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U64(0)))


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=U64)


def joined_planes(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([unplanes(r[name]) for r in rows])


def narrow(values: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold the greatest."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


@dataclass(frozen=True)
class Pairs:
    """Pairs of word numbers below 2^bits, scrambled one to one within 2 * bits bits and moved to the top of 64."""

    bits: int

    FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    @classmethod
    def of(cls, words: int) -> Pairs:
        if words > 1 << 32:
            raise OverflowError("more than 2^32 distinct words")
        return cls(max(1, (words - 1).bit_length()) if words else 1)

    def _mask(self, x: np.ndarray) -> np.ndarray:
        return x if self.bits == 32 else x & U64((1 << 2 * self.bits) - 1)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, half = a.astype(U64) << U64(self.bits) | b.astype(U64), U64(self.bits)
        x ^= x >> half
        for f in self.FACTORS:
            x = self._mask(x * U64(f))
            x ^= x >> half
        return x << U64(64 - 2 * self.bits)

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, half = keys >> U64(64 - 2 * self.bits), U64(self.bits)
        x = x ^ x >> half
        for f in reversed(self.FACTORS):
            x = self._mask(x * U64(pow(f, -1, 1 << 64)))
            x ^= x >> half
        return (x >> half).astype(np.int64), (x & U64((1 << self.bits) - 1)).astype(np.int64)

    def parts(self, bucket_bits_: int) -> int:
        """Into how many ranges a bucket's keys are cut, so that 32 bits tell them apart."""
        return 1 << max(0, 2 * self.bits - bucket_bits_ - 32)

    def split(self, keys: np.ndarray, bucket_bits_: int) -> tuple[np.ndarray, np.ndarray]:
        """The range within the bucket, and the low bits."""
        x = keys >> U64(64 - 2 * self.bits)
        return ((x >> U64(32)) & U64(self.parts(bucket_bits_) - 1)).astype(np.int64), (x & LOW).astype(np.uint32)


def ranked(keys: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, whose `spare` lowest bits are zero, in order, and their places before: the places are sorted with them if they fit there."""
    if len(keys) > 1 << min(spare, 62):
        order = np.argsort(keys)
        return keys[order], order
    low = U64((1 << spare) - 1)
    both = np.sort(keys | np.arange(len(keys), dtype=U64))
    return both & ~low, (both & low).astype(np.int64)


def bisect(value: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of each wanted value in its own sorted range low .. high; a range that is narrowed down isn't looked at again."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        a, b = low[open_], high[open_]
        mid = (a + b) >> 1
        less = value(mid) < wanted[open_]
        a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        low[open_], high[open_] = a, b
        open_ = open_[a < b]
    return low


def search(held: np.ndarray, wanted: np.ndarray, part: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted value, sorted by part and value, in its part begin[part] .. begin[part + 1] of held, and whether it
    is there."""
    if not len(held):
        return begin[part], np.zeros(len(part), bool)
    high = begin[part + 1]
    if len(wanted) < EACH * (len(begin) - 1):
        low = bisect(lambda i: held[i], wanted, begin[part], high)
    else:
        low = np.empty(len(wanted), np.int64)
        at = np.searchsorted(part, np.arange(len(begin)))
        for p in np.flatnonzero(np.diff(at)).tolist():
            x = slice(at[p], at[p + 1])
            low[x] = np.searchsorted(held[begin[p] : begin[p + 1]], wanted[x]) + begin[p]
    return low, (low < high) & (held[np.minimum(low, len(held) - 1)] == wanted)


def sums_before(sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of the bytes from the last multiple of STEP up to each place."""
    full = len(sizes) // STEP
    row = place // STEP
    block = np.zeros((len(place), STEP), np.uint8)
    inside = row < full
    block[inside] = sizes[: full * STEP].reshape(full, STEP)[row[inside]]
    block[~inside, : len(sizes) - full * STEP] = sizes[full * STEP :]
    words = block.view("<u8") & BEFORE[place % STEP]
    even = U64(0x00FF00FF00FF00FF)
    pairs = (words & even) + ((words >> U64(8)) & even)
    sums = pairs.sum(axis=1, dtype=U64)  # four sums of 16 bits: 2 * STEP / 8 bytes each
    return ((sums * U64(0x0001000100010001)) >> U64(48)).astype(np.int64)


def save_counts(uri: str, name: str, bucket: int, values: np.ndarray) -> None:
    """Bytes; from 255 on the rest stands apart, as running sums at the places of these values."""
    large = np.flatnonzero(values >= 255)
    save_array(uri, f"{name}.{bucket}", np.minimum(values, 255).astype(np.uint8))
    save_array(uri, f"{name}at.{bucket}", large)
    save_array(uri, f"{name}more.{bucket}", np.append(0, np.cumsum(values[large].astype(np.int64) - 255)))


def counts_at(uri: str, name: str, bucket: int, places: np.ndarray) -> np.ndarray:
    return open_array(uri, f"{name}.{bucket}")[places] + counts_between(uri, name, bucket, places, places + 1)


def counts_between(uri: str, name: str, bucket: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What the bytes from low to high lack."""
    large, more = open_array(uri, f"{name}at.{bucket}"), open_array(uri, f"{name}more.{bucket}")
    return more[np.searchsorted(large, high)] - more[np.searchsorted(large, low)]


# ---------------------------------------------------------------- the model


def discounts(counts: list[int]) -> np.ndarray:
    """D of counts 0, 1, 2 and 3 or more, from how many have the counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    if min(counts) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


def _times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass(frozen=True)
class PairStore:
    """The pairs' arrays, beside those of the words: keys and counts, and of order 3 each pair's followers."""

    uri: str
    bits: int
    sizes: tuple[int, ...]
    code: Pairs
    kinds: int  # pairs; the two begin marks are a key and no pair
    discounts: np.ndarray | None = None  # of the triples

    def __len__(self) -> int:
        return self.kinds

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bucket that has some of the sorted distinct keys: which of them, and their places there."""
        at = cuts(keys, self.bits)
        for b in np.flatnonzero(np.diff(at)).tolist():
            if self.sizes[b]:
                part, low = self.code.split(keys[at[b] : at[b + 1]], self.bits)
                begin = open_array(self.uri, f"pd.{b}")
                place, hit = search(open_array(self.uri, f"pk.{b}"), low, part, begin)
                yield b, np.flatnonzero(hit) + at[b], place[hit]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        own, order = ranked(keys, 64 - 2 * self.code.bits)
        new = np.append(True, own[1:] != own[:-1])[: len(own)]
        wanted, out = own[new], np.empty(len(keys))
        counts = np.zeros(len(wanted))
        for b, which, place in self.places(wanted):
            counts[which] = counts_at(self.uri, "pn", b, place)
        out[order] = counts[np.cumsum(new) - 1]
        return out

    def _followers(self, b: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the followers of pairs begin, and their numbers."""
        sizes = open_array(self.uri, f"tf.{b}")
        base = place // STEP * STEP
        begin = open_array(self.uri, f"ts.{b}")[place // STEP] + sums_before(sizes, place) + counts_between(self.uri, "tf", b, base, place)
        return begin, counts_at(self.uri, "tf", b, place)

    def shares(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context and word (-1: unknown) the discounted share of the word, and that of the lower order (1 for a new context)."""
        own, rest = np.zeros(len(contexts)), np.ones(len(contexts))
        keys, order = ranked(contexts, 64 - 2 * self.code.bits)
        d = self.discounts
        distinct = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        ends = np.append(distinct[1:], len(keys))
        for b, which, place in self.places(keys[distinct]):
            begin, n = self._followers(b, place)
            some = n > 0
            which, place, begin, n = which[some], place[some], begin[some], n[some]
            if not len(which):
                continue
            total, n1, n2 = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
            many = n > MANY
            stored = np.searchsorted(open_array(self.uri, f"tb.{b}"), place[many])
            for v, name in ((total, "tt"), (n1, "t1"), (n2, "t2")):
                v[many] = open_array(self.uri, f"{name}.{b}")[stored]
            few = np.flatnonzero(~many)
            if len(few):
                c = counts_at(self.uri, "tc", b, ragged(begin[few], n[few]))
                start = np.cumsum(n[few]) - n[few]
                for v, x in ((total, c), (n1, c == 1), (n2, c == 2)):
                    v[few] = np.add.reduceat(x, start, dtype=np.int64)
            lower = (d[1] * n1 + d[2] * n2 + d[3] * (n - n1 - n2)) / total
            # every token after one of these contexts
            size = (ends - distinct)[which]
            rows = order[ragged(distinct[which], size)]
            of = np.repeat(np.arange(len(which)), size)
            rest[rows] = lower[of]
            found, hit = self._search(b, words[rows], begin[of], (begin + n)[of])
            c = np.zeros(len(rows))
            c[hit] = counts_at(self.uri, "tc", b, found[hit])
            own[rows] = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total[of]
        return own, rest

    def _search(self, b: int, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words among followers, which are kept as their low 16 bits and the others."""
        lows, highs = open_array(self.uri, f"tw.{b}"), open_array(self.uri, f"tx.{b}")
        last = len(lows) - 1
        value = (lambda i: highs[i].astype(np.int64) << 16 | lows[i]) if len(highs) else (lambda i: lows[i].astype(np.int64))
        low = bisect(value, words, low, high)
        return low, (low < high) & (value(np.minimum(low, last)) == words)


@dataclass(frozen=True)
class Model:
    words: SortedStore  # fields n, before, total, n1, n2, n3
    pairs: PairStore  # field n
    tokens: int  # N
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_times: tuple[int, ...]  # words of one, two, and more predecessors

    @property
    def vocabulary(self) -> int:
        """V: distinct training tokens; the begin mark isn't one."""
        return max(0, len(self.words) - 1)

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        hashes, codes, starts = tokens(column)
        place = self.words.index(hashes)
        f = {n: self.words.field(n, place, np.float64) for n in ("n", "before", "total", "n1", "n2", "n3")}
        uniform = 1.0 / (self.vocabulary + 1)
        kinds = len(self.pairs)
        low = uniform * np.ones(len(hashes))
        if kinds:
            d = self.word_discounts
            left = float(np.dot(d[1:], self.word_times)) / kinds
            low = np.maximum(f["before"] - d[np.minimum(f["before"], 3).astype(int)], 0) / kinds + left * uniform
        prev = before(codes, starts, len(hashes) - 1)
        p = low[codes]
        known = (place[codes] >= 0) & (f["total"][prev] > 0)
        if known.any():
            u, w = prev[known], codes[known]
            c = self.pairs.counts(self.pairs.code.keys(place[u], np.maximum(place[w], 0)))
            d = self.pair_discounts
            total = f["total"]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(total > 0, (d[1] * f["n1"] + d[2] * f["n2"] + d[3] * f["n3"]) / total, 1.0)
            p[known] = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total[u] + share[u] * low[w]
        # an unknown word after a known context: the context's share of the lower order
        unknown = (place[codes] < 0) & (f["total"][prev] > 0)
        if unknown.any():
            d, u = self.pair_discounts, prev[unknown]
            p[unknown] = (d[1] * f["n1"][u] + d[2] * f["n2"][u] + d[3] * f["n3"][u]) / f["total"][u] * low[codes[unknown]]
        if self.pairs.discounts is not None:
            t = before(prev, starts, len(hashes) - 1)
            found = np.flatnonzero((place[t] >= 0) & (place[prev] >= 0))
            own, rest = self.pairs.shares(self.pairs.code.keys(place[t[found]], place[prev[found]]), place[codes[found]])
            p[found] = own + rest * p[found]
        seen = f["n"][codes]
        base = np.log10((seen + 1.0) / (self.tokens + self.vocabulary + 1.0))
        at = starts[:-1]
        return {
            "n_tokens": np.diff(starts),
            "n_known": np.add.reduceat(seen > 0, at, dtype=np.int64) if len(at) else at,
            "base_score": np.add.reduceat(base, at) if len(at) else np.empty(0),
            "score": np.add.reduceat(np.log10(p), at) if len(at) else np.empty(0),
        }


def _scatter(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted distinct keys by bucket, and their counts."""
    at = cuts(keys, bits)
    full = np.flatnonzero(np.diff(at))
    part = [slice(at[b], at[b + 1]) for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([steps(keys[x]) for x in part], pa.binary()), pa.array([planes(counts[x]) for x in part], pa.binary())], names=["bucket", "keys", "n"])


def _distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (or how often they occur)."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return _distinct(np.concatenate([unsteps(r["keys"]) for r in rows]), joined_planes(rows, "n"))


def _distinct_triples(contexts: np.ndarray, words: np.ndarray, spare: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, order = ranked(contexts, spare)
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    both = np.empty(len(own), U64)  # the rank of the context, and the word: both below 2^32
    both[order] = (np.cumsum(new) - 1).astype(U64) << U64(32)
    both |= words.astype(U64)
    own = own[new]
    if counts is None:
        both.sort()
    else:
        order = np.argsort(both)
        both = both[order]
    contexts, words = own[(both >> U64(32)).astype(np.int64)], both & LOW
    start = np.flatnonzero(np.append(True, (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1]))) if len(contexts) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(contexts))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), start) if len(start) else counts
    return contexts[start], words[start], n


def _scatter_triples(contexts: np.ndarray, words: np.ndarray, bits: int, spare: int) -> pa.RecordBatch:
    """Distinct triples by the bucket of their context: contexts, their numbers of followers, these and their counts."""
    contexts, words, counts = _distinct_triples(contexts, words, spare)
    at = cuts(contexts, bits)
    full = np.flatnonzero(np.diff(at))
    columns: list[list[bytes]] = [[], [], [], []]
    for b in full:
        x = slice(at[b], at[b + 1])
        own, followers = np.unique(contexts[x], return_counts=True)
        for column, blob in zip(columns, (steps(own), planes(followers), planes(words[x]), planes(counts[x])), strict=True):
            column.append(blob)
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "keys", "followers", "words", "n"])


def learn(docs: DataFrame, order: int = 2) -> Model:
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    docs = pick(docs, "text")
    docs = docs.select(docs.text.cast("string"))
    bits = bucket_bits(docs, MB_EACH)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in sliced(batches, ROWS):
            hashes, codes, _ = tokens(batch.column(0))
            counts = np.bincount(codes, minlength=len(hashes))  # the begin mark is kept, and counts for nothing
            keep = (counts > 0) | (hashes == BEGIN)
            held.append((hashes[keep], counts[keep]))
            size += len(codes)
            if size >= TOKENS:
                yield _scatter(*_distinct(*map(np.concatenate, zip(*held, strict=True))), bits)
                held, size = [], 0
        if held:
            yield _scatter(*_distinct(*map(np.concatenate, zip(*held, strict=True))), bits)

    def merge_words(rows: list[dict]) -> tuple:
        keys, n = _merged(rows) if rows else (np.empty(0, U64), np.empty(0, np.int64))
        return keys, {"n": narrow(n)}, [n.sum()]

    words = build_store(docs.mapInArrow(count_words, "bucket int, keys binary, n binary"), bits, "words", merge_words)
    n_tokens = words.stats[0] if words.stats else 0
    first = words.offsets
    code = Pairs.of(len(words))
    spare = 64 - 2 * code.bits
    begin, end = words.index(np.array([BEGIN, END], U64)).tolist()

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in sliced(batches, ROWS):
            hashes, codes, starts = tokens(batch.column(0))
            place = words.index(hashes)
            held.append(code.keys(place[before(codes, starts, len(hashes) - 1)], place[codes]))
            if sum(map(len, held)) >= TOKENS:
                yield _scatter(*_distinct(np.concatenate(held)), bits)
                held = []
        if held:
            yield _scatter(*_distinct(np.concatenate(held)), bits)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in sliced(batches, ROWS):
            hashes, codes, starts = tokens(batch.column(0))
            place = words.index(hashes)
            prev = before(codes, starts, len(hashes) - 1)
            held.append((code.keys(place[before(prev, starts, len(hashes) - 1)], place[prev]), place[codes].astype(np.uint32)))
            if sum(len(c) for c, _ in held) >= TOKENS:
                yield _scatter_triples(*map(np.concatenate, zip(*held, strict=True)), bits, spare)
                held = []
        if held:
            yield _scatter_triples(*map(np.concatenate, zip(*held, strict=True)), bits, spare)

    last = 1 << bits  # a bucket of its own for sizes and counts of counts

    def merge_triples(bucket: int, rows: list[dict]) -> Iterator[dict]:
        contexts = np.concatenate([np.repeat(unsteps(r["keys"]), unplanes(r["followers"]).astype(np.int64)) for r in rows])
        contexts, word, n = _distinct_triples(contexts, joined_planes(rows, "words"), spare, joined_planes(rows, "n"))
        at = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
        followers = np.diff(np.append(at, len(contexts)))
        uri = words.uri
        save_array(uri, f"tw.{bucket}", word.astype(np.uint16))
        save_array(uri, f"tx.{bucket}", narrow(word >> U64(16)) if code.bits > 16 else np.empty(0, np.uint8))
        save_counts(uri, "tc", bucket, n)
        # for merge_pairs, which knows the contexts themselves: their numbers of followers, and figures of those of many
        many = np.flatnonzero(followers > MANY)
        sums = [np.add.reduceat(v, at)[many] for v in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64))]
        save_array(uri, f"tn.{bucket}", np.frombuffer(planes(followers), np.uint8))
        for name, v in zip(("tt", "t1", "t2"), sums, strict=True):
            save_array(uri, f"{name}.{bucket}", narrow(v))
        yield {"bucket": last, "keys": b"", "n": np.array(_times(n), np.int64).tobytes()}
        pairs = _distinct(code.keys(code.words(contexts)[1], word))
        yield from _scatter(*pairs, bits).to_pylist()
        yield {"bucket": bucket, "keys": b"", "n": b""}  # so that merge_pairs sees every bucket that has contexts

    columns = "bucket int, size long, stats binary, context binary, total binary, n1 binary, n2 binary, n3 binary, word binary, times binary"
    names = [c.split()[0] for c in columns.split(", ")]
    marks = code.keys(np.array([begin]), np.array([begin])) if begin >= 0 else np.empty(0, U64)

    def merge_pairs(bucket: int, rows: list[dict]) -> Iterator[dict]:
        empty = dict.fromkeys(names[2:], b"")
        if bucket == last:  # figures of the triples are passed on
            for r in rows:
                yield empty | {"bucket": last, "size": -1, "stats": r["n"]}
            return
        uri = words.uri
        has_contexts = any(not r["keys"] for r in rows)
        rows = [r for r in rows if r["keys"]]
        keys, n = _merged(rows) if rows else (np.empty(0, U64), np.empty(0, np.int64))
        kinds, kept, kept_n = len(keys), keys, n
        if order == 3 and len(marks) and int(marks[0] >> U64(64 - bits)) == bucket:
            kept, kept_n = _distinct(np.append(keys, marks), np.append(n, 0))
        part, low = code.split(kept, bits)
        save_array(uri, f"pd.{bucket}", np.searchsorted(part, np.arange(code.parts(bits) + 1)))
        save_array(uri, f"pk.{bucket}", low)
        save_counts(uri, "pn", bucket, kept_n)
        if order == 3:
            followers = np.zeros(len(kept), np.int64)
            if has_contexts:
                own = unplanes(open_array(uri, f"tn.{bucket}").tobytes()).astype(np.int64)
                continued = np.flatnonzero(code.words(kept)[1] != end)
                if len(continued) != len(own):
                    raise RuntimeError(f"{len(own)} contexts and {len(continued)} pairs that go on")
                followers[continued] = own
            save_counts(uri, "tf", bucket, followers)
            save_array(uri, f"ts.{bucket}", (np.cumsum(followers) - followers)[::STEP])
            save_array(uri, f"tb.{bucket}", np.flatnonzero(followers > MANY))
        yield empty | {"bucket": last, "size": bucket, "stats": np.array([len(kept), kinds, *_times(n)], np.int64).tobytes()}
        context, word = code.words(keys)
        rank = np.argsort(context)
        context, n = context[rank], n[rank]
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else context
        sums = [np.add.reduceat(v, at) if len(at) else at for v in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
        context = context[at]
        word, times = np.unique(word, return_counts=True)
        c, w = np.searchsorted(context, first), np.searchsorted(word, first)
        for b in np.flatnonzero(np.diff(c) + np.diff(w)):
            x, y = slice(c[b], c[b + 1]), slice(w[b], w[b + 1])
            found = {"context": steps(context[x].astype(U64)), "word": steps(word[y].astype(U64)), "times": planes(times[y])} | {k: planes(v[x]) for k, v in zip(("total", "n1", "n2", "n3"), sums, strict=True)}
            yield empty | {"bucket": int(b), "size": 0} | found

    def finish(bucket: int, rows: list[dict]) -> Iterator[dict]:
        if bucket == last:
            for r in rows:
                yield {"bucket": int(r["size"]), "kind": 0 if r["size"] >= 0 else 2, "stats": np.frombuffer(r["stats"], np.int64).tolist()}
            return
        n, base = words.sizes[bucket], int(first[bucket])

        def added(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            np.add.at(out, at, values.astype(np.int64))
            return out

        context, word = (np.concatenate([unsteps(r[k]) for r in rows]).astype(np.int64) - base for k in ("context", "word"))
        for name in ("total", "n1", "n2", "n3"):
            save_array(words.uri, f"{name}.{bucket}", narrow(added(context, joined_planes(rows, name))))
        times = added(word, joined_planes(rows, "times"))
        save_array(words.uri, f"before.{bucket}", narrow(times))
        yield {"bucket": bucket, "kind": 1, "stats": [*_times(times), int((times > 2).sum())]}

    if order == 3:
        found = merge_by_bucket(docs.mapInArrow(count_triples, "bucket int, keys binary, followers binary, words binary, n binary"), bits, merge_triples, "bucket int, keys binary, n binary")
    else:
        found = docs.mapInArrow(count_pairs, "bucket int, keys binary, n binary")
    pairs = merge_by_bucket(found, bits, merge_pairs, columns)
    sizes, kinds, pair_times, word_times, triple_times = [0] * last, 0, [0] * 4, [0] * 5, [0] * 4
    for r in merge_by_bucket(pairs, bits, finish, "bucket int, kind int, stats array<long>").collect():
        if r["kind"] == 2:
            triple_times = [a + b for a, b in zip(triple_times, r["stats"], strict=True)]
        elif r["kind"]:
            word_times = [a + b for a, b in zip(word_times, r["stats"], strict=True)]
        else:
            sizes[r["bucket"]] = r["stats"][0]
            kinds += r["stats"][1]
            pair_times = [a + b for a, b in zip(pair_times, r["stats"][2:], strict=True)]
    store = PairStore(words.uri, bits, tuple(sizes), code, kinds, discounts(triple_times) if order == 3 else None)
    return Model(words, store, n_tokens, discounts(pair_times), discounts(word_times[:4]), (word_times[0], word_times[1], word_times[4]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (unigrams, add-one) and score, both log10 of the text's probability."""
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            got = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[n]) for n in names]], names=["doc_id", *names])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
