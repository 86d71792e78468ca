"""Repeated substrings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of `length` bytes that also starts earlier (in a document of smaller id, or earlier in the same document) marks
its bytes for removal. Windows are dealt by anchors (see anchors.py) in three passes over the texts:

1. anchors are counted, only those that occur twice or more can hold a repeat;
2. the runs of windows of such anchors are put together with their like: runs of one anchor and equal bytes are a class, with its
   members in order. The first member's text and, once more, the second's stand for the class. The texts of an anchor's
   classes are joined, their suffixes ordered and transformed; starting from the intervals of one symbol (twenty bytes, named
   by their rank), each interval is extended backward by every symbol that precedes it, all intervals of a depth at once, which yields the
   boundaries between suffixes by increasing common prefix; it stops at `length`. Windows that are still in one interval are
   equal; all but the earliest are marked, and what is marked in a class's second member is so in all later ones. This is
   done for the classes of each batch first, together with the first members that its task has sent on before, so that
   thousands of copies in a task send on one, and then, with the first members of all tasks, by bucket of anchors;
3. spans are kept in the shared folder, sorted by document; workers map them and cut their documents.

Texts aren't shuffled, except for the runs of recurring anchors.

Defined cases: a null text is empty; rows that repeat an id with another text are ordered by a hash of the text, and rows
that repeat id and text are one document (both lose the same bytes); null ids come before all others; texts shorter than
`length` lose nothing; very long texts are cut into runs like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._core import U64, bucket_bits, cuts, join_arrays, join_packed, merge_by_bucket, packed, pick, rewrite_rows, sliced, unpacked, utf8
from .anchors import SpanStore, key_of, recurring, recurring_runs, row_keys, runs, scatter_keys, scatter_spans, span_store, without

LENGTH, ANCHOR = 100, 32
#: Bytes of one transform, unless one anchor has more.
TEXT = 1 << 19
MB_EACH = 8.0
#: Rows of a batch, and bytes of text that a task remembers of what it has sent on (then it begins anew, and sends again).
ROWS, REMEMBERED = 2000, 32 << 20


# ---------------------------------------------------------------- the transform


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Starts of the cyclic suffixes in the order of their first `depth` bytes at least, equals by place; and the names that doubling
    gave to the longest strings on its way that divide the depth: how long these are (0: none), and at each place the rank of its own."""
    n = len(data)
    bits = max(1, (n - 1).bit_length())
    wide = np.resize(data, n + 5).astype(U64)
    key = np.zeros(n, U64)
    for i in range(5):
        key = key << U64(8) | wide[i : i + n]
    have, q, names = 5, 0, None
    while True:
        if have > 5 and 3 * bits <= 63 or have == 5 and 40 + bits <= 64:
            packed = np.sort(key << U64(bits) | np.arange(n, dtype=U64))
            order = (packed & U64((1 << bits) - 1)).astype(np.int64)
            packed >>= U64(bits)
        else:
            order = np.argsort(key, kind="stable")
            packed = key[order]
        new = packed[1:] != packed[:-1]
        if have >= depth:
            return order, q, names
        rank = np.empty(n, U64)
        rank[order] = np.append(0, np.cumsum(new)).astype(U64)
        if depth % have == 0:
            q, names = have, rank
        if new.all():
            return order, q, names
        step = min(have, depth - have)
        shift = bits if 3 * bits <= 63 else 32
        key = rank << U64(shift) | np.roll(rank, -step)
        have += step


def depths(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each suffix the depth at which it parted from the one before it (`depth`: not before `depth`).

    Depths are rounded up to whole symbols of q bytes; boundaries are exact at `depth`. A symbol is the rank of its bytes
    among all strings of q bytes, or these bytes themselves.
    """
    n = len(data)
    bits = max(1, (n - 1).bit_length())
    order, q, symbol = suffix_order(data, depth)
    size = bits
    if symbol is None:
        q = next(x for x in (4, 2, 1) if depth % x == 0)
        size = 8 * q
        wide = np.resize(data, n + q).astype(U64)
        symbol = np.zeros(n, U64)
        for i in range(q):
            symbol = symbol << U64(8) | wide[i : i + n]
    transform = symbol[(order - q) % n]  # the symbol before each suffix
    if size + bits <= 64:
        packed = np.sort(transform << U64(bits) | np.arange(n, dtype=U64))
        source = (packed & U64((1 << bits) - 1)).astype(np.int64)
    else:
        source = np.argsort(transform, kind="stable")
    # extending suffix source[i] backward by its symbol gives suffix i
    first = transform[source]
    parted = np.full(n, depth, np.int32)
    boundary = np.append(True, first[1:] != first[:-1])
    parted[boundary] = 0
    open_ = np.flatnonzero(~boundary)
    left, right = source[open_ - 1], source[open_]
    for level in range(q, depth, q):
        seen = np.cumsum(boundary, dtype=np.int32)
        hit = seen[left] != seen[right]  # their tails parted at this depth or before
        if not hit.any():
            break
        parted[open_[hit]] = level
        boundary[open_[hit]] = True
        keep = ~hit
        open_, left, right = open_[keep], left[keep], right[keep]
    return order, parted


def equal_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start a number; those of equal windows are equal."""
    order, parted = depths(data, length)
    interval = np.empty(len(data), np.int64)
    interval[order] = np.cumsum(parted < length)
    return interval[starts]


# ---------------------------------------------------------------- marks


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... sizes[i] of them, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


FIELDS = (("key", U64), ("doc", np.int64), ("text_hash", U64), ("at", np.int64), ("windows", np.int64))


def classes(keys: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each run the number of its class (anchor and bytes), and for each class its first run."""
    numbers: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((numbers.setdefault(x, len(numbers)) for x in zip(keys, texts, strict=True)), np.int64, len(keys))
    return of, np.unique(of, return_index=True)[1]


def mark(group: np.ndarray, of: np.ndarray, texts: list[bytes], f: dict[str, np.ndarray], length: int, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Keys of documents and their marked spans, and the first member of each class (places in f). group: of each class, whose
    windows are compared; of: each run's class; texts: of the classes; most: bytes of one transform."""
    order = np.lexsort((f["at"], f["text_hash"], f["doc"], of))
    new_class = np.append(True, of[order][1:] != of[order][:-1])
    again = ~new_class
    for n in ("doc", "text_hash", "at"):
        again[1:] &= f[n][order][1:] == f[n][order][:-1]
    order, new_class = order[~again], new_class[~again]  # rows that repeat are one
    lead = np.flatnonzero(new_class)
    members = np.diff(np.append(lead, len(order)))
    # items: of each class the first member, and the second where there is one
    item = np.concatenate([lead, lead[members > 1] + 1])
    number = of[order[item]]
    many = np.bincount(group[number], minlength=int(group.max()) + 1)[group[number]] > 1
    item, number = item[many], number[many]
    row = order[item]
    rank = np.lexsort((f["at"][row], f["text_hash"][row], f["doc"][row], group[number]))
    item, number, row = item[rank], number[rank], row[rank]
    size = np.fromiter((len(texts[i]) for i in number.tolist()), np.int64, len(number))
    begins = np.flatnonzero(np.append(True, group[number][1:] != group[number][:-1])) if len(number) else np.empty(0, np.int64)
    ends, reach = np.append(begins[1:], len(number)), np.append(0, np.cumsum(size))
    class_rows = np.zeros(len(group), np.int64)
    class_rows[of[order[lead]]] = np.arange(len(lead))
    marks = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))]
    owner = key_of(f["doc"], f["text_hash"])
    low = 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(reach[ends], reach[begins[low]] + most, "right")))
        c = np.arange(begins[low], ends[high - 1])
        low = high
        c = c[np.lexsort((f["at"][row[c]], f["text_hash"][row[c]], f["doc"][row[c]]))]  # earlier windows come first
        data = np.frombuffer(b"".join([texts[i] for i in number[c].tolist()]), np.uint8)
        in_data = np.cumsum(size[c]) - size[c]
        windows = ragged(in_data, f["windows"][row[c]])
        equal = equal_windows(data, windows, length)
        ranked = np.sort(equal.astype(U64) << U64(32) | np.arange(len(windows), dtype=U64))
        repeat = np.flatnonzero((ranked[1:] >> U64(32)) == (ranked[:-1] >> U64(32))) + 1
        later = np.sort((ranked[repeat] & U64(0xFFFFFFFF)).astype(np.int64))
        if not len(later):
            continue
        at_item = np.repeat(np.arange(len(c)), f["windows"][row[c]])[later]
        place = windows[later] - in_data[at_item]
        start = np.flatnonzero(np.append(True, (at_item[1:] != at_item[:-1]) | (place[1:] != place[:-1] + 1)))
        stop = np.append(start[1:], len(at_item)) - 1
        which = c[at_item[start]]
        # a second member stands for all later ones of its class
        own = class_rows[number[which]]
        count = np.where(item[which] == lead[own], 1, members[own] - 1)
        holders = order[ragged(item[which], count)]
        first, last = np.repeat(place[start], count), np.repeat(place[stop] + length, count)
        marks.append((owner[holders], f["at"][holders] + first, f["at"][holders] + last))
    return tuple(np.concatenate(x) for x in zip(*marks, strict=True)), order[lead]


def mark_bucket(rows: list[dict], length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first members of all batches: keys of documents and their marked spans."""
    f = {n: join_packed(rows, n, t) for n, t in FIELDS}
    if not len(f["key"]):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    text = b"".join(unpacked(r["text"]) for r in rows)
    end = np.cumsum(f["windows"] + length - 1).tolist()
    texts = [text[a:b] for a, b in zip([0, *end], end, strict=False)]
    of, first = classes(f["key"].tolist(), texts)
    group = np.unique(f["key"][first], return_inverse=True)[1]
    return mark(group, of, [texts[i] for i in first.tolist()], f, length, most)[0]


class Sent:
    """The members that a task has sent on, by class: of each the first so far, as its values of some fields."""

    def __init__(self, most: int):
        self.held: dict[tuple[int, bytes], tuple] = {}
        self.size, self.most = 0, most

    def joined(self, keys: np.ndarray, texts: list[bytes], f: dict[str, np.ndarray]) -> tuple[list[bytes], dict[str, np.ndarray]]:
        """texts and f with the sent members of their classes after them."""
        known = [x for x in dict.fromkeys(zip(keys.tolist(), texts, strict=True)) if x in self.held]
        if not known:
            return texts, f
        rows = [self.held[x] for x in known]
        return texts + [t for _, t in known], {n: np.append(v, np.array([r[i] for r in rows], v.dtype)) for i, (n, v) in enumerate(f.items())}

    def keep(self, texts: list[bytes], f: dict[str, np.ndarray]) -> None:
        if self.size > self.most:
            self.held, self.size = {}, 0
        for values in zip(texts, f["key"].tolist(), *(v.tolist() for v in f.values()), strict=True):
            if (values[1], values[0]) not in self.held:
                self.size += len(values[0])
            self.held[(values[1], values[0])] = values[2:]


def mark_batch(found: tuple, held: list[bytes], ids: np.ndarray, hashes: np.ndarray, length: int, most: int, sent: Sent) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[bytes], dict[str, np.ndarray]]:
    """Marks of a batch's equal runs, and what is to be sent on: texts and FIELDS of the first members of its classes, but for those
    sent before."""
    key, row, first, last = found
    texts = [held[r][a : b + length - 1] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
    f = dict(zip([n for n, _ in FIELDS], (key, ids[row], hashes[row], first, last - first), strict=True))
    if not len(key):
        return (np.empty(0, U64), first, last), [], f
    texts, f = sent.joined(key, texts, f)
    of, one = classes(f["key"].tolist(), texts)
    marks, lead = mark(np.arange(len(one)), of, [texts[i] for i in one.tolist()], f, length, most)
    lead = lead[lead < len(key)]  # rows of this batch
    lead = lead[np.argsort(key[lead], kind="stable")]
    texts, f = [texts[i] for i in lead.tolist()], {n: v[lead] for n, v in f.items()}
    sent.keep(texts, f)
    return marks, texts, f


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> SpanStore:
    """The spans to remove."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"))
    bits = bucket_bits(docs, MB_EACH)
    most, at_once, remembered = TEXT, ROWS, REMEMBERED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at_once):
            yield scatter_keys(runs(*_symbols(utf8(batch.column(0))), length, anchor)[0], bits)

    again = recurring(docs.select("text").mapInArrow(count, "bucket int, keys binary, times binary"), bits, "anchors")
    columns = "bucket int, key binary, doc binary, text_hash binary, at binary, windows binary, text binary, owner binary, low binary, high binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent(remembered)
        for batch in sliced(batches, at_once):
            held = utf8(batch.column(1))
            ids, hashes, _ = row_keys(batch.column(0), held)
            symbols, starts = _symbols(held)
            found = recurring_runs(again, symbols, starts, length, anchor, runs(symbols, starts, length, anchor))
            marks, texts, values = mark_batch(found, held, ids, hashes, length, most, sent)
            empty = dict.fromkeys(names[1:], b"")
            out = [empty | {"bucket": s["bucket"], "owner": s["keys"], "low": s["low"], "high": s["high"]} for s in scatter_spans(*marks, bits)]
            at = cuts(values["key"], bits)
            for b in np.flatnonzero(np.diff(at)):
                s = slice(at[b], at[b + 1])
                out.append(empty | {"bucket": int(b), "text": packed(b"".join(texts[s]))} | {n: packed(values[n][s]) for n, _ in FIELDS})
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.int32() if n == "bucket" else pa.binary()) for n in names], names=names)

    def merge(_: int, rows: list[dict]) -> Iterator[dict]:
        marked = mark_bucket(rows, length, most)
        held = [join_arrays(rows, n, t) for n, t in (("owner", U64), ("low", np.int64), ("high", np.int64))]
        yield from scatter_spans(*(np.concatenate(x) for x in zip(marked, held, strict=True)), bits)

    marked = merge_by_bucket(docs.mapInArrow(collect, columns), bits, merge, "bucket int, keys binary, low binary, high binary")
    return span_store(marked, bits, "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, kept binary, removed array<struct<low, high>>: maximal removed runs, in bytes."""
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"))
    spans = repeated(docs, length, anchor)
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held = utf8(batch.column(1))
            found = spans.of(row_keys(batch.column(0), held)[2])
            removed = [[] if s is None else [{"low": a, "high": b} for a, b in zip(s[0].tolist(), s[1].tolist(), strict=True)] for s in found]
            kept = [without(t, s) for t, s in zip(held, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in held], pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=["doc_id", "n_bytes", "kept", "removed"]
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, kept binary, removed array<struct<low:long,high:long>>")


def cut_texts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with their texts cut; bytes of a character that a cut leaves in part go too. n_chars, where present, is counted anew."""
    spans = repeated(docs, length, anchor)
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(batch: pa.RecordBatch, at_id: int, at_text: int) -> pa.RecordBatch:
        held = utf8(batch.column(at_text))
        found = spans.of(row_keys(batch.column(at_id), held)[2])
        texts = [without(t, s).decode("utf-8", "ignore") for t, s in zip(held, found, strict=True)]
        columns = list(batch.columns)
        columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
        if at_chars is not None:
            columns[at_chars] = pa.array([len(t) for t in texts], batch.schema.field(at_chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rewrite_rows(docs, change)
