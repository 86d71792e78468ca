"""Quartile bucket digest: counts of hashed byte triplets in buckets, each count's quartile, and the length.

Triplets are taken from every window of five bytes (first byte with two of the others, six ways), hashed to 128 buckets. A
digest is 2 hexadecimal digits of the length's logarithm, then 64 of the buckets' quartile codes (two bits each). The
difference of two digests adds, over the buckets, 0, 1, 2 or 6 by the distance of the codes, and the distance of the
lengths' codes, each bounded; likeness is 1 - difference / greatest difference.

Defined cases: a null text is empty; a text too short for a triplet has all counts zero and codes zero; equal texts have
equal digests; very long texts are counted in parts. The next document in falling order of doc_id, then of a hash of the text, is the
neighbour of a document; after the last comes the first, so that a single document is its own neighbour; null ids come
last. Rows that repeat are neighbours of each other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import bucket_bits, pick

BUCKETS = 128
#: Cost of two quartile codes at each distance.
CODE_COST = np.array([0, 1, 2, 6])
LENGTH_COST = 48
GREATEST = int(BUCKETS * CODE_COST.max() + LENGTH_COST)
#: Which of the four later bytes of a window go with its first.
WAYS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
BLOCK = 1 << 16


def bucket_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for low in range(0, max(len(b) - 2, 0), BLOCK):
        part = b[low : low + BLOCK + 4].astype(np.uint32)
        first = part * np.uint32(0x9E3779B1)
        second, third = part * np.uint32(0x85EBCA77), part * np.uint32(0xC2B2AE3D)
        for salt, (i, j) in enumerate(WAYS):
            n = min(len(part) - j, BLOCK)
            if n > 0:
                h = first[:n] + second[i : i + n]
                h ^= h >> np.uint32(15)
                h += third[j : j + n] + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
                h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount((h >> np.uint32(25)).view(np.int32), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """One byte of length, then 128 codes of one byte."""
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    codes = sum((counts > ranked[BUCKETS * k // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    length = min(255, round(8 * np.log2(len(data) + 1)))
    return bytes([length]) + codes.tobytes()


def to_hex(d: bytes) -> str:
    c = np.frombuffer(d, np.uint8)[1:].reshape(-1, 4)
    packed = (c[:, 0] << 6) | (c[:, 1] << 4) | (c[:, 2] << 2) | c[:, 3]
    return f"{d[0]:02x}" + packed.astype(np.uint8).tobytes().hex()


def from_hex(text: str) -> bytes:
    packed = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    codes = np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1).astype(np.uint8)
    return bytes([int(text[:2], 16)]) + codes.tobytes()


def difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    return int(CODE_COST[np.abs(x[1:] - y[1:])].sum()) + min(LENGTH_COST, abs(int(x[0]) - int(y[0])))


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / GREATEST


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [to_hex(digest((t or "").encode("utf-8"))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(docs: DataFrame, key: Column, n: int) -> list[tuple[int, int]]:
    """Falling (id, hash) pairs that part docs into about n even ranges. The rows of an id that holds several quantiles are
    parted by their hash."""
    times = Counter(int(x) for x in docs.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n))
    return sorted({(k, (j << 64) // m - (1 << 63)) for k, m in times.items() for j in range(m)}, reverse=True)


def _range_of(bounds: list[tuple[int, int]], key: Column, hash_: Column) -> Column:
    """How many bounds are greater than (key, hash_), by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    padded = bounds + [(-(1 << 63), -(1 << 63))] * (2 * steps[0] - 1 - len(bounds))
    held = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in padded])
    own = F.struct(key.alias("k"), hash_.alias("h"))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.element_at(held, at + step) > own, step).otherwise(0))


def _dealing(spark: SparkSession, n: int, parts: int) -> list[int]:
    """For each of n ranges a number that hash partitioning into `parts` deals to a partition of its own."""
    found: dict[int, int] = {}
    high = 1
    while len(found) < n:
        low, high = high, high * 2 + 16 * n
        for r in spark.range(low, high).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect():
            found.setdefault(r["p"], r["v"])
    return [found[p] for p in sorted(found)[:n]]


def against_next(docs: DataFrame, mb_each: float = 4.0) -> DataFrame:
    """doc_id, n_chars, edited text, both digests and their likeness to the edited text's and the next document's.

    Documents are dealt once, by ranges of doc_id; a range ends with a copy of the next range's first document, so that every
    neighbour is at hand. Ranges come from quantiles, of which there are as many as the input's size or the session's shuffle
    partitions ask; the driver gets two numbers a range.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), F.coalesce(docs.text.cast("string"), F.lit("")).alias("text"))
    n = max(1 << bucket_bits(docs, mb_each, most=15), int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = F.lit(-(1 << 63))
    key, hash_ = F.coalesce("doc_id", lowest), F.xxhash64("text")
    ranged = docs.withColumn("range", _range_of(_bounds(docs, key, n), key, hash_))
    top = ranged.groupBy("range").agg(F.max(F.struct(key.alias("k"), hash_.alias("h"))).alias("top")).orderBy("range").collect()
    if not top:
        schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], schema)
    # by range: its first document, and to where that is copied (the first range's closes the last)
    last = top[-1]["range"] + 1
    heads, closes = [(0, 0)] * last, [0] * last
    for i, r in enumerate(top):
        heads[r["range"]], closes[r["range"]] = (r["top"]["k"], r["top"]["h"]), top[i - 1]["range"]
    deal = _dealing(spark, last, max(last, 1))
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("range") + 1)
    is_head = (of([k for k, _ in heads]) == key) & (of([h for _, h in heads]) == hash_)
    own = F.struct(F.lit(0).alias("tail"), of(deal).alias("d"), F.col("range").alias("r"))
    copy = F.struct(F.lit(1).alias("tail"), of([deal[x] for x in closes]).alias("d"), of(closes).alias("r"))
    placed = ranged.select("doc_id", "text", hash_.alias("h"), F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("p.d", "p.r", "p.tail", key.alias("k"), "h", "doc_id", "text")
    dealt = placed.repartition(last, "d").sortWithinPartitions("r", "tail", F.desc("k"), F.desc("h")).select("r", "tail", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for r, tail, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                # of several equal heads one copy is enough, and the first serves; a tail's own row isn't returned
                if last is not None and last[0] == r and not last[1]:
                    own = digest(text.encode("utf-8"))
                    mixed = edited(last[3], text)
                    other = digest(mixed.encode("utf-8"))
                    row = (last[2], len(last[3]), mixed, to_hex(last[4]), to_hex(other), likeness(last[4], other), likeness(last[4], own))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += len(mixed)
                    last = (r, tail, doc_id, text, own)
                elif last is None or last[0] != r:
                    last = (r, tail, doc_id, text, digest(text.encode("utf-8")))
                if size > 1 << 24:
                    yield batch_of(out)
                    out, size = [[] for _ in names], 0
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
