"""SimHash near duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

The 64 bits are cut into radius + extra blocks: fingerprints within `radius` bits of each other agree on `extra` blocks at least,
so distinct fingerprints meet by each choice of `extra` blocks and their value. `extra` follows the number of fingerprints
(1 up to 2^26, with values of 12 bits, 2 up to 2^34, with 21 bits, then 3), which changes the meetings and not the links. A meeting of more
than TILE fingerprints is split into tiles by population count and, within one count, by a hash; a pair of tiles is a task of
its own, unless the tiles' counts differ by more than the radius: such pairs are never made. Within a task rows are sorted by
population count, and two runs of rows are compared (numpy exclusive-or and bit counts) on the same condition. A task returns
a forest of the links it found, never all pairs; components come from these forests. Fingerprints or components that hold
more than a thousandth of the rows (a thousand at most) are joined by broadcast, so that no key meets in one task.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; equal texts have
equal fingerprints; repeated rows fall in one component; null ids count last when the smallest id is taken (a component
of null ids alone has a null id); very long texts have one fingerprint like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import LOWER_AZ, bucket_bits, key_store, mix64, pick, rewrite_rows, settled, utf8
from .components import stars, union_pairs

SEED = 42
#: Fingerprints of a meeting that one task compares with each other, and rows of one comparison.
TILE, RUN = 8192, 512


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned; text is UTF-8."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp long (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int, extra: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + extra blocks that cover 64 bits."""
    edges = np.linspace(0, 64, radius + extra + 1).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def meetings(radius: int, extra: int) -> list[Column]:
    """For each choice of `extra` blocks its number and the bits of fp in them."""
    out = []
    for k, chosen in enumerate(combinations(blocks(radius, extra), extra)):
        value, at = F.lit(0).cast("long"), 0
        for shift, width in chosen:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1), at))
            at += width
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    return out


def compare(rows: np.ndarray, sides: np.ndarray, radius: int, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among rows; crossed: only between side 0 and side 1."""
    order = np.argsort(np.bitwise_count(rows), kind="stable")
    rows, sides = rows[order], sides[order]
    ones = np.bitwise_count(rows).astype(np.int16)
    parent = np.arange(len(rows))
    for i in range(0, len(rows), RUN):
        last = int(ones[min(i + RUN, len(rows)) - 1])
        stop = int(np.searchsorted(ones, last + radius, "right"))
        for j in range(i, stop, RUN):
            near = np.bitwise_count(rows[i : i + RUN, None] ^ rows[None, j : min(j + RUN, stop)]) <= radius
            if crossed:
                near &= sides[i : i + RUN, None] != sides[None, j : min(j + RUN, stop)]
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            keep = a < b
            if keep.any():
                parent = union_pairs(parent, a[keep], b[keep])
    linked = np.flatnonzero(parent != np.arange(len(rows)))
    return rows[linked], rows[parent[linked]]


def links(fps: DataFrame, radius: int = 4, extra: int = 1) -> DataFrame:
    """Distinct fingerprints fp -> (a, b) whose components are those of all links within the radius."""
    met = fps.select("fp", F.explode(F.array(*meetings(radius, extra))).alias("p")).select("fp", "p.block", "p.value")
    large = met.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("block", "value", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    # of one block in radius + 1 there are few values of 13 bits; of more the list has no bound, and Spark decides
    met = met.join(F.broadcast(large) if extra == 1 else large, ["block", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # a large meeting's tiles: 65 counts of `parts` tiles; partners of a tile: those of counts within the radius
    ones, parts = F.bit_count("fp"), F.ceil(F.col("tiles") / 8).cast("int")
    met = met.withColumn("parts", parts).withColumn("tile", ones * parts + F.pmod(F.xxhash64("fp"), parts).cast("int"))
    reach = F.sequence(F.greatest(ones - radius, F.lit(0)) * F.col("parts"), (F.least(ones + radius, F.lit(64)) + 1) * F.col("parts") - 1)
    met = met.withColumn("tile", F.when(F.col("tiles") > 1, F.col("tile")).otherwise(0)).withColumn("other", F.explode(F.when(F.col("tiles") > 1, reach).otherwise(F.array(F.lit(0)))))
    keys = ["block", "value", "low", "high"]
    met = met.select("block", "value", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
            ends, out_a, out_b = np.append(cut, len(table)), [], []
            start = 0
            for end in ends.tolist():
                if end - start > 1:
                    part = table[start:end]
                    a, b = compare(np.ascontiguousarray(part[:, 5]).view(np.uint64), part[:, 4], radius, bool(part[0, 2] != part[0, 3]))
                    out_a.append(a)
                    out_b.append(b)
                start = end
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a).view(np.int64)), pa.array(np.concatenate(out_b).view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            if not len(rows):
                continue
            table = np.concatenate([*held, rows])
            new = np.flatnonzero((table[:, :4] != table[-1, :4]).any(axis=1))
            whole = int(new[-1]) + 1 if len(new) else 0
            if whole:
                yield from flush(table[:whole])
            held = [table[whole:]]
        if held:
            yield from flush(np.concatenate(held))

    spread = met.repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "a long, b long").distinct()


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right(key, n, ...), n being the number of left's rows of a key. Keys of more than a thousandth of all rows,
    a thousand at most, are joined by broadcast, the others by a shuffle."""
    heavy = F.col("n") * 1000 > right.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest, hot = right.where(~heavy).drop("n"), right.where(heavy).drop("n")
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id that links reach."""
    found = settled(fingerprints(docs, shingle), "simhash")
    nodes = settled(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-nodes")
    held = nodes.count()
    roots = stars(links(nodes.select("fp"), radius, 1 if held <= 1 << 26 else 2 if held <= 1 << 34 else 3))
    joined = settled(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of = spread_join(joined.select("fp", "root", "rows"), least, "root").select("fp", "component_id", F.col("rows").alias("n"))
    return spread_join(found, of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents without those whose id isn't the smallest of their component. Rows that repeat an id share its fate, and a
    null id goes where its component has another. The ids to drop are a store in the shared folder; texts aren't shuffled."""
    found = near_duplicates(docs, shingle, radius).where("not doc_id <=> component_id")
    rest = settled(found.select("doc_id"), "copies")
    no_id = rest.where("doc_id is null").limit(1).count() > 0
    gone = key_store(rest, bucket_bits(rest, 16.0), "copies")

    def change(batch: pa.RecordBatch, at_id: int, _: int) -> pa.RecordBatch:
        ids = batch.column(at_id)
        drop = gone.index(mix64(ids.fill_null(0).to_numpy(zero_copy_only=False))) >= 0
        drop = np.where(ids.is_null().to_numpy(zero_copy_only=False), no_id, drop)
        return batch.filter(pa.array(~drop))

    return rewrite_rows(docs, change)
