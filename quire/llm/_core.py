"""What the operators share: column choice, the shared folder, sorted arrays on disk, merging by bucket."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Lower-cases A-Z only, as the contracts ask.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- columns


#: Bytes of a batch between Spark and a worker: both hold several copies of one, and documents can be long.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of a batch to BATCH_BYTES, unless it is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = str(spark.conf.get(name))
    held = 0 if value.startswith("-") else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, even ones whose names differ only in case or occur twice, do no harm."""
    small_batches(df.sparkSession)
    seen: set[str] = set()
    renamed = []
    for i, c in enumerate(df.columns):
        keep = c in names and c not in seen
        seen.add(c)
        renamed.append(c if keep else f"__other_{i}")
    missing = [n for n in names if n not in seen]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.toDF(*renamed).select(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Rows that a worker holds as Python objects at a time.
ROWS = 2000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


# ---------------------------------------------------------------- the shared folder


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all workers are on this machine, as in tests, a folder of it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    path = local_path(uri)
    if path:
        os.makedirs(path, exist_ok=True)
    return uri


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return unquote(urlparse(uri).path)
    return None if "://" in uri else uri


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_array(uri: str, name: str, values: np.ndarray) -> None:
    """Written under another name and moved, so that a task that runs twice leaves one whole file."""
    path = local_path(uri)
    if path:
        partial = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(partial, "wb") as f:
            np.save(f, values)
        os.replace(partial, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    partial = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as f:
        sink = pa.PythonFile(f, mode="w")
        np.save(sink, values)
    store.move(partial, f"{base}/{name}.npy")


_OPEN: dict[tuple[str, str], np.ndarray] = {}
#: Arrays that a worker process keeps mapped; systems allow some 65,000 mappings.
MAPPED = 1 << 14


def open_array(uri: str, name: str) -> np.ndarray:
    """Memory-mapped; one mapping for each worker process. The ones opened first go when there are too many."""
    key = (uri, name)
    if key not in _OPEN:
        if len(_OPEN) >= MAPPED:
            for old in list(_OPEN)[: MAPPED // 4]:
                del _OPEN[old]
        path = local_path(uri)
        if path:
            _OPEN[key] = _mapped(f"{path}/{name}.npy")
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(uri)
            fd, copy = tempfile.mkstemp(suffix=".npy")
            try:
                with store.open_input_stream(f"{base}/{name}.npy") as src, os.fdopen(fd, "wb") as out:
                    while chunk := src.read(1 << 22):
                        out.write(chunk)
                _OPEN[key] = _mapped(copy)
            finally:
                os.unlink(copy)  # the mapping stays valid
    return _OPEN[key]


def _mapped(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r").view(np.ndarray)  # a plain array is quicker to index
    except ValueError:  # an empty array can't be mapped
        return np.load(path)


# ---------------------------------------------------------------- buckets


#: Tasks of a merge at most; where there are more buckets, a task merges several, one after another.
MERGES = 1 << 14


def bucket_bits(df: DataFrame, mb_each: float, least: int = 2, most: int = 17) -> int:
    """log2 of a number of buckets in proportion to the size of what df reads. From 2^most on (0.8 GB of input a bucket at 100 TB, of which
    a store keeps a part) buckets grow, since each batch sends a row to each."""
    exact = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if exact >= 2.0**60:  # the planner doesn't know
        exact = float(df.select(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(8)).alias("n")).agg(F.sum("n")).first()[0] or 0)
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, exact / (mb_each * 1e6)))))))


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int32)


def cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys begins; one more at the end."""
    bounds = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
    return np.append(np.searchsorted(sorted_keys, bounds), len(sorted_keys))


def merge_by_bucket(df: DataFrame, bits: int, merge: Callable[[int, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """df has an int column `bucket` and binary columns. Rows of a bucket come together, one bucket at a time in memory; the sort that
    brings them together spills."""
    names = df.columns
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                if at is not None and row["bucket"] != at:
                    yield from _emit(merge(at, held), out_schema)
                    held = []
                at = row["bucket"]
                held.append(row)
        if at is not None:
            yield from _emit(merge(at, held), out_schema)

    return df.select(*names).repartition(min(1 << bits, MERGES), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _emit(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed, so that what is shuffled stays small."""
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def join_packed(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(unpacked(r[name]), dtype) for r in rows]) if rows else np.empty(0, dtype)


def join_arrays(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], dtype) for r in rows]) if rows else np.empty(0, dtype)


# ---------------------------------------------------------------- sorted arrays


@dataclass(frozen=True)
class SortedStore:
    """Keys sorted within buckets of their top bits, with fields beside them: files `k.<bucket>` and `<field>.<bucket>`."""

    uri: str
    bits: int
    sizes: tuple[int, ...]
    stats: tuple[int, ...] = ()  # sums, over the buckets, of what the merge reported

    def __len__(self) -> int:
        return sum(self.sizes)

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the whole store, -1 where it has none."""
        if not len(keys):
            return np.empty(0, np.int64)
        if not len(self):
            return np.full(len(keys), -1, np.int64)
        wanted, back = np.unique(keys, return_inverse=True)
        found = np.full(len(wanted), -1, np.int64)
        at, first = cuts(wanted, self.bits), self.offsets
        for b in np.flatnonzero(np.diff(at)):
            if self.sizes[b]:
                held = open_array(self.uri, f"k.{b}")
                part = wanted[at[b] : at[b + 1]]
                i = np.searchsorted(held, part)
                i[i == len(held)] = 0
                hit = held[i] == part
                found[at[b] : at[b + 1]] = np.where(hit, i + first[b], -1)
        return found[back]

    def field(self, name: str, index: np.ndarray, dtype) -> np.ndarray:
        """The field's values at places from index(); 0 where the place is -1."""
        out = np.zeros(len(index), dtype)
        first = self.offsets
        order = np.argsort(index, kind="stable")
        ranked = index[order]
        at = np.searchsorted(ranked, first)
        for b in np.flatnonzero(np.diff(at)):
            rows = order[at[b] : at[b + 1]]
            out[rows] = open_array(self.uri, f"{name}.{b}")[ranked[at[b] : at[b + 1]] - first[b]]
        return out


def build_store(df: DataFrame, bits: int, label: str, merge: Callable[[list[dict]], tuple]) -> SortedStore:
    """merge turns a bucket's rows into its sorted keys, their fields and, if any, numbers to add up; the driver gets a few numbers a bucket."""
    uri = fresh_dir(df.sparkSession, label)

    def write(bucket: int, rows: list[dict]) -> Iterator[dict]:
        keys, fields, *stats = merge(rows)
        save_array(uri, f"k.{bucket}", keys)
        for name, values in fields.items():
            save_array(uri, f"{name}.{bucket}", values)
        yield {"bucket": bucket, "n": len(keys), "stats": [int(x) for x in stats[0]] if stats else []}

    sizes, sums = [0] * (1 << bits), []
    for row in merge_by_bucket(df, bits, write, "bucket int, n long, stats array<long>").collect():
        sizes[row["bucket"]] = row["n"]
        sums.append(row["stats"])
    return SortedStore(uri, bits, tuple(sizes), tuple(map(sum, zip(*sums, strict=True))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that ids spread over the buckets."""
    x = np.asarray(x).astype(np.int64).view(U64) if np.asarray(x).dtype != U64 else np.array(x)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def key_store(keys: DataFrame, bits: int, label: str) -> SortedStore:
    """The distinct values of a frame's one long column (scrambled by mix64) as a store."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.unique(mix64(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
            at = cuts(k, bits)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([k[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "keys"])

    def merge(rows: list[dict]) -> tuple[np.ndarray, dict]:
        return np.unique(join_arrays(rows, "keys", U64)), {}

    return build_store(keys.mapInArrow(scatter, "bucket int, keys binary"), bits, label, merge)


def rewrite_rows(docs: DataFrame, change: Callable[[pa.RecordBatch, int, int], pa.RecordBatch]) -> DataFrame:
    """docs with its columns, each batch passed through change(batch, place of doc_id, place of text)."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch, at_id, at_text)

    return plain.mapInArrow(run, plain.schema).toDF(*names)


# ---------------------------------------------------------------- words


def words_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space of a batch's texts: where each row's begin (one more at the end), each word's code,
    and the distinct words by code. Splitting and coding stay in Arrow; Python sees a distinct word once a batch."""
    column = pc.fill_null(column.cast(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = pc.dictionary_encode(split.flatten().cast(pa.binary()))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    starts = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
    distinct = flat.dictionary.to_pylist()
    if b"" in distinct:  # before leading and after trailing white space
        keep = codes != distinct.index(b"")
        starts = np.append(0, np.cumsum(keep))[starts]
        codes = codes[keep]
    return starts.astype(np.int64), codes, distinct


def gather(codes: np.ndarray, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces named by codes, one after another, as items of width bytes, and how many items each code gave."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
    flat = np.frombuffer(b"".join(pieces), f"<u{width}")
    begin = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.cumsum(each)
    place = np.repeat(begin[codes] + each - ends, each)
    place += np.arange(len(place))
    return flat[place], each
