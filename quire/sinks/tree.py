"""Rendered files to folders, and folders to files: one task writes a document's files, each under another name first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.render import book_card, chapter_files

#: Characters of files that are read before they are passed on.
READ_AT_ONCE = 8 << 20


def unique_ids(books: DataFrame) -> DataFrame:
    """Books whose ids name folders of their own: of several books of one id, the second in order of doc_id gets "-2", and so on. A
    name that another book has already is passed over only if that book comes first; then its own number tells them apart."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("doc_id"))
    return books.withColumn("_nth", nth).withColumn("id", F.when(F.col("_nth") > 1, F.concat_ws("-", "id", F.col("_nth").cast("string"))).otherwise(F.col("id"))).drop("_nth")


def rendered(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, path, body of all files: the card and the chapters. Rows with an error are left out."""
    books, chunks = (df.where("error is null") if "error" in df.columns else df for df in (books, chunks))
    books = unique_ids(books)
    cards = book_card(books).join(books.select("doc_id", "id"), "doc_id").select("doc_id", F.concat("id", F.lit("/00-book.md")).alias("path"), F.col("card").alias("body"))
    return cards.unionByName(chapter_files(chunks, books).select("doc_id", "path", "body"))


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, which may be a path or an address (file:, hdfs:, s3: and the like), and its path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tree(files: DataFrame, folder: str, prune: bool = False) -> int:
    """Writes files(doc_id, path, body) under a folder that all executors share, through the store's own interface; returns how many.

    Files of the same name are overwritten; others stay, unless prune is set, which removes chapters of a written book that
    aren't among its files. A document's files are written, and its folder pruned, by one task. There are as many tasks as shuffle
    partitions: files take time by their number, so their few bytes don't tell how many tasks they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        n = 0
        for _, own in groupby(rows, itemgetter(0)):
            names: dict[str, set[str]] = {}
            for _, path, body in own:
                book, _, name = path.rpartition("/")
                if book not in names:
                    store.create_dir(f"{root}/{book}", recursive=True)
                    names[book] = set()
                partial = f"{root}/{book}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(partial) as f:
                    f.write(body.encode("utf-8"))
                store.move(partial, f"{root}/{path}")
                names[book].add(name)
            for book, held in names.items() if prune else ():
                for info in store.get_file_info(fs.FileSelector(f"{root}/{book}")):
                    if info.base_name.endswith(".md") and info.base_name not in held:
                        store.delete_file(info.path)
            n += sum(map(len, names.values()))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = files.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(_tasks(files), "doc_id").sortWithinPartitions("doc_id")
    written = dealt.select("doc_id", "path", "body").mapInArrow(run, "n long")
    return int(written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def read_tree(ids: DataFrame, folder: str) -> DataFrame:
    """path, body of the markdown files in the folders of books(id) under a folder that all executors share. Tasks list the folders
    that they read, so that no process holds the names of all files; a book without a folder is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            paths: list[str] = []
            bodies: list[str] = []
            size = 0
            for book in batch.column(0).to_pylist():
                names = (info.base_name for info in store.get_file_info(fs.FileSelector(f"{root}/{book}")) if info.type == fs.FileType.File)
                for name in sorted(n for n in names if n.endswith(".md") and not n.startswith(".")):
                    with store.open_input_stream(f"{root}/{book}/{name}") as f:
                        bodies.append(f.read().decode("utf-8"))
                    paths.append(f"{book}/{name}")
                    size += len(bodies[-1])
                if size > READ_AT_ONCE:
                    yield pa.RecordBatch.from_pydict({"path": paths, "body": bodies})
                    paths, bodies, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "body": bodies})

    own = ids.select("id").where("id is not null").repartition(_tasks(ids), "id").distinct()
    return own.mapInArrow(run, "path string, body string")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
