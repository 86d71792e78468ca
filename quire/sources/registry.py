"""Formats, and files as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {}


def register(name: str) -> Callable:
    def keep(reader: Callable) -> Callable:
        _READERS[name] = reader
        return reader

    return keep


_HELD: list[DataFrame] = []


def hold(parsed: DataFrame) -> DataFrame:
    """Kept on the executors' disks until release(), so that files are parsed once for all that is made of them; what is lost with an
    executor is parsed again."""
    _HELD.append(parsed.persist(StorageLevel.DISK_ONLY))
    return _HELD[-1]


def release() -> None:
    """To be called when what was read has been used."""
    while _HELD:
        _HELD.pop().unpersist()


def supported() -> list[str]:
    from . import epub, fb2, spans  # noqa: F401  they register themselves

    return sorted(_READERS)


def reader(name: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """files(doc_id, path, content) -> (books, chunks)."""
    names = supported()
    if name.lower() not in names:
        raise ValueError(f"Unsupported format: {name} (supported: {', '.join(names)})")
    return _READERS[name.lower()]


def format_of(path: Column, given: Column | None = None) -> Column:
    """The given format, else the extension, in lower case."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return ext if given is None else F.coalesce(F.lower(given), ext)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """doc_id (the path), path, content; content isn't read where it isn't selected."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("doc_id"), "path", "content")
