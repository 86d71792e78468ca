"""The controlled vocabulary: a YAML file found by walking up from a folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.meta import SchemaError

FILE = "vocabulary.yaml"


def find(start: Path, name: str = FILE) -> Path | None:
    start = start.resolve()
    folders = ([start] if start.is_dir() else []) + list(start.parents)
    return next((f / name for f in folders if (f / name).is_file()), None)


def load(start: Path, collection: str) -> tuple[list[str], list[str]]:
    """The collection's domains (a closed list) and topics (an open one)."""
    import yaml

    path = find(Path(start))
    if path is None:
        raise SchemaError(f"{start}: neither this folder nor one above it has a {FILE}")
    known = (yaml.safe_load(path.read_text()) or {}).get("collections") or {}
    try:
        entry = known[collection] or {}
    except KeyError:
        raise SchemaError(f"{path} knows no collection {collection}, only: {', '.join(sorted(known))}") from None
    return tuple(list(entry.get(part) or []) for part in ("domains", "topics_registry"))


def table(spark: SparkSession, start: Path, collection: str) -> DataFrame:
    """collection, domain."""
    return spark.createDataFrame([(collection, d) for d in load(start, collection)[0]], "collection string, domain string")
