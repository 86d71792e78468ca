"""Command line: convert books to a tree of markdown chapters, or show what would be written."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.meta import SchemaError, normalize, require_domains
from .operators.render import dry_run
from .sinks.tree import rendered, write_tree
from .sources import vocabulary
from .sources.registry import files, hold, reader, release

MODES = ("auto", "rich", "article", "lowscore")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("input", help="a book, or a pattern of many")
    p.add_argument("-f", "--format", help="pdf, fb2 or epub; else by extension")
    p.add_argument("-o", "--output", default=".", help="folder to write to")
    p.add_argument("--dry-run", action="store_true", help="show chapters, write nothing")
    p.add_argument("-d", "--domain", action="append", default=[])
    p.add_argument("-t", "--topic", action="append", default=[])
    p.add_argument("--edition")
    p.add_argument("-c", "--collection", help="of the vocabulary; else the name of the output folder")
    p.add_argument("-m", "--mode", default="auto", help=f"of PDF: {', '.join(MODES)}")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return convert(a, spark)
    except (SchemaError, ValueError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    finally:
        release()


def convert(a: argparse.Namespace, spark: SparkSession | None) -> int:
    """0 if every book was read; files that can't be are named, and the others converted all the same."""
    fmt = (a.format or a.input.rpartition(".")[2]).lower()
    mode = a.mode.lower()
    if fmt == "pdf" and mode not in MODES:  # other formats have no modes
        raise ValueError(f"Unknown mode: {a.mode} (choose from {', '.join(MODES)})")
    if not any(c in a.input for c in "*?[") and "://" not in a.input and not Path(a.input).exists():
        raise FileNotFoundError(f"No such file: {a.input}")
    read = reader(fmt)
    if a.domain or not a.dry_run:  # a dry run checks only what it is given
        collection = a.collection or Path(a.output).resolve().name
        require_domains(a.domain, vocabulary.load(Path(a.output), collection)[0], collection)
    if not a.topic and not a.dry_run:
        print("Warning: no topics given", file=sys.stderr)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    found = files(spark, a.input)
    if fmt == "pdf" and mode in ("article", "rich"):
        from .sources import spans as S

        books, chunks = S.read_spans(hold(S.spans_of(found)), S.metadata_of(found), mode)
    else:
        books, chunks = read(found)
    chunks = hold(chunks)
    failed = chunks.where("error is not null").select("doc_id", "error").orderBy("doc_id").limit(20).collect()
    for r in failed:
        print(f"Error: {r['doc_id']}: {r['error']}", file=sys.stderr)
    if failed and chunks.where("error is null").isEmpty():
        return 1
    books, chunks = books.where("error is null") if "error" in books.columns else books, chunks.where("error is null")
    if a.dry_run:
        print(f"{books.count()} book(s), {chunks.select('doc_id', 'group_no').distinct().count()} chapter(s), {chunks.count()} chunk(s)")
        for r in dry_run(chunks).orderBy("doc_id", "group_no", "chunk_pos").toLocalIterator():
            print(f"{r['label']}\n    {r['preview']}")
        return 1 if failed else 0
    text = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    cards = normalize(books.withColumn("domains", text(a.domain)).withColumn("topics", text(a.topic)).withColumn("edition", F.lit(a.edition).cast("string")))
    print(f"Wrote {write_tree(rendered(cards, chunks), a.output)} file(s) to {a.output}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
