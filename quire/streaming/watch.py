"""New books as they arrive: a stream over a folder, each micro-batch converted and written like a batch run."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.meta import normalize, require_domains
from ..sinks.tree import rendered, write_tree
from ..sources import vocabulary
from ..sources.registry import reader, release


def watch(spark: SparkSession, folder: str, fmt: str, out: str, state: str, domains: list[str], once: bool = False, collection: str | None = None) -> StreamingQuery:
    """state: the folder of the stream's checkpoint. once: what is there now, then stop. The domains are checked against the
    vocabulary of the collection (by default: the name of the output folder) before the stream starts. Files that can't be
    read are added, with their error, to the table `_errors` (Parquet) in the output folder."""
    collection = collection or Path(out).name
    require_domains(domains, vocabulary.load(Path(out), collection)[0], collection)
    read = reader(fmt)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*.{fmt}").load(folder)

    def convert(batch: DataFrame, number: int) -> None:
        books, chunks = read(batch.select(F.col("path").alias("doc_id"), "path", "content"))
        kept = books.where("error is null") if "error" in books.columns else books
        cards = normalize(kept.withColumn("domains", F.array(*[F.lit(d) for d in domains]).cast("array<string>")))
        write_tree(rendered(cards, chunks), out)
        failed = chunks.where("error is not null").select("doc_id", "error")
        if not failed.isEmpty():  # a batch that runs again replaces its own file
            failed.write.mode("overwrite").parquet(f"{out}/_errors/batch={number}")
        release()

    query = files.writeStream.foreachBatch(convert).option("checkpointLocation", state)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 minute")).start()
