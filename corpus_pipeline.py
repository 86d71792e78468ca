"""A corpus pipeline of five operators: toxicity, quality rules, near duplicates, repeated substrings, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and read again for the next. All but
the last return the columns of documents. Stages 1 to 3 drop whole documents (toxic ones; those that fail the quality rules, whose
boilerplate lines go as well; all but the smallest id of each near-duplicate group), stage 4 cuts repeated bytes, stage 5 packs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import packing, quality, simhash, suffixes, toxicity
from quire.llm._core import shared_root
from quire.llm.queries import training_labels


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels are learned from those training labels whose documents are among docs; without any of both
    classes, all documents have the toxic share of the labels as score."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, training_labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than 20 distinct documents of a host hold are cut; documents that fail the base rule or keep less than a fifth of
    their words go, and so do null and empty texts (no words). n_chars is counted anew; an empty table stays empty."""
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component stays; rows that repeat its id stay with it, and rows without an id go where
    their component has one."""
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier in the corpus are cut, with what a cut leaves of a character; no row goes, a
    text may end empty (a null text does). n_chars is counted anew."""
    return suffixes.cut_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of binary length, 4,096 ids at most, gathered by length; an empty text is its end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can't express the stages; tests hold them against a brute-force version.
ORACLE_SQL = None
