"""Corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing to weights, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet into the
shared folder and reads it back as the documents of the next. All but the last keep the columns of ``documents``.

Defined results: a null, empty or blank text fails the quality rules, so later stages see words in every document;
very long texts are read whole by each stage; of rows that share an id and of documents that are alike one stays, ties
going to the smallest id (rows of one id: to the smallest hash of the text); rows with a null id pass the near-duplicate
stage, each on its own; an empty table gives an empty table; further columns pass through, whatever their names, and
the last stage's new columns get an underscore in front where they clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import every, shared_folder, table, unique_name
from millrace.llm.decontamination import decontaminate
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import first_of_each
from millrace.llm.quality_rules import keep_good
from millrace.llm.sharding import document_dims, hilbert_shards

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's weight says; copies share their id."""
    return mix_sources(docs).select(*every(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in 16 shards along the Hilbert curve of language, source and size."""
    out = hilbert_shards(docs, document_dims(size=F.octet_length(F.coalesce("text", F.lit("")))))
    return out.select(*every(docs), *[unique_name(docs, n) for n in ("curve_index", "shard", "slot")])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The divergence verdicts and the curve are not put into SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
