"""A training-corpus pipeline over the documents table.

Five stages, each over all rows that its predecessor kept:

  language   documents whose language isn't recognised go (op 3)
  exact      of equal texts one row stays (op 7)
  near       of near-duplicates one document stays (op 9)
  benchmark  documents in which a benchmark window occurs go (op 1)
  encode     texts become token ids, decoded again as a check (op 5)

All but the last return the columns of documents.

Cases: texts that are null, empty or without a letter are in no language and
go in the first stage, as all texts do if none is labelled; of rows that
repeat doc_id and text one stays; a null doc_id is kept as it is; an
empty table gives an empty result; columns beyond those of documents pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from tidemark.llm.common import cut, scratch
from tidemark.llm.entries import BLANK_BEGINS, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.known_language(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *vocabulary(), blank_begins=BLANK_BEGINS)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("encode", encode)]

#: Language prediction and near-duplicate search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a Parquet table in the shared folder and the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as put:
        for _, stage in STAGES[:-1]:
            docs = put(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
