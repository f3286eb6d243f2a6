"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept.
All but the last return the columns of documents. ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next one, so that a lost executor
costs no more than the stage at work. Stages take tables with NULLs, empty or long texts,
repeated rows, more columns and no rows at all as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontam, idcodec, mixing, simhash, toxicity
from veilspark.llm.common import packed, read
from veilspark.session import scratch


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from labels, doesn't reject.

    NULL, empty and very long texts are scored like others; repeated rows share their fate; columns of any name stay; no documents give none.
    """
    scored = toxicity.judge(packed(docs, "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.where("predicted = 0").select("_row.*")


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id.

    NULL and empty texts are one group; rows without an id yield to those with one; equal rows of that id stay together in one row.
    """
    return simhash.one_per_group(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of.

    NULL and empty texts have none and stay; without a benchmark all stay; repeated rows share their fate.
    """
    judged = decontam.judge(packed(docs, "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.where("not contaminated").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A NULL source is one of its own, the last; a document without words is taken as often as the mix passes it; equal rows are each drawn for themselves.
    """
    return mixing.copies(mixing.mix(packed(docs, "doc_id", "text", "source"))).select("_row.*")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix what the coded files hold: doc_id, start, n_tokens, ids_crc32.

    NULL and empty texts have the end id alone; NULL ids come first; a document taken twice has two rows.
    """
    return idcodec.digest(idcodec.round_trip(docs, forget=True))


STAGES = [("toxicity", keep_civil), ("near_duplicates", keep_one_of_a_kind), ("decontamination", keep_uncontaminated),
          ("mixing", mix_sources), ("token_ids", write_token_ids)]

#: trees, components of fingerprints and tokenizers are beyond SQL; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
