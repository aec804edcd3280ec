"""Pipeline from raw documents to packed training sequences, in stages that can be run one by one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from muster.llm import fertility, packing, simhash, toxicity
from muster.llm.batches import stored
from muster.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, trained on the labelled ones among them, don't predict as toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of these documents."""
    # Written with the texts, compressed, so that they are neither measured twice nor shuffled.
    measured = stored(fertility.measure(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model")), "quality")
    return fertility.judge(measured).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), words=3, distance=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: The models, tokenizers and links of the stages cannot be said in SQL; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
