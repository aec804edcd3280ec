"""Token counts by way of a digest cache.

A text is known by the SHA-256 of its content, a tokenizer by that of its file. Counts that the
cache holds are joined; of the other texts one copy each is encoded and its count appended, so
the same text is never counted twice under the same tokenizer. Nothing but digests and one copy
of each unknown text is shuffled, and copies are brought together inside the tasks first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from muster.functions.common import lookup_join
from muster.llm import units
from muster.llm.batches import arrow_map, rows_of

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Counts stored for this tokenizer; a folder that is not there is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(folder) if there else spark.createDataFrame([], CACHE_SCHEMA)
    # A count that two jobs have appended at the same time is the same number.
    return cache.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


class PieceCounts:
    """Counts under a SentencePiece model, text by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def values(self, texts: list[str]) -> list[list[int]]:
        return [[len(ids)] for ids in self.model.encode(texts, num_threads=1)]


def counter(path: str):
    if path.endswith(".model"):
        return PieceCounts(path)
    return units.ByteLevel(path, len, special=True)


def fill_cache(docs: DataFrame, folder: str, tokenizer_path: str, text_col: str = "text") -> None:
    """Append the counts of all texts that the cache does not hold yet."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    contents = docs.select(text.alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").dropDuplicates(["digest"])
    misses = contents.join(read_cache(spark, folder, version), "digest", "left_anti")

    def count(batches):
        tokens = units.worker(("count", tokenizer_path), lambda: counter(tokenizer_path))
        for batch in batches:
            for (digests,), texts in rows_of(batch, "text", "digest"):
                yield [pa.array([version] * len(texts)), digests, [sum(v) for v in tokens.values(texts)]]

    arrow_map(misses, count, CACHE_SCHEMA).write.mode("append").parquet(folder)


def token_counts(docs: DataFrame, folder: str, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, by the cache in ``folder``.

    ``folder`` must be one that all executors share. ``tokenizer_path`` is a byte-level BPE file
    of the tokenizers library (``.json``) or a SentencePiece model (``.model``); nothing is added
    to a text, and special strings in it count as the library counts them by default.

    A null text counts as empty: no bytes, no tokens. Rows with null or repeated ids each give
    their own row. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    fill_cache(docs, folder, tokenizer_path, text_col)
    cache = read_cache(docs.sparkSession, folder, tokenizer_digest(tokenizer_path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    asked = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    found = lookup_join(asked, cache, ["digest"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
