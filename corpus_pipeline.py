"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Quality classifier, near-duplicate removal, repeated passages, mixing of sources, byte-level BPE. All but the last
return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.llm import chunked_bpe, circulant, mixing, recompression, zstd_quality
from gridcast.llm.common import shielded, stored
from gridcast.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the compression classifier takes for good; ``labels`` train it."""
    ship_package(spark)
    model = zstd_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return zstd_quality.score(docs, model, keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, with the smallest doc_id, of each group that shares 80 % of its five-word shingles. Rows with a
    null doc_id, or with one doc_id, are judged by their own texts."""
    ship_package(spark)
    own, back = shielded(docs, "doc_id", "text")
    rows = circulant.numbered(own)
    kept = circulant.near_duplicates(rows, size=5, percent=80, rows=True).where("kept").select(F.col("row").alias("_kept"))
    return back(rows.join(kept, rows["row"] == kept["_kept"], "left_semi"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every stretch of 20 words or more that an earlier document or place has already. ``n_chars`` follows; a
    document of which nothing is left stays, with an empty text."""
    ship_package(spark)
    own, back = shielded(docs, "doc_id", "text")
    out = back(recompression.remove_repeats(own, width=20))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words meet their targets."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens): the token ids of every text."""
    ship_package(spark)
    ids = chunked_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

# three stages decide by trained weights, hashes or ids that SQL cannot express; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
