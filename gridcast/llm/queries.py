"""The queries of this subpackage and, where SQL can say them, the same in SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import bitsliced, chunked_bpe, circulant, edit_embed, fim_index, importance, langmask, merge_rounds, mixing, recompression, urlfilter, wavelet, zstd_quality

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op2_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~zstd_quality.held_out())
    scored = zstd_quality.score(docs, zstd_quality.fit(docs, labels))
    return scored.select("doc_id", zstd_quality.held_out().alias("held_out"), "score", "predicted")


@query
def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their 2-word shingles."""
    return circulant.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids in the token files."""
    files = wavelet.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return wavelet.read_documents(files)


@query
def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after repeats of 20 words are cut."""
    return recompression.remove_repeats(table(spark, sf_dir, "documents"), width=20, digest=True)


@query
def op6_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


SQL["op6_bitsliced_topk"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id,
        CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query
def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return chunked_bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digest=True)


@query
def op8_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the documents is held out."""
    docs = table(spark, sf_dir, "documents")
    found = langmask.identify(docs, langmask.fit(docs.where(~langmask.held_out())))
    return found.select("doc_id", langmask.held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and the class of near texts."""
    return edit_embed.with_classes(edit_embed.with_edits(table(spark, sf_dir, "documents")))


@query
def op11_fim_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and digests of the output and of the text restored from it."""
    return fim_index.digests(fim_index.transformed(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50))


SQL["op11_fim_rank_index"] = r"""
WITH lines AS (
    SELECT doc_id, COALESCE(text, '') AS t, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents
),
drawn AS (
    SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1,
        CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS d3,
        CAST('0x' || h[25:32] AS BIGINT) % 100 AS d4
    FROM lines
),
parts AS (
    SELECT doc_id, t, n,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 100 THEN 'plain'
             WHEN d4 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
        array_to_string(u[greatest(c1, c2) + 1:n], '') AS s
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents, resampled towards the texts of ``benchmark``."""
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, buckets=10_000, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they give back."""
    return merge_rounds.digests(merge_rounds.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True))
