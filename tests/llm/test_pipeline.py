import brute
import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from gridcast.llm import chunked_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
        out.append(docs)
    return [df.collect() for df in out]


def test_quality_is_a_filter(kept):
    before, after = {(r.doc_id, r.text) for r in kept[0]}, {(r.doc_id, r.text) for r in kept[1]}
    assert after < before and len(after) > 0.7 * len(before)


def test_near_duplicates(kept):
    want = brute.near([(r.doc_id, r.text) for r in kept[1]], size=5)
    assert {r.doc_id for r in kept[2]} == {d for d, w in want.items() if w[2]}


def test_repeated_passages(kept):
    want = brute.repeats([(r.doc_id, r.text) for r in kept[2]])
    got = {r.doc_id: len(r.text.split()) for r in kept[3]}
    assert got == {d: n - gone for d, (n, gone, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in kept[3])


def test_mix_takes_and_repeats(kept):
    sizes = {}
    for r in kept[3]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    taken = sum(len(r.text.encode().split()) for r in kept[4])
    assert abs(taken - 1.5 * sum(sizes.values())) <= len(sizes) * max(len(r.text.split()) for r in kept[3])
    counts = {}
    for r in kept[4]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) == 2


def test_tokens_decode_to_the_text(kept):
    codec = chunked_bpe.Codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    got = sorted((r.doc_id, codec.decode(r.ids).decode()) for r in kept[5])
    assert got == sorted((r.doc_id, r.text) for r in kept[4])
    assert all(r.n_tokens == len(r.ids) for r in kept[5])


def test_near_duplicates_without_an_id_of_their_own(spark):
    """One row stays of exact copies with null ids and of a repeated row; a text does not go with another of its id."""
    text = [" ".join(f"w{k}-{i}" for i in range(40)) for k in range(5)]
    rows = [(None, text[0], i) for i in range(6)] + [(None, text[1], 6), (3, text[2], 7), (3, text[2], 8)]
    rows += [(1, text[3], 9), (2, text[3] + " more", 10), (2, text[4], 11), (None, None, 12), (None, None, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int").repartition(3)
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(None, text[0]), (None, text[1]), (3, text[2]), (1, text[3]), (2, text[4]), (None, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
