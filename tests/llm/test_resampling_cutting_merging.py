"""Fill-in-middle, importance resampling and word-level BPE against plain versions, and their edge cases."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import compare, connect
from test_operators import LARGER, SF, nothing, odd_documents
from tokenizers import Tokenizer

from gridcast.llm import fim_index, importance, merge_rounds
from gridcast.llm.queries import QUERIES, SQL

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 -----------------------------------------------------------------------------------------------------------------
def plain_cut(text, doc_id):
    """(n, form, prefix_chars, middle_chars, output)"""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{doc_id}")
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_cuts_equal_sql(spark):
    assert compare(QUERIES["op11_fim_rank_index"](spark, LARGER), connect(LARGER), SQL["op11_fim_rank_index"]) == []


def test_cuts_equal_plain_version(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("ab\n\né漢<PSM>", k=rnd.randrange(40))) for _ in range(2000)]
    texts += ["", "\n", "\n\n", "a", "<P", "x<\ny<S", "\n".join("y" * rnd.randrange(9000) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = fim_index.restored(fim_index.transformed(docs)).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out} == {i: plain_cut(t, i) for i, t in enumerate(texts)}
    assert all(r.restored == texts[r.doc_id] for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("error", [0, 1, 50, 8192])
def test_rank_index_is_exact_within_its_error(error):
    rnd = random.Random(error)
    for offsets in ([0], [0, 5], list(np.cumsum([rnd.randrange(1, 300) for _ in range(5000)])), [0, 10**12, 10**12 + 1, 3 * 10**12], [7] * 100):
        offsets = np.array(offsets, np.int64)
        index = fim_index.fit(offsets, error)
        assert (index.offset(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual).max() <= error + 1
    assert len(fim_index.fit(np.arange(0, 100_000, 10), error).start) == 1


def test_cuts_share_of_forms(spark):
    docs = spark.createDataFrame([(i, "a\nb\n") for i in range(400)], "doc_id long, text string")
    forms = [r.form for r in fim_index.transformed(docs, fim_percent=40, spm_percent=0).collect()]
    assert set(forms) == {"plain", "psm"} and 110 < forms.count("psm") < 210


def test_cuts_edges(spark):
    out = fim_index.transformed(odd_documents(spark)).collect()
    assert len(out) == 10
    none = [r for r in out if r.doc_id is None]
    assert [(r.n, r.form, r.output, r.prefix_chars) for r in none] == [(0, "plain", "", None)]
    twice = [r for r in out if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert fim_index.digests(fim_index.transformed(nothing(spark))).count() == 0
    assert fim_index.draws(7, None) == [int(sha("7:")[i:i + 8], 16) for i in range(0, 32, 8)]


# 12 -----------------------------------------------------------------------------------------------------------------
def plain_grams(text):
    """(words, n-grams)"""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i:i + k]).encode() for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets=10_000):
    """doc_id -> (n_features, weight, score, rank)"""
    grams = {d: plain_grams(t) for d, t in docs}
    s, t = [0] * buckets, [0] * buckets
    for _, g in grams.values():
        for x in g:
            s[zlib.crc32(x) % buckets] += 1
    for text in target:
        for x in plain_grams(text)[1]:
            t[zlib.crc32(x) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = {}
    for d, (_, g) in grams.items():
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g)
        h = int(sha(f"42:{d}")[:8], 16)
        out[d] = [len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[d][2], d) for d in out if grams[d][0] >= 20)
    for rank, (_, d) in enumerate(able[: 5 * len(able) // 100], 1):
        out[d][3] = rank
    return {d: tuple(x) for d, x in out.items()}


def test_resampling_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in QUERIES["op12_importance"](spark, LARGER).collect()}
    want = plain_resample(docs, target)
    assert got == want
    assert sum(w[3] is not None for w in want.values()) > 30


def test_resampling_does_not_depend_on_parts_or_partitions(spark, monkeypatch):
    long = " ".join(f"Wort{i % 700}, x{i % 13}-é" for i in range(20_000))
    rows = [(i, f"{long[i * 10:i * 10 + 5000]}") for i in range(30)] + [(100, long), (101, None), (102, ""), (103, "one two")]
    target = spark.createDataFrame([("wort1 x1 é wort2",), (None,), ("zwei",)], "text string")
    want = plain_resample(rows, [r.text for r in target.collect()])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 7):
        got = importance.resampled(docs.repartition(n), target).collect()
        assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == want
    # the same from parts that cut the text at every few words
    for part, block in ((1 << 20, 16_000), (300, 40), (1, 3)):
        monkeypatch.setattr(importance, "PART", part)
        monkeypatch.setattr(importance, "BLOCK", block)
        total, n_words = np.zeros(997, int), 0
        for words in importance.word_sets([long[:40_000].encode(), b"", b"a b"], 3):
            n_words += int(words.own.sum())
            for table, _ in words.tables(3, 997):
                total += table.bucket_counts(997)
        plain = [plain_grams(long[:40_000]), plain_grams("a b")]
        assert n_words == sum(p[0] for p in plain)
        assert total.tolist() == np.bincount([zlib.crc32(x) % 997 for _, g in plain for x in g], minlength=997).tolist()


def test_hashes_equal_the_libraries():
    rnd = random.Random(12)
    data = rnd.randbytes(3000) + bytes(9)
    lo = np.array([rnd.randrange(2900) for _ in range(5000)])
    size = np.array([rnd.randrange(100) for _ in lo])
    cut = [data[a:a + n] for a, n in zip(lo, size)]
    assert importance.xxhash64(data, lo, size).tolist() == [xxhash.xxh64_intdigest(x) for x in cut]
    assert importance.crc32(data, lo, size).tolist() == [zlib.crc32(x) for x in cut]


def test_table_tells_equal_keys_apart(monkeypatch):
    """With a hash that gives one key to all, the bytes alone decide."""
    monkeypatch.setattr(importance, "xxhash64", lambda data, lo, size: np.full(len(lo), 5, np.uint64))
    words = importance.Words([(0, b"a b a c abcdefghi abcdefghj a b", [])])
    (table, doc), = words.tables(2, 10_000)
    seen = sorted(table.count[table.count > 0].tolist())
    grams = [x for k in (1, 2) for x in plain_grams("a b a c abcdefghi abcdefghj a b")[1] if x.count(b" ") == k - 1]
    assert seen == sorted(np.unique(grams, return_counts=True)[1].tolist()) and len(doc) == len(grams)


def test_resampling_edges(spark):
    target = spark.createDataFrame([("same text",)], "text string")
    rows = importance.resampled(odd_documents(spark).drop("score"), target, percent=100, least_words=1).collect()
    assert len(rows) == 10
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, sum(r.n_words > 0 for r in rows) + 1))
    assert all(r.weight == 0 and r.rank is None for r in rows if not r.n_words)
    assert importance.resampled(nothing(spark).drop("score"), target).count() == 0
    bare = importance.resampled(odd_documents(spark).drop("score"), target.limit(0)).collect()
    assert len(bare) == 10


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "gumbel", lambda seed, d: 0)
    found = importance.weighed(spark.createDataFrame([(d, "x y") for d in (9, 3, None, 5)], "doc_id long, text string"), np.zeros(10, np.int64))
    assert found.count() == 4
    rows = importance.resampled(spark.createDataFrame([(d, "x y") for d in range(40, 0, -1)], "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=50, least_words=1).collect()
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in rows if r.rank)
    assert len(drawn) == 20 and [(s, d) for _, s, d in drawn] == sorted((-r.score, r.doc_id) for r in rows)[:20]


# 13 -----------------------------------------------------------------------------------------------------------------
def strange_texts():
    rnd = random.Random(13)
    signs = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    out = ["".join(rnd.choices(signs[:0x250], k=60)) for _ in range(1500)] + ["".join(rnd.choices(signs, k=60)) for _ in range(1500)]
    out += ["".join(rnd.choices("ab'stΣσ1 ́e\n<|>", k=rnd.randrange(60))) for _ in range(1500)]
    out += [" ".join(signs[i:i + 200]) for i in range(0, 0x3000, 200)]
    out += ["<|endoftext|>", "a<|endoftext|>b<|startoftext|><|endoftext|", "", " ", "a" * 3001, "ab" * 2000 + " x", "é" * 1500]
    return [*out, "".join(rnd.choices("etaoinshr", k=30_000))]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_merging_equals_the_library(path):
    codec, library = merge_rounds.Codec(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = strange_texts()
    want = library.encode_batch(texts, add_special_tokens=False)
    for ordered in (True, False):
        codec.forget()
        codec.merges.ordered = ordered
        some = texts if ordered else [t for t in texts if len(t) < 3000]
        ids, counts = codec.encode(some)
        ends = np.r_[0, np.cumsum(counts)]
        got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert got == [w.ids for w, t in zip(want, texts) if ordered or len(t) < 3000]
    assert [codec.decode(w.ids) for w in want] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_long_words_take_the_queue(monkeypatch):
    codec = merge_rounds.Codec(open(WORDS, "rb").read())
    words = [t for t in strange_texts() if len(t) < 500]
    want = codec.encode(words)[0].tolist()
    monkeypatch.setattr(merge_rounds, "LONG", 2)
    monkeypatch.setattr(merge_rounds, "BLOCK", 50)
    monkeypatch.setattr(merge_rounds, "CACHED", 20)
    codec.forget()
    assert codec.encode(words)[0].tolist() == want


def test_codes_equal_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_merge_rounds"](spark, LARGER).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_codes_edges(spark):
    coded = merge_rounds.encoded(odd_documents(spark), WORDS, decode=True)
    rows = coded.collect()
    assert len(rows) == 10 and all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (None, 1, 2, 3))
    again = merge_rounds.decoded(coded, WORDS).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in rows)
    assert merge_rounds.digests(merge_rounds.encoded(nothing(spark), WORDS, decode=True)).count() == 0
    assert merge_rounds.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), WORDS).first().decoded == ""


def test_other_models_are_refused():
    spec = open(WORDS).read()
    with pytest.raises(ValueError):
        merge_rounds.Codec(spec.replace('"dropout":null', '"dropout":0.1').replace('"dropout": null', '"dropout": 0.1').encode())
