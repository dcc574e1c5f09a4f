"""Each operator against a plain version, and its edge cases."""
import base64
import hashlib
import io
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from gridcast.llm import bitsliced, chunked_bpe, circulant, edit_embed, langmask, mixing, urlfilter, wavelet, zstd_quality
from gridcast.llm.components import components
from gridcast.llm.queries import QUERIES, SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, size string, score string, rep int, _id int"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns named like the operators' own."""
    long = " ".join(f"word{i % 5000} x" for i in range(30_000))
    rows = [
        (None, None, None, None, None, None, None, None), (1, None, "en", "a", "s", "s", 1, 1), (2, "", "en", None, "s", "s", 1, 1),
        (3, " \t\n", None, "b", "s", "s", 1, 1), (4, "Same text here twice.", "en", "a", "s", "s", 1, 1), (5, "same TEXT here twice.", "en", "b", "s", "s", 1, 1),
        (5, "same TEXT here twice.", "en", "b", "s", "s", 1, 1), (6, long, "en", "a", "s", "s", 1, 1), (7, "123 --- 456", "de", "c", "s", "s", 1, 1),
        (8, "één ñandú 漢字 😀", "es", "c", "s", "s", 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 1 ------------------------------------------------------------------------------------------------------------------
def plain_targets(sizes):
    """source -> target, by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap, target, left, free = {s: 2 * sizes[s] for s in order}, dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=order.index):
            target[s] += share * weight[s]
            if target[s] >= cap[s]:
                left += target[s] - cap[s]
                target[s] = float(cap[s])
        free = {s for s in free if target[s] < cap[s]}
    return target


def check_mix(rows):
    sizes, taken, largest = {}, {}, {}
    for r, source in rows:
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
        assert 0 <= r.taken <= 2 * r.size
    target = plain_targets(sizes)
    for r, source in rows:
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_meets_targets(spark):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_entropy_mix"](spark, SF).collect()
    check_mix([(r, source[r.doc_id]) for r in rows])
    again = QUERIES["op1_entropy_mix"](spark, SF).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_mix_is_entropy_balanced(spark):
    """Rates below the limit are exp(lambda * size) per source: their logarithms are proportional to sizes."""
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in QUERIES["op1_entropy_mix"](spark, SF).collect():
        if r["size"] and 0 < r.rate < 2:
            by.setdefault(source[r.doc_id], []).append(np.log(r.rate) / r["size"])
    assert len(by) > 3
    for slopes in by.values():
        assert np.ptp(slopes) <= 1e-9


def test_mix_edges(spark):
    rows = mixing.mix_sources(odd_documents(spark).drop("size")).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(nothing(spark).drop("size")).count() == 0
    assert mixing.mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns


# 2 ------------------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES["op2_zstd_quality"](spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    seen = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert len(seen) > 50 and np.mean([p == q for p, q in seen]) > 0.9


def test_quality_edges(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (99, 0), (8, None)], "doc_id long, quality int")
    model = zstd_quality.fit(docs, labels)
    assert zstd_quality.score(docs, model).count() == 10
    assert set(zstd_quality.score(docs, model, keep=True).columns) == set(docs.columns)
    one = zstd_quality.fit(docs, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in zstd_quality.score(docs, one).collect()} == {round(2 / 3, 6)}
    assert zstd_quality.score(nothing(spark), one).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------
def digests(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in docs.collect()])
    assert digests(QUERIES["op3_circulant_minhash"](spark, LARGER)) == want
    assert sum(not w[2] for w in want.values()) > 50


def test_near_duplicates_in_chains(spark):
    """Neighbours in a chain are similar, its ends are not; many texts share one bucket."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words[rnd.randrange(60)] = f"v{i}"
    rnd.shuffle(rows)
    assert digests(circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute.near(rows)


def test_leftover_links_are_found(spark):
    """Copies of a base with many different edits: most pairs fall below the similarity, those with the base do not."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(200), rnd.randint(6, 13)):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    assert digests(circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute.near(rows)


def test_near_edges(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in circulant.near_duplicates(odd_documents(spark), 2).collect()}
    assert {(4, 3, 4, True), (5, 3, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)} <= rows
    assert (None, 0, None, True) in rows
    assert circulant.near_duplicates(nothing(spark), 2).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7), (5, 3), (5, 3)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 90, 90: 90, 95: 90}


# 4 ------------------------------------------------------------------------------------------------------------------
def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(WORDS), 0, {}
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_wavelet_tokens"](spark, SF).collect()}
    assert got == want


def test_token_file_edges(spark):
    rows = wavelet.read_documents(wavelet.write_tokens(odd_documents(spark), WORDS)).orderBy("start").collect()
    assert len(rows) == 10 and rows[0].doc_id is None and rows[0].n_tokens == 1
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert wavelet.read_documents(wavelet.write_tokens(nothing(spark), WORDS)).count() == 0


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    spec = open(WORDS, "rb").read()
    library, own, rnd = Tokenizer.from_str(spec.decode()), wavelet.Words(spec), random.Random(1)
    letters = "abcDEFxyz  \n\t'sStTmMdl.,!?#&$%*0123ÀÉßöÿŸ×÷µªº²½ἈİſḰ \u0085 漢字😀َا\x1c\x1f\x0b\x0c<|>"
    for i in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) + ("<|endoftext|>" if i % 7 == 0 else "")
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 5), (700, 1), (5000, 70), (9000, 3000)])
def test_wavelet_matrix(n, kinds):
    x = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32) * 3
    m = wavelet.WaveletMatrix(wavelet.to_bytes(x, np.arange(1), np.array([n])))
    assert (m.tokens() == x).all() and m.count(1) == 0
    for i in range(0, n, max(1, n // 25)):
        at = np.flatnonzero(x == x[i])
        assert m.access(i) == x[i] and m.count(int(x[i]), 0, i) == (at < i).sum()
        assert m.occurrence(int(x[i]), len(at) // 2) == at[len(at) // 2]


class Counted(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def test_token_file_reads_what_it_needs():
    """400,000 ids: a look-up takes a block or two of each plane, from a file that is never read whole."""
    x = np.random.default_rng(3).zipf(1.2, 400_000).clip(max=40_000).astype(np.uint32)
    data = wavelet.to_bytes(x, np.arange(4), np.full(4, 100_000))
    for look in (lambda m: m.access(300_001) == x[300_001], lambda m: m.count(7) == (x == 7).sum(), lambda m: m.occurrence(9, 50) == np.flatnonzero(x == 9)[50]):
        file = Counted(data)
        assert look(wavelet.WaveletMatrix(file)) and file.taken < len(data) / 2
    m = wavelet.WaveletMatrix(data)
    assert (m.tokens() == x).all()
    for i in (0, 65_535, 65_536, 131_071, 131_072, 399_999):
        at = np.flatnonzero(x == x[i])
        k = int((at < i).sum())
        assert m.access(i) == x[i] and m.count(int(x[i]), 0, i) == k and m.occurrence(int(x[i]), k) == i
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"WMTX1\nrest")


def test_token_placement(spark):
    """A third of the ids null, one text a thousand times: spread over the tasks, ids as the library's, in order."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [(i if i % 3 else None, f"word{i % 50} and {'more ' * (i % 7)}" if i % 5 else "the same text") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        files = wavelet.write_tokens(df, WORDS)
        prints = edit_embed.with_edits(df)
        assert prints.count() == 3000 and prints.where("doc_id IS NULL").count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [r.n for r in files.groupBy("pid").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / len(sizes) and len(sizes) == 16
    got = wavelet.read_documents(files).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(t)) for i, t in rows)


@pytest.mark.parametrize("texts", ["table", "characters"])
def test_words_equal_the_library(texts):
    """All documents of the larger test table; all characters below U+0250, alone and inside words."""
    from tokenizers import Tokenizer

    spec = open(WORDS, "rb").read()
    library, own = Tokenizer.from_str(spec.decode()), wavelet.Words(spec)
    if texts == "table":
        given = [t or "" for t in pq.read_table(f"{LARGER}/documents.parquet", columns=["text"])["text"].to_pylist()]
    else:
        given = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("", ""), ("a", "b"), ("1", "2"), ("é", "T's"), (" ", " x"))]
    for t, e in zip(given, library.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == e.ids


# 6 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("sf", [SF, LARGER])
def test_top_k(spark, sf):
    assert compare(QUERIES["op6_bitsliced_topk"](spark, sf), connect(sf), SQL["op6_bitsliced_topk"]) == []


def test_top_k_ties_and_odd_rows(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.integers(-3, 4, 6).astype(float).tolist(), "x") for i in range(230)]
    rows += [(i, rows[3][1], None) for i in range(300, 320)] + [(350, [0.0] * 6, "z"), (400, [-2.5, 9.0], None)]
    bad = [(None, [1.0], ""), (500, None, ""), (550, [1.0, None], ""), (600, [float("nan")], ""), (650, [float("inf")], "")]
    vectors = {i: np.floor(256 * np.array(v + [0.0] * (6 - len(v)))).astype(int) for i, v, _ in rows}
    want = set()
    for q in [i for i in vectors if i % 50 == 0]:
        scored = sorted(((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string").repartition(3)
    assert {tuple(r) for r in bitsliced.top_k(df).collect()} == want
    assert bitsliced.top_k(df.where("1 = 0")).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, reference_encoding):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = reference_encoding.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_chunked_bpe"](spark, LARGER).collect()}
    assert got == want


def test_stitching(reference_encoding):
    codec, rnd = chunked_bpe.codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN), random.Random(5)
    for i in range(300):
        alphabet = ["ab ", "  \n\n x'll don't 12 ..! é漢 \t", "a", " ", "\n", "a1 "][i % 6]
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 400)))
        size, over = rnd.choice([(20, 6), (50, 20), (64, 1)])
        parts = [(t, *chunked_bpe.cut_marks(codec, t, size)) for t in chunked_bpe.chunks_of(text, size, over)]
        pieces = chunked_bpe.stitch(codec, parts, size)
        assert "".join(pieces) == text
        assert [x for p in pieces for x in codec.encode(p)] == reference_encoding.encode_ordinary(text)


def test_bpe_edges(spark, reference_encoding):
    docs = odd_documents(spark)
    got = chunked_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    rows = sorted((str(r.doc_id), r.ids) for r in got.collect())
    assert rows == sorted((str(r.doc_id), reference_encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    back = sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in chunked_bpe.decoded(got, RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert chunked_bpe.encoded(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------
def test_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = QUERIES["op8_language_masks"](spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    seen = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(seen) > 0.98


def test_language_edges(spark):
    docs = odd_documents(spark)
    model = langmask.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langmask.identify(docs, model).collect()}
    assert {(None, "und"), (1, "und"), (2, "und"), (3, "und"), (7, "und"), (4, "en"), (8, "es")} <= got
    assert {r.lang_pred for r in langmask.identify(docs, langmask.fit(nothing(spark))).collect()} == {"und"}
    assert langmask.identify(nothing(spark), model).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:].split("?")[0].split("#")[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/EN/x", "https://www.example.com/en/1?a#b", "http://example.com", "http://a.net/fr/#x", "x://y?z/://q", "http://netx/es/", "http://É.net/es/", "https://notexample.com/en/"]
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url")
    every = pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    urls = {r.page_id: r.url for r in every.collect()}
    rows = urlfilter.judge(every.withColumn("risk", every["url"]).withColumn("host", every["url"]), RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == plain_url(urls[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.risk >= 0.5 else "allow"))
    assert urlfilter.judge(pages.where("1 = 0"), RULES).count() == 0


def test_url_model():
    w, bias = urlfilter.fit(urlfilter.LABELLED)

    def blocked(url):
        g, s = urlfilter.vector(*plain_url(url))
        return bias + w[g].sum() * s > 0

    assert np.mean([blocked(u) == bool(y) for u, y in urlfilter.LABELLED]) == 1
    assert blocked("https://mega-casino.example.org/en/19") and not blocked("https://www.thereon.example.org/en/1920")


# 10 -----------------------------------------------------------------------------------------------------------------
def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op10_edit_embedding"](spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for d, following in zip(ids, ids[1:] + ids[:1]):
        text, n = texts[d] or "", len(texts[d] or "") // 4
        edited = text[:len(text) - n] + (texts[following] or "")[:n]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, new = (edit_embed.fingerprints([x])[0] for x in (text, edited))
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), new.tobytes().hex())
        assert r.near_edited == edit_embed.likeness(own, new) and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next + 0.3 for r in rows.values()]) > 0.95


def test_walk_is_the_plain_walk():
    table, _ = edit_embed._moves()
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abc é漢😀") for _ in range(rnd.choice([0, 1, 5, 90, 300]))) for _ in range(130)]
    together = edit_embed.fingerprints(texts)
    for t, p in zip(texts, together):
        assert (edit_embed.fingerprints([t])[0] == p).all()
    # one step per coin: a text of one character stays until its coin says go
    cls = (np.uint32(ord("a")) * np.array([2654435761], np.uint32) >> np.uint32(26)).astype(int)[0]
    steps = edit_embed._steps(np.full(40, ord("a"), np.uint32), np.array([40]))
    now, plain = 0, []
    for _ in range(40):
        now += int(table[(cls << 16) | (now & 65535)])
        plain.append(now)
    assert steps.tolist() == plain


def test_fingerprint_edges(spark):
    rows = edit_embed.with_edits(odd_documents(spark)).collect()
    assert len(rows) == 10 and {r.n_chars for r in rows if r.doc_id in (None, 1, 2)} == {0}
    alone = edit_embed.with_edits(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert edit_embed.with_edits(nothing(spark)).count() == 0


def test_near_classes(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(2000)) for _ in range(30)]
    rows = []
    for i, t in enumerate(base):
        at = rnd.randrange(1980, 1999)
        rows += [(10 * i, t), (10 * i + 1, t), (10 * i + 2, t[:at] + "zz" + t[at:])]
    prints = edit_embed.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in edit_embed.with_classes(prints).collect()}
    assert all(got[10 * i] == got[10 * i + 1] == 10 * i for i in range(30))
    assert np.mean([got[10 * i + 2] == 10 * i for i in range(30)]) > 0.9


def plain_classes(prints):
    """{print: its smallest doc_id}: all pairs compared. prints: (doc_id, whole number of 256 bits)."""
    parent = {p: p for _, p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 12 and find(a) != find(b):
                parent[find(a)] = find(b)
    ids = {}
    for d, p in prints:
        ids.setdefault(find(p), set()).add(d)
    return {f"{p:064x}": min((d for d in ids[find(p)] if d is not None), default=None) for p in every}


def test_near_classes_equal_brute_force(spark):
    """A family of prints some 25 bits apart: many share a band's bucket, its first one is near to few of them."""
    rnd = random.Random(12)
    flip = lambda p, n: p ^ sum(1 << k for k in rnd.sample(range(256), n))
    base = rnd.getrandbits(256)
    family = [flip(base, 13) for _ in range(500)]
    family += [flip(rnd.choice(family), rnd.choice([11, 12, 12, 12, 13])) for _ in range(500)]
    prints = [*enumerate(family)] + [(None, flip(family[3], 12)), (5, flip(base, 60)), (None, flip(base, 90)), (7, family[9])]
    rnd.shuffle(prints)
    rows = spark.createDataFrame([(d, f"{p:064x}") for d, p in prints], "doc_id long, fingerprint string").repartition(4)
    want = plain_classes(prints)
    assert 100 < len(set(want.values())) < 900
    assert {r.fingerprint: r.class_id for r in edit_embed.near_classes(rows).collect()} == want


@pytest.mark.parametrize("least,far", [(0.9, 12), (0.97, 3), (0.8, 25)])
def test_bands_miss_no_pair_at_the_limit(least, far):
    blocks, pairs = edit_embed.bands_for(least)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(256)) and max(map(len, blocks)) <= 16
    rnd = np.random.default_rng(3)
    for _ in range(2000):
        # the hardest case: each differing bit in another block
        bad = set(rnd.choice(len(blocks), min(far, len(blocks)), replace=False).tolist())
        assert any(a not in bad and b not in bad for a, b in pairs)
