"""Null, shared and repeated ids, names that clash, and no switches or caps by size."""
import numpy as np
import pytest
from test_operators import SF, check_mix, plain_targets

import corpus_pipeline as pipeline
from gridcast.llm import langmask, mixing, urlfilter, zstd_quality


def words(n, salt):
    return " ".join(f"w{salt}-{i}" for i in range(n))


def mixed(spark, rows):
    """Rows of the mix with their sources, and the words of the mixed documents by source."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    numbered = mixing.numbered(docs)
    out = mixing.mix_sources(numbered, rows=True).join(numbered.select("row", "source"), "row").collect()
    taken = {}
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    return out, taken


@pytest.mark.parametrize("ids", ["shared", "a third null"])
def test_mix_meets_targets_whatever_the_ids(spark, ids):
    of = {"null": lambda i: None, "shared": lambda i: 7, "a third null": lambda i: None if i % 3 == 0 else i, "own": lambda i: i}[ids]
    rows = [(of(i), words(10 + (i * 7) % 11, i), ("a", "b", None)[i % 3] if ids == "a third null" else "a") for i in range(600)]
    out, taken = mixed(spark, rows)
    check_mix([(r, r.source) for r in out])
    target = plain_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for *_, x in rows}})
    assert taken.keys() == target.keys() and all(abs(taken[s] - target[s]) <= 20 for s in target)


def test_mix_of_one_row_repeated(spark):
    out, taken = mixed(spark, [(None, words(15, 0), "a")] * 1000)
    assert sorted({r.copies for r in out}) == [1, 2]
    assert abs(taken["a"] - 22_500) <= 15 and taken["a"] == sum(r.taken for r in out)


def test_mix_does_not_depend_on_partitions(spark):
    rows = [(i % 50 or None, words(5 + i % 9, i % 200), "ab"[i % 2]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = [sorted((str(r.doc_id), r["size"], r.copies) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (1, 6)]
    assert seen[0] == seen[1]


def test_rates_equal_a_plain_solution(spark):
    """exp(lambda * size), held at 2, with lambda found by bisection."""
    rows = [(i, words(1 + (i * i) % 37, i), ("a", "b", "c")[i % 3]) for i in range(300)]
    out, _ = mixed(spark, rows)
    for source in "abc":
        own = [r for r in out if r.source == source]
        size, target = np.array([r["size"] for r in own], float), own[0].target
        if target >= 2 * size.sum():
            assert all(r.copies == 2 for r in own)
            continue
        low, high = -10.0, 10.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (low, lam) if (np.minimum(2, np.exp(lam * size)) * size).sum() > target else (lam, high)
        assert [r.rate for r in own] == pytest.approx(np.minimum(2, np.exp(low * size)).tolist(), rel=1e-6)
        assert all(np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1 for r in own)


ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, _copy long, _copies long, _kept long, found long, text_hash long, pid long, uid long, v long, copies long, n_words long, size long"


def odd_rows(n):
    return [(i if i % 3 else None, words(30, i), "en", "a", 200, *[777 + k for k in range(12)]) for i in range(n)]


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES[:-1]])
def test_stages_return_clashing_columns_unchanged(spark, name):
    docs = spark.createDataFrame(odd_rows(30), ODD)
    out = dict(pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {tuple(r)[5:] for r in out.collect()} == {tuple(777 + k for k in range(12))}


def test_stages_take_an_empty_table_and_a_very_long_text(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet")
    long = words(60_000, 1) + " " + words(60_000, 1)
    cases = [columns.limit(0), spark.createDataFrame([(1, long, "en", "a", len(long)), (None, words(40, 2), None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")]
    for docs in cases:
        n = docs.count()
        for _, stage in pipeline.STAGES[1:]:
            docs = pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.count() == 0 if n == 0 else docs.where("doc_id = 1").count() > 0


def test_languages_are_learned_at_every_size(spark):
    """One document of a language is learned among 49 rows and among 61."""
    for n in (48, 60):
        rows = [(i, f"the cat number {i} sat on the mat and looked around", "en") for i in range(n)] + [(1000, "žluťoučký kůň úpěl ďábelské ódy", "cs")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        found = {r.doc_id: (r.lang_pred, r.score) for r in langmask.identify(docs, langmask.fit(docs)).collect()}
        assert found[1000] == ("cs", 1.0) and found[3][0] == "en"


def test_more_languages_than_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 10 + k, " ".join(f"{letters[i % 26]}{letters[i // 26]}{letters[(i + 7) % 26]}{c}" for c in "aeiou"), f"l{i:02d}") for i in range(70) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langmask.fit(docs)
    assert model.masks.shape[0] == 2
    assert {r.doc_id: r.lang_pred for r in langmask.identify(docs, model).collect()} == {d: lang for d, _, lang in rows}


def test_null_ids_do_not_decide_what_is_learned(spark):
    rows = [(None, f"text {i} mit Wort{i}", "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = langmask.fit(docs, per_language=100)
    assert one.langs == ["de"] and one.masks.any()


def test_the_quality_fit_reads_whole_texts(spark):
    """What tells the classes apart comes late in long texts."""
    filler = " ".join(f"filler{i % 97}" for i in range(5000))
    rows = [(i, filler + (" good news from the village" if i % 2 else " zqx9 zqx8 zqx7 buy") * 300, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    model = zstd_quality.fit(docs, labels)
    assert {r.doc_id: r.predicted for r in zstd_quality.score(docs, model, threshold=0.5).collect()} == {d: y for d, _, y in rows}


def test_two_thousand_rules(spark):
    rules = [("block" if i % 2 else "allow", f"host{i}.example.org", f"/p{i % 7}/") for i in range(2000)] + [("block", "deep.example.com", f"/{k}/x{k}") for k in range(300)]
    urls = [f"http://sub.host{i}.example.org/p{i % 7}/{i}" for i in range(0, 2000, 37)] + ["http://deep.example.com/7/x7/y", "http://deep.example.com/7/x", "http://other.example.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}

    def plain(url):
        host, path = url[7:].partition("/")[0], "/" + url[7:].partition("/")[2]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=None)

    for i, url in enumerate(urls):
        want = plain(url)
        assert got[i][0] == (want[1] if want else None)
        assert want is None or got[i][1] == want[2]
