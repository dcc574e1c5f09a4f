import random

import brute
import pytest

from gridcast.llm import recompression
from gridcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def digests(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert digests(QUERIES["op5_recompression"](spark, SF)) == want
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("words,length", [(1, 50), (2, 60), (5, 120), (40, 300)])
def test_runs_and_small_vocabularies(spark, words, length):
    rnd = random.Random(words)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:words]) for _ in range(rnd.randint(0, length))] for _ in range(60)]
    rows = []
    for i in range(150):
        a, b = rnd.choice(base), rnd.choice(base)
        at, off = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        rows.append((i, " ".join(a[:at] + b[off:off + 45] + [rnd.choice("xyz")] * rnd.randint(0, 30) + a[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(recompression.remove_repeats(df, digest=True)) == brute.repeats(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, 1), (1, None, 2), (2, "", 3), (3, " \t ", 4), (4, f"x\n{long}  tail", 5), (4, f"x\n{long}  tail", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = {(r.doc_id, r.text, r.pos, r.n_removed) for r in recompression.remove_repeats(df).collect()}
    assert got == {(None, long, 1, 0), (1, None, 2, 0), (2, "", 3, 0), (3, " \t ", 4, 0), (4, "x tail", 5, 60)}
    assert recompression.remove_repeats(df.where("1 = 0"), digest=True).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    """Rows with a null or an equal doc_id and other texts: each loses its own repeats only."""
    rnd = random.Random(3)
    fresh = lambda n: [f"u{rnd.getrandbits(40)}" for _ in range(n)]
    shared = fresh(30)
    rows = [(None, fresh(5) + shared + fresh(140)), (None, fresh(100) + shared + fresh(20)), (7, fresh(60) + shared), (7, shared + fresh(90)), (9, fresh(50)), (9, fresh(20) + shared)]
    rows += [(d, t) for d in (None, 7) for t in [fresh(25) + rnd.choice(rows)[1][3:40] + fresh(40) for _ in range(20)]]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(3)
    order = sorted(recompression.with_hash(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_hash))
    want = brute.repeats([(i, r.text) for i, r in enumerate(order)])
    plain = lambda rows: sorted(rows, key=str)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(df, digest=True).collect()]
    assert plain(got) == plain((order[i].doc_id, *w) for i, w in want.items())
