"""Near-duplicate documents by circulant MinHash.

Two permutations serve for a whole signature: the first, a hash, places a shingle on a circle of ``D`` places; the
second is a table on that circle, and coordinate k reads it k places further. A signature is therefore the minimum
of one table slice per shingle. Six coordinates make a band; documents that share a band are candidates.

Equal shingle sets form a class first. Inside a band's bucket every class is paired with the bucket's first one
only, and these pairs are verified on full sets. Buckets whose members are then not all connected are finished
in blocks: members outside the bucket's largest component against all members of other components. So each pair
of a bucket is either connected or was compared, though no bucket is expanded into all pairs.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import U64, WordHashes, documents_of, fan_out, hashed, pair, pieces, spans, stored
from gridcast.llm.components import components
from gridcast.llm.packed import gathered

LEAST_ID = -(1 << 63)  # stands for a null doc_id
PLACES = 1 << 22
BANDS, ROWS = 42, 6  # at similarity 0.8 a pair shares no band with probability 3e-6
COORDINATES = BANDS * ROWS
BLOCK = 256
SURE = 0.14  # more than five standard deviations of a signature's estimate


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """Row i: the COORDINATES table entries from place i on."""
    table = np.random.default_rng(20).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.r_[table, table[:COORDINATES]], COORDINATES)


def shingles(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row, A-Z lower-cased; of the whole text if it has fewer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, U64)
    h = hashed(words, cache)
    return np.unique(spans(h, min(size, len(h)), 31 + min(size, len(h))))


def signature(found: np.ndarray) -> np.ndarray:
    circle, out = _circle(), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    places = (found % U64(PLACES)).astype(np.int64)
    for i in range(0, len(places), 1024):
        np.minimum(out, circle[places[i:i + 1024]].min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, n_shingles, hi, lo, sig, bands) per row: set size, 128 bits of the set, a byte per coordinate of
    the signature, a key per band (empty for an empty set)."""

    def rows(batches):
        cache = WordHashes()
        for batch in batches:
            for lo, hi in pieces(batch):
                n, top, low, sigs = [], [], [], []
                for text in batch.column("text")[lo:hi].to_pylist():
                    found = shingles(text, size, cache)
                    h = xxhash.xxh3_128_intdigest(found.tobytes())
                    n.append(len(found))
                    top.append(h >> 64)
                    low.append(h & (1 << 64) - 1)
                    sigs.append(signature(found))
                sig = np.stack(sigs)
                keys = np.zeros((len(n), BANDS), U64)
                for r in range(ROWS):
                    keys = pair(keys, sig[:, r::ROWS].astype(U64), 500 + r)
                keys = pair(keys, np.arange(BANDS, dtype=U64)[None, :], 600).view(np.int64)
                bands = pa.array([k if c else k[:0] for k, c in zip(keys, n)], pa.list_(pa.int64()))
                small = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[lo:hi], batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(np.array(top, U64).view(np.int64)), pa.array(np.array(low, U64).view(np.int64)), pa.array([s.tobytes() for s in small], pa.binary()), bands],
                    names=["row", "doc_id", "n_shingles", "hi", "lo", "sig", "bands"],
                )

    return docs.mapInArrow(rows, "row bigint, doc_id bigint, n_shingles bigint, hi bigint, lo bigint, sig binary, bands array<bigint>")


def _bands(batches):
    for batch in batches:
        bands = batch.column("bands")
        ids = np.repeat(batch.column("row").to_numpy(), np.diff(bands.offsets.to_numpy()))
        yield bands.flatten().to_numpy().view(U64), None, ids, np.zeros(len(ids), np.uint32)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(v, found) for the rows named in ``wanted`` (column v)."""

    def rows(batches):
        cache = WordHashes()
        for batch in batches:
            for lo, hi in pieces(batch, limit=1 << 20):
                sets = [shingles(t, size, cache).tobytes() for t in batch.column("text")[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], pa.array(sets, pa.binary())], names=["v", "found"])

    # the same kind of join at every size
    return docs.join(wanted.hint("merge"), docs["row"] == wanted["v"], "left_semi").mapInArrow(rows, "v bigint, found binary")


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    side = lambda c: sets.select(F.col("v").alias(c), F.col("found").alias(f"{c}_set"))

    def check(batches):
        for batch in batches:
            keep = [linked(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("a_set"), batch.column("b_set"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a bigint, b bigint")


def leftover_links(edges: DataFrame, comps: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket but not a link to the bucket's first member."""
    label = lambda df, c: df.join(comps.select(F.col("v").alias(c), F.col("comp").alias(f"{c}_c")), c, "left").withColumn(f"{c}_c", F.coalesce(f"{c}_c", c))
    seen = label(label(edges, "a"), "b")
    seen = stored(seen, "seen")
    mixed = seen.groupBy("key").agg(F.min(F.least("a_c", "b_c")).alias("_lo"), F.max(F.greatest("a_c", "b_c")).alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo <> _hi AND _n > 1")
    some = seen.join(mixed.select("key"), "key", "left_semi")
    rows = stored(some.select("key", F.col("a").alias("v"), F.col("a_c").alias("comp")).union(some.select("key", "b", "b_c")).distinct(), "mixed")
    most = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_most"))
    askers = rows.join(most, "key").where("comp <> _most").select("v").distinct().withColumn("asks", F.lit(True))
    # components that meet in a bucket form a region; its members are cut into blocks
    region = components(seen.where("a_c <> b_c").select(F.col("a_c").alias("a"), F.col("b_c").alias("b")))
    members = rows.select("v", "comp").distinct().join(askers, "v", "left")
    members = members.join(region.select(F.col("v").alias("comp"), F.col("comp").alias("region")), "comp")
    sizes = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_mb"), F.ceil(F.count("asks") / BLOCK).cast("int").alias("_sb")).where("_sb > 0")
    members = stored(
        members.join(sizes, "region").join(sets, "v").join(sketched.select(F.col("row").alias("v"), "sig"), "v"), "members"
    )
    part = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = members.select("v", "comp", "region", "sig", "found", "_mb", "_sb", "asks")
    left = base.select("region", part("_mb", 1).alias("mb"), all_of("_sb").alias("sb"), "v", "comp", "sig", "found")
    right = base.where("asks").select("region", all_of("_mb").alias("mb"), part("_sb", 2).alias("sb"), "v", "comp", "sig", "found")
    least = percent / 100 - SURE

    def compare(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            sig = np.stack([np.frombuffer(s, np.uint8) for s in block["sig"]])
            comp, ids, found = block["comp"].to_numpy(), block["v"].to_numpy(), list(block["found"])
            for v, c, s, mine in zip(asked["v"], asked["comp"], asked["sig"], asked["found"]):
                alike = (sig == np.frombuffer(s, np.uint8)).mean(axis=1)
                done = set()
                for i in np.flatnonzero((alike >= least) & (comp != c)):
                    if comp[i] not in done and linked(mine, found[i], percent):
                        done.add(comp[i])
                        out.append((c, comp[i]))
        return pd.DataFrame(out, columns=["a", "b"]).drop_duplicates().astype("int64")

    on = ["region", "mb", "sb"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, "a bigint, b bigint")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row (``row``), written down: a later read finds the same."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text): documents whose sets of
    ``size``-word shingles have 100 * common >= percent * united are linked, and a component is what links reach. It
    is named by its smallest doc_id; one row with that doc_id is kept.

    No words or no text: an empty set, linked with nothing. A null doc_id counts as the smallest and stays null.
    Rows are told apart by number: of repeated rows, with or without a doc_id, one is kept, and rows with one doc_id
    and other texts are judged by their own texts. With ``rows``, ``docs`` is ``numbered`` and the result has ``row``.
    """
    base = documents_of(docs, *["row"] * rows).withColumn("doc_id", F.coalesce("doc_id", F.lit(LEAST_ID)))
    n = fan_out(base)
    base = base if rows else numbered(base)
    sketched = stored(sketches(base, size), "sketches")
    # a class of equal sets goes by the number of its first row
    heads = sketched.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row")).alias("_head"))
    heads = stored(heads.select("hi", "lo", F.col("_head.doc_id").alias("rep"), F.col("_head.row").alias("v")), "heads")
    classes = sketched.select("row", "doc_id", "n_shingles", "hi", "lo").join(heads, ["hi", "lo"], "left")
    classes = stored(classes.select("row", "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("v", -1 - F.col("row")).alias("v")), "classes")
    own = sketched.join(heads.select("v"), sketched["row"] == F.col("v"), "left_semi")
    edges = stored(gathered(own, _bands, "edges", n), "edges")
    pairs = stored(edges.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    sets = stored(shingle_sets(base, ends, size), "sets")
    links = stored(verified(pairs, sets, percent), "verified")
    comps = components(links)
    more = stored(leftover_links(edges, comps, sets, sketched, percent), "more")
    if not more.isEmpty():
        over = components(more)
        over = over.select(F.col("v").alias("comp"), F.col("comp").alias("_c"))
        known = comps.join(over, "comp", "left").select("v", F.coalesce("_c", "comp").alias("comp"))
        # a class that had no link of its own so far
        lone = over.join(comps.select(F.col("v").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("v"), F.col("_c").alias("comp"))
        comps = stored(known.union(lone), "components")
    linked_heads = comps.join(heads, "v")
    first = linked_heads.groupBy("comp").agg(F.min(F.struct("rep", "hi", "lo", "v")).alias("_first"))
    names = comps.join(first, "comp").select("v", F.col("_first.rep").alias("_name"), F.col("_first.v").alias("_keeper"))
    out = classes.join(names, "v", "left").withColumn("component_id", F.coalesce("_name", "rep"))
    null = lambda c: F.when(F.col(c) != LEAST_ID, F.col(c)).alias(c)
    kept = (F.col("v") < 0) | (F.col("row") == F.coalesce("_keeper", "v"))
    return out.select(*["row"] * rows, null("doc_id"), "n_shingles", null("component_id"), kept.alias("kept"))
