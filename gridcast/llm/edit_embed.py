"""Document fingerprints by a randomised edit embedding.

A walk reads a text from left to right. At every step it writes down the character it stands on; whether it moves on
is a coin shared by all walks, tossed per (step, character). Texts a few edits apart fall into step again soon after
each edit, so their walks differ in few steps: edit distance becomes Hamming distance. A fingerprint holds one bit of
the walk at each of ``BITS`` sampled steps. A sampled step is uniform over the walk, and for walks of nearly the same
length it is nearly always the same step, so that length alone does not pull fingerprints apart.

The likeness of two fingerprints is 1 when all bits agree and 0 when half of them do, as in unrelated texts. Near
texts are found by bands that no pair within the limit can miss (``bands_for``) and verified on all bits. Inside a
band's bucket every fingerprint is verified against the bucket's first one; buckets whose members are then not all
connected are finished in blocks: members outside the bucket's largest component against all members of others.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridcast.llm.common import U64, documents_of, fan_out, in_order, mix, pieces, stored
from gridcast.llm.components import components
from gridcast.llm.packed import gathered

BITS = 256
CLASSES = 64  # characters share coins by the hash of their code point
PERIOD = 1 << 16  # coins repeat after so many steps
BLOCK = 4096  # fingerprints of a bucket compared at once with as many others
TOGETHER = 48  # walks fewer than this go on one by one


@lru_cache(maxsize=1)
def _moves() -> tuple[np.ndarray, list[bytes]]:
    """For (character class, step): after how many steps the walk leaves the character."""
    coins = np.random.default_rng(10).integers(0, 2, (CLASSES, 2 * PERIOD)).astype(bool)
    coins[:, PERIOD:] = coins[:, :PERIOD]
    at = np.arange(2 * PERIOD)
    nxt = np.where(coins, at, 4 * PERIOD)
    nxt = np.minimum.accumulate(nxt[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    out = (nxt - at[:PERIOD] + 1).astype(np.uint8)
    return out.ravel(), [row.tobytes() for row in out]


@lru_cache(maxsize=1)
def _records() -> np.ndarray:
    """Per bit, ascending steps; the last below a walk's length is uniform over the walk."""
    rng = np.random.default_rng(11)
    out = np.full((BITS, 80), 1 << 62, np.int64)
    for row in out:
        t = 0
        for i in range(80):
            row[i] = t
            t = max(t + 1, int(np.ceil((t + 1) / max(rng.random(), 1e-12))))
            if t > 1 << 61:
                break
    return out


def _steps(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The step at which each character of the concatenated texts is left."""
    table, rows = _moves()
    cls = ((chars * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(len(chars), np.int64)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = starts[order], sizes[order]
    t = np.zeros(len(order), np.int64)
    active = int((longest > 0).sum())
    i = 0
    while active >= TOGETHER:
        until = int(longest[active - 1])
        b, now = begin[:active], t[:active]
        for i in range(i, until):
            at = b + i
            now += table[(cls[at] << 16) | (now & (PERIOD - 1))]
            out[at] = now
        i = until
        active = int((longest > i).sum())
    for k in range(active):
        now, lo, mine = int(t[k]), int(begin[k]) + i, []
        for c in cls[lo:int(begin[k] + longest[k])].tolist():
            now += rows[c][now & 65535]
            mine.append(now)
        out[lo:lo + len(mine)] = mine
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BITS / 8 bytes per text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = _steps(chars, sizes)
    records, k = _records(), np.arange(BITS)
    out = np.zeros((len(texts), BITS), bool)
    lo = 0
    for row, n in zip(out, sizes.tolist()):
        if n:
            own = steps[lo:lo + n]
            sampled = records[k, (records < own[-1]).sum(axis=1) - 1]
            on = chars[lo + np.searchsorted(own, sampled, side="right")]
            row[:] = (mix(sampled.astype(U64) * U64(0x9E3779B97F4A7C15) + on.astype(U64)) >> U64(63)).astype(bool)
        lo += n
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = BITS - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return np.maximum(0.0, 2.0 * same / BITS - 1.0)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint as hexadecimal digits) per row; a null text counts as empty."""

    def rows(batches):
        for batch in batches:
            for lo, hi in pieces(batch):
                texts = batch.column("text")[lo:hi].to_pylist()
                prints = [p.tobytes().hex() for p in fingerprints(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([len(t) for t in texts], pa.int64()), pa.array(prints)], names=["doc_id", "n_chars", "fingerprint"])

    base = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return base.mapInArrow(rows, "doc_id bigint, n_chars bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the following text, or all it has."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(ids: list, texts: list[str], prints: np.ndarray, next_texts: list[str], next_prints: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, next_texts)]
    new = fingerprints(changed)
    return [pa.array(v, t) for v, (_, t) in zip((
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], [p.tobytes().hex() for p in prints],
        [p.tobytes().hex() for p in new], likeness(prints, new), likeness(prints, next_prints),
    ), RESULT)]


def with_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text edited with the next row's beginning, and how near the fingerprint is
    to that and to the next row's. Rows are in ascending order of doc_id (null first; rows with one doc_id by the
    hash of their text); the first row follows the last. A null text counts as empty.

    Rows are range-partitioned in this order and sorted; many rows with one doc_id, or none, are spread as well. An
    empty table gives no row. A partition's last row waits for the first row of the next
    partition; only these rows, one or two for each partition, meet in a join.
    """
    base = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    placed = in_order(base, fan_out(base))
    names = [x for x, _ in RESULT]
    kinds = pa.schema([("kind", pa.string()), ("pid", pa.int32()), *RESULT, ("text", pa.string())])

    def walk(batches):
        last = None  # (id, text, print) of the row before
        pid = None
        for batch in batches:
            for lo, hi in pieces(batch):
                ids, texts = batch.column("doc_id")[lo:hi].to_pylist(), batch.column("text")[lo:hi].to_pylist()
                prints = fingerprints(texts)
                if pid is None:
                    pid = batch.column("pid")[0].as_py()
                    yield single("head", ids[0], texts[0], prints[0], pid)
                if last is not None:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], np.vstack([last[2][None], prints])
                last = ids[-1], texts[-1], prints[-1]
                if len(ids) > 1:
                    columns = _pairs(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                    m = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(["done"] * m), pa.array([pid] * m, pa.int32()), *columns, pa.nulls(m, pa.string())], schema=kinds)
        if last is not None:
            yield single("open", *last, pid)

    def single(kind, doc_id, text, own, pid):
        values = {"kind": kind, "pid": pid, "doc_id": doc_id, "fingerprint": own.tobytes().hex(), "text": text}
        return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in kinds}], schema=kinds)

    found = stored(placed.mapInArrow(walk, f"kind string, pid int, {DDL}, text string"), "walks")
    ends = found.where("kind = 'open'").select("pid", "doc_id", "text", "fingerprint")
    # partition numbers only: as many rows as partitions
    order = Window.orderBy("pid")
    follow = ends.select("pid", F.coalesce(F.lead("pid").over(order), F.first("pid").over(order)).alias("next_pid"))
    heads = found.where("kind = 'head'").select(F.col("pid").alias("next_pid"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    joined = ends.join(follow, "pid").join(heads, "next_pid").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def close(batches):
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in batch.schema.names}
            if c["doc_id"]:
                bits = lambda x: np.stack([np.frombuffer(bytes.fromhex(v), np.uint8) for v in c[x]])
                yield pa.RecordBatch.from_arrays(_pairs(c["doc_id"], c["text"], bits("fingerprint"), c["next_text"], bits("next_print")), names=names)

    return found.where("kind = 'done'").select(*names).unionByName(joined.mapInArrow(close, DDL))


def bands_for(least: float) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Blocks of bits, and the pairs of blocks that make a band each.

    If two fingerprints are as near as ``least``, at most ``far`` blocks differ and four agree at least. The blocks
    are in three groups, so two of the four are in one group, and every pair inside a group is a band: no such pair
    of fingerprints is missed. At 0.9 these are 35 bands of 32 bits.
    """
    far = max(d for d in range(BITS + 1) if 2.0 * (BITS - d) / BITS - 1.0 >= least)
    n = max(16, far + 4)
    if n > BITS:
        raise ValueError("unrelated fingerprints are that near, too")
    return np.array_split(np.arange(BITS), n), [x for group in np.array_split(np.arange(n), 3) for x in combinations(group.tolist(), 2)]


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints given as hexadecimal digits: a row of four 64-bit numbers each."""
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), U64).reshape(len(column), -1)


def linked(comp: np.ndarray, prints: np.ndarray, asked: np.ndarray, asked_prints: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between components that near fingerprints of the two lists give; none that follows from earlier ones."""
    names, at = np.unique(np.r_[comp, asked], return_inverse=True)
    at, own, out = at[:len(comp)], at[len(comp):], []
    for j, mine in enumerate(asked_prints):
        near = (at != own[j]) & (likeness(prints, mine) >= least)
        if near.any():
            met = np.unique(at[near])
            out += [(int(names[own[j]]), int(x)) for x in names[met]]
            at[np.isin(at, met)] = own[j]
            own[np.isin(own, met)] = own[j]
    return out


def leftover_links(edges: DataFrame, comps: DataFrame, groups: DataFrame, least: float, n: int) -> DataFrame:
    """Links (a, b) between components that share a bucket but no link to the bucket's first member."""
    label = lambda df, c: df.join(comps.select(F.col("v").alias(c), F.col("comp").alias(f"{c}_c")), c, "left").withColumn(f"{c}_c", F.coalesce(f"{c}_c", c))
    # a bucket's edges connect all its members; with one edge there is nothing left to compare
    apart = label(label(edges, "a"), "b").groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("a_c") != F.col("b_c")).alias("_apart")).where("_apart AND _n > 1")
    some = edges.join(apart.select("key"), "key", "left_semi")
    rows = some.select("key", F.col("a").alias("v")).union(some.select("key", "b")).distinct()
    rows = stored(label(rows, "v").withColumnRenamed("v_c", "comp"), "mixed")
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_most"), F.sum("_n").alias("_all"), F.max("_n").alias("_largest"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.select("key", "_most", blocks(F.col("_all")).alias("_mb"), blocks(F.col("_all") - F.col("_largest")).alias("_sb"))
    base = rows.join(sizes, "key").join(groups.select("v", "fingerprint"), "v")
    part = lambda c, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = base.select("key", part("_mb", 1).alias("mb"), all_of("_sb").alias("sb"), F.lit(False).alias("asks"), "comp", "fingerprint")
    right = base.where("comp <> _most").select("key", all_of("_mb").alias("mb"), part("_sb", 2).alias("sb"), F.lit(True).alias("asks"), "comp", "fingerprint")
    on = ["key", "mb", "sb"]

    def compare(batches):
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            key, mb, sb, asks, comp = (held.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            prints = _prints(held.column("fingerprint"))
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mb[1:] != mb[:-1]) | (sb[1:] != sb[:-1])])
            # the last block may go on in the next batch
            done = [*zip(cuts, np.r_[cuts[1:], len(key)])] if batch is None else [*zip(cuts[:-1], cuts[1:])]
            out = []
            for lo, hi in done:
                a = asks[lo:hi]
                out += linked(comp[lo:hi][~a], prints[lo:hi][~a], comp[lo:hi][a], prints[lo:hi][a], least)
            held = None if batch is None else held.slice(cuts[-1])
            if out:
                a, b = zip(*set(out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return left.union(right).repartition(n, *on).sortWithinPartitions(*on).mapInArrow(compare, "a bigint, b bigint").distinct()


def _and_end(batches):
    yield from batches
    yield None


def near_classes(prints: DataFrame, least: float = 0.9) -> DataFrame:
    """(fingerprint, class_id), a row per distinct fingerprint of (doc_id, fingerprint): all those whose likeness
    reaches ``least`` are linked, and a class is what links reach, named by its smallest doc_id (null if it has none).
    Fingerprints are told apart by themselves: one whose rows all have a null doc_id, or share it, links as any other."""
    n = fan_out(prints)
    groups = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).withColumn("v", F.monotonically_increasing_id()), "prints")
    blocks, pairs = bands_for(least)
    first, second = np.array(pairs).T

    def bands(batches):
        for batch in batches:
            ids = batch.column("v").to_numpy()
            if len(ids):
                bits = np.unpackbits(_prints(batch.column("fingerprint")).view(np.uint8), axis=1)
                part = np.stack([bits[:, b] @ (1 << np.arange(len(b))) for b in blocks], axis=1).astype(U64)
                key = (part[:, first] << U64(16) | part[:, second]) << U64(16) | np.arange(len(pairs), dtype=U64)
                yield mix(key.ravel()), None, np.repeat(ids, len(pairs)), np.zeros(key.size, np.uint32)

    edges = stored(gathered(groups, bands, "edges", n), "edges")
    side = lambda c: groups.select(F.col("v").alias(c), F.col("fingerprint").alias(f"{c}_print"))

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_prints(batch.column(x)) for x in ("a_print", "b_print"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(likeness(a, b) >= least))

    links = stored(edges.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a bigint, b bigint"), "verified")
    comps = components(links)
    more = stored(leftover_links(edges, comps, groups, least, n), "more")
    if not more.isEmpty():
        comps = components(links.union(more))
    found = groups.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    names = found.groupBy("comp").agg(F.min("rep").alias("class_id"))
    return found.join(names, "comp").select("fingerprint", "class_id")


def with_classes(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """``rows`` (doc_id, fingerprint, ...) plus the class_id of their fingerprint."""
    rows = stored(rows, "fingerprints")
    return rows.join(near_classes(rows, least), "fingerprint").select(*rows.columns, "class_id")
