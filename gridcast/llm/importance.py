"""Importance resampling towards a target distribution, over hashed word n-grams.

Per block of text an open-addressed table in NumPy interns the n-grams: the key is the xxhash64 of an n-gram's bytes, a
probe that meets its key compares the bytes as well, and each slot stores the n-gram's bucket and how often it occurs.
Counts add up by bucket over the corpus and over the target; in the second pass the slot ids of a document's
occurrences gather the gains of their buckets. Documents are drawn by the Gumbel top-k rule on exact integers.
"""
from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import U64, documents_of, pieces, stored
from gridcast.operators.ordered import ordinal_rank

LONGEST = 3  # words of an n-gram
BUCKETS = 10_000
BLOCK = 16_000  # words whose n-grams are interned in one table
PART = 1 << 20  # bytes of text in hand at once; a longer text is taken part by part
SLICE = 256  # buckets of a row of partial counts
SALTS = 64  # groups of tasks whose partial counts meet first
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
# A-Z become a-z; what is no word byte becomes a space
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _LOWER)
SPACE = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


class Words:
    """Words of parts of texts, in one buffer with a space between two of them: ``lo`` and ``hi`` are their places,
    ``doc`` the number of the text, ``own`` whether n-grams begin there (else a word only ends those of the words before
    it). A part is (number, bytes, the words that follow it)."""

    def __init__(self, parts: list[tuple[int, bytes, list[bytes]]]):
        flat, doc, own = [], [], []
        for number, part, tail in parts:
            found = part.translate(FOLD).split()
            flat += found
            flat += tail
            doc.append(np.full(len(found) + len(tail), number))
            own.append(np.arange(len(found) + len(tail)) < len(found))
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.own = np.concatenate(own) if own else np.zeros(0, bool)
        # eight more bytes, so that eight can be read from any place
        self.data = b" ".join(flat) + bytes(9)
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        self.hi = np.cumsum(size + 1) - 1
        self.lo = self.hi - size

    def tables(self, longest: int, buckets: int) -> Iterator[tuple[Table, np.ndarray]]:
        """For each block of words a table of the n-grams that begin in it, and the text of each occurrence."""
        n = len(self.lo)
        for a in range(0, n, BLOCK):
            first, last = [], []
            for k in range(longest):
                i = np.arange(a, max(a, min(a + BLOCK, n - k)))
                i = i[self.own[i] & (self.doc[i] == self.doc[i + k])]
                first.append(i)
                last.append(i + k)
            i, j = np.concatenate(first), np.concatenate(last)
            yield Table(self.data, self.lo[i], self.hi[j] - self.lo[i], buckets), self.doc[i]


def parts_of(number: int, text: bytes, longest: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    lo = 0
    while lo < len(text):
        cut = SPACE.search(text, lo + PART)
        at = hi = cut.end() if cut else len(text)
        tail: list[bytes] = []
        while len(tail) < longest - 1 and at < len(text):
            gap = SPACE.search(text, at)
            end = gap.end() if gap else len(text)
            tail += text[at:end].translate(FOLD).split()
            at = end
        yield number, text[lo:hi], tail
        lo = hi


def word_sets(texts: list[bytes], longest: int) -> Iterator[Words]:
    """The words of all texts, about ``PART`` bytes at a time."""
    held, total = [], 0
    for number, text in enumerate(texts):
        for part in parts_of(number, text, longest):
            if total + len(part[1]) > PART and held:
                yield Words(held)
                held, total = [], 0
            held.append(part)
            total += len(part[1])
    yield Words(held)


# fixed values: the primes of xxhash64
P1, P2, P3, P4, P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def xxhash64(data: bytes, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of many short byte strings at once; those above 31 bytes go through the library."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    fours = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    ones = np.frombuffer(data, np.uint8)
    h = P5 + size.astype(U64)
    at = lo.copy()
    left = size.copy()
    for step in range(3):
        some = np.flatnonzero(left >= 8)
        k = _turn(eights[at[some]] * P2, 31) * P1
        h[some] = _turn(h[some] ^ k, 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero((left & 4) > 0)
    h[some] = _turn(h[some] ^ (fours[at[some]].astype(U64) * P1), 23) * P2 + P3
    at[some] += 4
    for step in range(1, 4):
        some = np.flatnonzero((left & 3) >= step)
        h[some] = _turn(h[some] ^ (ones[at[some]].astype(U64) * P5), 11) * P1
        at[some] += 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(size > 31):
        h[i] = xxhash.xxh64_intdigest(data[lo[i]:lo[i] + size[i]])
    return h


def _crc_tables() -> np.ndarray:
    """Row k: the crc32 of each byte followed by k zero bytes."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, row >> 1 ^ np.uint32(0xEDB88320), row >> 1).astype(np.uint32)
    rows = [row]
    for _ in range(3):
        rows.append(rows[-1] >> 8 ^ row[rows[-1] & 255])
    return np.array(rows)


CRC = _crc_tables()


def crc32(data: bytes, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of many short byte strings at once, four bytes a step; those above 64 bytes go through the library."""
    fours = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    ones = np.frombuffer(data, np.uint8)
    h = np.full(len(lo), 0xFFFFFFFF, np.uint32)
    short = size <= 64
    rest = np.flatnonzero(short & (size >= 4))
    done = 0
    while len(rest):
        x = h[rest] ^ fours[lo[rest] + done]
        h[rest] = CRC[3][x & 255] ^ CRC[2][x >> 8 & 255] ^ CRC[1][x >> 16 & 255] ^ CRC[0][x >> 24]
        done += 4
        rest = rest[size[rest] >= done + 4]
    for step in range(3):
        some = np.flatnonzero(short & ((size & 3) > step))
        x = h[some]
        h[some] = x >> 8 ^ CRC[0][(x ^ ones[lo[some] + (size[some] & ~3) + step]) & 255]
    h = ~h
    for i in np.flatnonzero(~short):
        h[i] = zlib.crc32(data[lo[i]:lo[i] + size[i]])
    return h


def same_bytes(data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings at ``a`` and ``b``, both ``size`` long, are equal byte for byte."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    rest = np.arange(len(a))
    equal = np.ones(len(a), bool)
    done = 0
    while len(rest):
        left = size[rest] - done
        # of the last eight bytes only those that belong to the string count
        cut = U64(8) * (U64(8) - np.clip(left, 1, 8).astype(U64))
        differ = (eights[a[rest] + done] ^ eights[b[rest] + done]) << cut != 0
        equal[rest[differ]] = False
        rest = rest[~differ & (left > 8)]
        done += 8
    return equal


class Table:
    """Open-addressed: ``key``, the occurrence that stands for the n-gram, its ``bucket`` and its ``count``."""

    def __init__(self, data: bytes, lo: np.ndarray, size: np.ndarray, buckets: int):
        n = len(lo)
        capacity = 1 << max(4, int(2 * n - 1).bit_length() if n else 4)
        keys = xxhash64(data, lo, size)
        self.key = np.zeros(capacity, U64)
        first = np.full(capacity, -1, np.int64)
        self.slot = (keys & U64(capacity - 1)).astype(np.int64)
        open_ = np.arange(n)
        while len(open_):
            at = self.slot[open_]
            free = first[at] < 0
            taken = at[free]
            first[taken] = open_[free]  # of several, the last one written stays
            self.key[taken] = keys[first[taken]]
            holder = first[at]
            same = (self.key[at] == keys[open_]) & (size[holder] == size[open_])
            pairs = np.flatnonzero(same & (holder != open_))
            same[pairs] = same_bytes(data, lo[holder[pairs]], lo[open_[pairs]], size[open_[pairs]])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & (capacity - 1)
        self.count = np.bincount(self.slot, minlength=capacity)
        used = np.flatnonzero(first >= 0)
        self.bucket = np.zeros(capacity, np.int64)
        self.bucket[used] = crc32(data, lo[first[used]], size[first[used]]) % buckets

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket, self.count, buckets).astype(np.int64)


def counted(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many n-grams of the column ``text`` fall into each of the ``buckets``. Null and empty texts have
    none; all buckets are listed, unless there is no row at all. Each task adds up its rows first and hands on a few
    packed rows, which meet by slice of buckets."""
    slices = -(-buckets // SLICE)

    def partial(batches):
        total = None
        for batch in batches:
            total = np.zeros(slices * SLICE, np.int64) if total is None else total
            for lo, hi in pieces(batch, limit=PART):
                for words in word_sets([(t or "").encode() for t in batch.column("text")[lo:hi].to_pylist()], longest):
                    for table, _ in words.tables(longest, buckets):
                        total[:buckets] += table.bucket_counts(buckets)
        if total is not None:
            yield packed(np.arange(slices), total.reshape(slices, SLICE))

    def packed(at, rows):
        salt = np.full(len(rows), TaskContext.get().partitionId() % SALTS)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(salt, pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], names=["slice", "salt", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(row, "<i8")
        if total:
            yield packed(list(total), list(total.values()))

    def spread(batches):
        for batch in batches:
            for at, row in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(row, "<i8")
                bucket = at * SLICE + np.arange(SLICE)
                listed = bucket < buckets
                yield pa.RecordBatch.from_arrays([pa.array(bucket[listed]), pa.array(n[listed])], names=["bucket", "n"])

    kind = "slice int, salt int, counts binary"
    own = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, kind)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partial rows of very many tasks meet in two steps
    some = own.repartition(n, "slice", "salt").mapInArrow(add, kind)
    return some.repartition(min(n, slices), "slice").mapInArrow(add, kind).mapInArrow(spread, "bucket bigint, n bigint")


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln) of its smoothed share in the target over that in the corpus. The driver
    holds as many numbers as there are buckets."""
    s, t = (_counts(counted(x, buckets, longest), buckets) for x in (corpus, target))
    top, low = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * top / (float(a + 1) * low))) for a, b in zip(s, t)], np.int64)


def _counts(found: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for row in found.collect():
        out[row.bucket] = row.n
    return out


def gumbel(seed: int, doc_id: int | None) -> int:
    """The perturbation of a document; a null doc_id counts as an empty one."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, seed: int = 42, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``: the sum of the gains of a text's n-grams, and
    that sum with the document's perturbation."""
    buckets = len(gains)

    def rows(batches):
        for batch in batches:
            for lo, hi in pieces(batch, limit=PART):
                ids = batch.column("doc_id")[lo:hi]
                texts = [(t or "").encode() for t in batch.column("text")[lo:hi].to_pylist()]
                n_words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
                for words in word_sets(texts, longest):
                    n_words += np.bincount(words.doc[words.own], minlength=len(texts))
                    for table, doc in words.tables(longest, buckets):
                        features += np.bincount(doc, minlength=len(texts))
                        # sums of whole numbers far below 2**53: exact
                        weight += np.bincount(doc, gains[table.bucket[table.slot]], len(texts)).astype(np.int64)
                score = weight + np.array([gumbel(seed, d) for d in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return documents_of(docs).mapInArrow(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of ``docs`` (doc_id, text), resampled towards the
    texts of ``target``.

    Of the documents with ``least_words`` words, the ``percent`` with the highest scores are drawn and ranked from 1;
    ties go to the smaller doc_id, null last, then to fewer words and the smaller weight; equal rows are told apart by
    nothing and may swap. ``rank`` is null for the rest. A null or empty text has no words, weight 0, and is never drawn.
    An empty target or corpus counts as one of smoothing alone. Other columns are not looked at. Scores depend on rows
    and ``seed`` alone, not on partitions.
    """
    found = stored(weighed(docs, gains_of(docs, target, buckets, longest), seed, longest), "weighed")
    early = {"_out": F.col("n_words") < least_words, "_low": -F.col("score"), "_null": F.col("doc_id").isNull()}
    ranked = ordinal_rank(found.withColumns(early), [], ["_out", "_low", "_null", "doc_id", "n_words", "weight"], "_at")
    eligible = ranked.where(~F.col("_out")).count()
    rank = F.when(~F.col("_out") & (F.col("_at") < percent * eligible // 100), F.col("_at") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
