"""Substring deduplication by recompression.

Rounds name runs of equal tokens, then pairs of neighbours. A symbol's name is a hash of what it stands for, so
every task gives equal substrings equal names without asking any other. Whether two neighbours pair depends on
their names alone (one tossed "left", the next tossed "right"), so two equal stretches get the same symbols but
for a few at their ends. After three rounds a symbol spans at most 8 words (longer where words run).

*Reveal*: a window of ``width`` words belongs to the last symbol border before its middle; that border's name is
a hash of the words around it that every such window holds. Names that occur once prove their windows unique.
*Verify*: windows at shared names are compared by 128 bits of their whole word sequence; all but the first by
(doc_id, hash of the text, position) are repeats. Windows in which a run of equal words makes the borders depend on what lies
outside are named one by one instead: the choice depends on the window's words only, so it is the same everywhere.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import U64, WordHashes, documents_of, fan_out, hashed, mix, pair, pieces, spans, stored, words_of
from gridcast.llm.packed import gathered

WIDTH = 20
ROUNDS = 3
LEAST_ID = -(1 << 63)  # stands for a null doc_id


def symbols(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """The symbols of each round over a concatenation of documents. ``first``: does a document start here?

    Returns (run starts, [(starts, tossed left?) before each pairing], final starts), all as word positions.
    """
    n = len(words)
    head = np.ones(n, bool)
    head[1:] = (words[1:] != words[:-1]) | first[1:]
    start = np.flatnonzero(head)
    length = np.diff(np.r_[start, n])
    name = np.where(length > 1, pair(words[start], length.astype(U64), 7), words[start])
    runs, layers = start, []
    for level in range(rounds):
        left = (mix(name + U64(0xA5A5 + level)) >> U64(63)).astype(bool)
        layers.append((start, left))
        joins = np.zeros(len(start), bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~first[start[1:]]
        keep = np.ones(len(start), bool)
        keep[1:] = ~joins[:-1]
        at = np.flatnonzero(joins)
        name[at] = pair(name[at], name[at + 1], 1000 + level)
        start, name = start[keep], name[keep]
    return runs, layers, start


def anchors(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one document: (its start, the border it belongs to, is it named by itself?)."""
    n, none = len(words), np.zeros(0, np.int64)
    if n < width:
        return none, none, np.zeros(0, bool)
    doc = np.cumsum(first)
    p = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(p):
        return none, none, np.zeros(0, bool)
    runs, layers, border = symbols(words, first)
    mid = p + width // 2
    b = border[np.searchsorted(border, mid, side="right") - 1]
    equal = np.zeros(n + 1, np.int64)
    equal[2:] = np.cumsum((words[1:] == words[:-1]) & ~first[1:])
    # without a run inside, at most 1 + 1 + 2 + 4 words at either end depend on what lies outside
    alone = np.zeros(len(p), bool)
    odd = np.flatnonzero(equal[p + width] > equal[p + 1])
    if width < 20:
        odd = np.arange(len(p))
    if len(odd):
        q = p[odd]
        lo = np.r_[runs, n][np.searchsorted(runs, q, side="right")]
        hi = runs[np.searchsorted(runs, q + width - 1, side="right") - 1]
        for start, left in layers:
            i = np.minimum(np.searchsorted(start, lo), len(start) - 1)
            ends = np.r_[start[1:], n]
            lo = np.where(~left[i] & (lo < n), ends[i], lo)
            j = np.maximum(np.searchsorted(start, hi) - 1, 0)
            hi = np.where(left[j], start[j], hi)
        alone[odd] = (lo > mid[odd]) | (hi <= mid[odd])
    alone |= b < p + 3
    return p, b, alone


def _documents(batch: pa.RecordBatch, lo: int, hi: int, cache: WordHashes):
    """Word hashes of some rows, one after another."""
    parts = [hashed(words_of(t), cache) for t in batch.column("text")[lo:hi].to_pylist()]
    counts = np.array([len(x) for x in parts])
    words = np.concatenate(parts) if parts else np.zeros(0, U64)
    first = np.zeros(len(words), bool)
    begins = np.cumsum(counts) - counts
    first[begins[counts > 0]] = True
    ids = np.array([LEAST_ID if d is None else d for d in batch.column("doc_id")[lo:hi].to_pylist()], np.int64)
    ids = np.stack([ids, batch.column("text_hash")[lo:hi].to_numpy()], axis=1)
    return words, first, ids, counts, begins


def _tagged(words, first, width):
    """Windows with the tag of their name: 2 * border, or 2 * start + 1 where named by themselves."""
    p, b, alone = anchors(words, first, width)
    return p, np.where(alone, 2 * p + 1, 2 * b)


def reveal(width: int):
    """Entries (name, document, tag inside the document)."""

    def entries(batches):
        cache = WordHashes()
        near = min(width // 2 + 3, width)
        for batch in batches:
            for lo, hi in pieces(batch):
                words, first, ids, counts, begins = _documents(batch, lo, hi, cache)
                p, tag = _tagged(words, first, width)
                tag = tag[np.r_[True, tag[1:] != tag[:-1]]] if len(tag) else tag
                tag = np.unique(tag)
                if not len(tag):
                    continue
                at, alone = tag >> 1, (tag & 1).astype(bool)
                key = np.zeros(len(tag), U64)
                key[~alone] = spans(words, near, 11)[at[~alone] - 3]
                if alone.any():
                    key[alone] = spans(words, width, 13)[at[alone]]
                d = np.searchsorted(begins, at, side="right") - 1
                yield key, None, ids[d], tag - 2 * begins[d]

    return entries


def verify(width: int):
    """Entries (128 bits of the window, document, start) of the windows whose names are shared."""

    def entries(batches):
        cache = WordHashes()
        for batch in batches:
            for lo, hi in pieces(batch):
                words, first, ids, counts, begins = _documents(batch, lo, hi, cache)
                p, tag = _tagged(words, first, width)
                if not len(p):
                    continue
                d = np.searchsorted(begins, p, side="right") - 1
                wanted = [np.frombuffer(found, np.uint32).astype(np.int64) + 2 * begins[i] for i, found in enumerate(batch.column("found")[lo:hi].to_pylist()) if found]
                p = p[np.isin(tag, np.concatenate(wanted))] if wanted else p[:0]
                if len(p):
                    d = np.searchsorted(begins, p, side="right") - 1
                    yield spans(words, width, 21)[p], spans(words, width, 5021)[p], ids[d], p - begins[d]

    return entries


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, found): for each document that has any, the starts of windows whose word sequence also
    starts earlier, as uint32 numbers. Earlier is a smaller doc_id, with one doc_id a smaller hash of the text, in one
    text a smaller place. A null doc_id counts as the smallest and is returned as LEAST_ID. Rows with one doc_id and
    other texts are documents of their own; exactly repeated rows are one, none of them earlier than another."""
    if width < 4:
        raise ValueError("a window has 4 words at least")
    docs = with_hash(docs)
    n = fan_out(docs)
    named = stored(gathered(docs, reveal(width), "both", n), "names")
    some = with_found(docs, named, "inner").where("text IS NOT NULL")
    return stored(gathered(some, verify(width), "later", n), "repeats")


def with_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_hash``, which tells rows of one doc_id apart."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def with_found(docs: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "_found_id", "text_hash": "_found_hash"})
    key = F.coalesce(docs["doc_id"], F.lit(LEAST_ID))
    return docs.join(found, (key == F.col("_found_id")) & (docs["text_hash"] == F.col("_found_hash")), how).drop("_found_id", "_found_hash")


def covered(starts: bytes, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    change = np.zeros(n_words + width + 1, np.int32)
    at = np.unique(np.frombuffer(starts, np.uint32)).astype(np.int64)
    at = at[at + width <= n_words]
    change[at] += 1
    change[at + width] -= 1
    return np.cumsum(change)[:n_words] > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """Remove every word that lies in a window of ``width`` words which also starts earlier.

    Reads ``doc_id`` and ``text``; returns the columns of ``docs`` with ``text`` cut, and ``n_words``,
    ``n_removed``. What stays of a text keeps its own white space, a cut leaves one space; an untouched text is
    returned as it is, a null text as null with no words. With ``digest``, only doc_id, n_words, n_removed and
    kept_sha256 (kept words joined by one space) are returned. An empty table gives an empty table.
    """
    import hashlib
    import re

    rest = [] if digest else [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    base = documents_of(docs, *[F.col(f"`{c}`").alias(f"_rest_{i}") for i, c in enumerate(rest)])
    joined = with_found(with_hash(base), repeated_windows(documents_of(docs), width)).drop("text_hash")

    def cut(text: str, gone: np.ndarray) -> str:
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
        return " ".join(text[at[a][0]:at[b - 1][1]] for a, b in zip(edge[::2], edge[1::2]))

    def rows(batches):
        for batch in batches:
            for lo, hi in pieces(batch):
                part = batch.slice(lo, hi - lo)
                texts, new, total, removed, sha = part.column("text").to_pylist(), [], [], [], []
                for text, found in zip(texts, part.column("found").to_pylist()):
                    words = words_of(text)
                    gone = covered(found, len(words), width) if found else None
                    lost = int(gone.sum()) if found else 0
                    total.append(len(words))
                    removed.append(lost)
                    if digest:
                        kept = [w for w, g in zip(words, gone) if not g] if lost else words
                        sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    else:
                        new.append(cut(text, gone) if lost else text)
                counts = [pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
                if digest:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(new, pa.string()), *[part.column(f"_rest_{i}") for i in range(len(rest))], *counts], names=out_names)

    if digest:
        return joined.mapInArrow(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    from pyspark.sql.types import LongType, StructField, StructType

    fields = [f for f in joined.schema.fields if f.name != "found"] + [StructField("n_words", LongType()), StructField("n_removed", LongType())]
    out_names = [f.name for f in fields]
    out = joined.mapInArrow(rows, StructType(fields))
    back = {f"_rest_{i}": c for i, c in enumerate(rest)}
    named = {c: F.col(k).alias(c) for k, c in back.items()}
    order = [named[c] if c in named else F.col(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*order, "n_words", "n_removed")
