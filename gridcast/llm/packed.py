"""Grouping of very many small entries by a 64-bit key, as NumPy arrays inside Spark rows.

An entry is (key, document, position); documents are numbers or, as two columns, pairs of numbers. A task sorts what it holds, settles keys it holds more than once, and sends
one entry per key on: a key that fills a third of the table travels once per task. Entries go to buckets by key;
a bucket's rows are arrays, so shuffling costs 10 to 20 bytes an entry.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridcast.llm.common import U64, mix

ROWS = "bucket int, keys binary, checks binary, docs binary, counts binary, pos binary, hubs binary"
NAMES = ["bucket", "keys", "checks", "docs", "counts", "pos", "hubs"]
TYPES = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in NAMES[1:]])
FLUSH = 2_000_000  # entries a task holds at once
BUCKETS_PER_TASK = 4  # evens out how buckets fall on tasks

Entries = tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]  # keys, second keys or None, documents, positions


def _sorting(docs: np.ndarray) -> tuple:
    """Documents as keys of np.lexsort."""
    return (docs,) if docs.ndim == 1 else tuple(docs.T[::-1])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a != b if a.ndim == 1 else (a != b).any(axis=1)


def repeats(keys, checks, docs, pos) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the entries whose key (and check) occurs more than once, and for each the index of the first
    of its group by (document, position)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    at = order[np.r_[False, same] | np.r_[same, False]]
    if not len(at):
        return at, at
    at = at[np.lexsort((pos[at], *_sorting(docs[at]), *(() if checks is None else (checks[at],)), keys[at]))]
    new = keys[at][1:] != keys[at][:-1]
    if checks is not None:
        new |= checks[at][1:] != checks[at][:-1]
    starts = np.flatnonzero(np.r_[True, new])
    sizes = np.diff(np.r_[starts, len(at)])
    hub = np.repeat(at[starts], sizes)
    many = np.repeat(sizes > 1, sizes)
    return at[many], hub[many]


def _rows(bucket, keys, checks, docs, pos, hubs=None) -> list:
    """One row; runs of one document are stored once."""
    cut = np.flatnonzero(np.r_[True, _differ(docs[1:], docs[:-1])])
    counts = np.diff(np.r_[cut, len(docs)]).astype(np.int32)
    raw = lambda a: None if a is None else a.tobytes()
    return [int(bucket), raw(keys), raw(checks), raw(docs[cut]), raw(counts), raw(pos.astype(np.uint32)), raw(hubs)]


def _settled(mode: str, keys, docs, pos, member, hub):
    """What a group tells: (documents, positions, hubs)."""
    if mode == "both":  # everything that occurs more than once
        at = np.unique(np.r_[member, hub])
        return keys[at], docs[at], pos[at], None
    later = _differ(docs[member], docs[hub]) | (pos[member] != pos[hub])
    at = member[later]
    if mode == "later":  # all but the first
        o = np.lexsort((pos[at], *_sorting(docs[at])))
        return keys[at[o]], docs[at[o]], pos[at[o]], None
    return keys[at], docs[at], pos[at], docs[hub[later]]  # edges: each to the first of its group


def packed(entries: Iterator[Entries], mode: str, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The map side: yields rows of ROWS."""

    def flush(parts):
        keys, checks, docs, pos = (None if p[0] is None else np.concatenate(p) for p in zip(*parts))
        member, hub = repeats(keys, checks, docs, pos)
        out, keep = [], np.ones(len(keys), bool)
        if len(member):
            keep[member] = False
            keep[hub] = True
            k, d, p, h = _settled(mode, keys, docs, pos, member, hub)
            if len(d):
                # known already; a bucket only says which task passes it on
                step = 1 << 16
                out += [_rows((int(d[i].flat[0]) + i) % n_buckets, k[i:i + step] if h is not None else None, None, d[i:i + step], p[i:i + step], np.zeros(0, np.int64) if h is None else h[i:i + step]) for i in range(0, len(d), step)]
        at = np.flatnonzero(keep)
        bucket = (keys[at] % U64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(at)] if len(at) else []):
            i = at[lo:hi]
            out.append(_rows(bucket[lo], keys[i], None if checks is None else checks[i], docs[i], pos[i]))
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 2000]), TYPES.types)], schema=TYPES)

    held, n = [], 0
    for part in entries:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= FLUSH:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _unpacked(rows: list[dict]):
    get = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    docs, counts = get("docs", np.int64), get("counts", np.int32)
    if len(docs) > len(counts):
        docs = docs.reshape(len(counts), -1)
    return np.repeat(docs, counts, axis=0), get("pos", np.uint32)


MARKS = "bucket int, docs binary, counts binary, pos binary"


def _marks(docs: np.ndarray, pos: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Positions by document, many documents to a row: a row per document and task would be more rows than entries."""
    bucket = (mix(mix(docs[:, 0].view(U64)) + docs[:, 1].view(U64)) % U64(n_buckets)).astype(np.int64)
    o = np.lexsort((pos, *_sorting(docs), bucket))
    docs, pos, bucket = docs[o], pos[o], bucket[o]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(docs) else np.zeros(0, int)
    rows = [_rows(bucket[a], None, None, docs[a:b], pos[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(docs)] if len(docs) else cut)]
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(columns[i], pa.binary()) for i in (3, 4, 5)]], names=["bucket", "docs", "counts", "pos"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, found) from the rows of some buckets: one row per document, its positions as uint32 numbers."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    docs, pos = _unpacked(rows)
    rows.clear()
    o = np.lexsort((pos, *_sorting(docs)))
    docs, pos = docs[o], pos[o]
    cut = np.flatnonzero(np.r_[True, _differ(docs[1:], docs[:-1])])
    ends = np.r_[cut[1:], len(docs)]
    for i in range(0, len(cut), 5000):
        found = [pos[a:b].tobytes() for a, b in zip(cut[i:i + 5000], ends[i:i + 5000])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, docs[cut[i:i + 5000]].T.copy()), pa.array(found, pa.binary())], names=["doc_id", "text_hash", "found"])


def _edges(keys, docs, hubs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.array(hubs)], names=["key", "a", "b"])


def gathered(df: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[Entries]], mode: str, n: int) -> DataFrame:
    """Group the entries of all tasks by key. Mode ``both``: (doc_id, text_hash, found) with the positions of every entry
    with a key that occurs more than once; ``later``: of every such entry but its group's first; ``found`` holds uint32
    numbers, a row per document, and documents are pairs (doc_id, text_hash). Mode ``edges``: (key, a, b), each entry's document with a first one's."""
    n_buckets = BUCKETS_PER_TASK * n
    sent = df.mapInArrow(lambda batches: packed(entries(batches), mode, n_buckets), ROWS).repartition(n, "bucket")

    def settle(batches):
        rows, marks = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["hubs"] is None:
                    rows.append(r)
                elif mode == "edges":
                    docs, _ = _unpacked([r])
                    yield _edges(np.frombuffer(r["keys"], U64), docs, np.frombuffer(r["hubs"], np.int64))
                else:
                    marks.append(_unpacked([r]))
        if rows:
            docs, pos = _unpacked(rows)
            keys = np.concatenate([np.frombuffer(r["keys"], U64) for r in rows])
            checks = None if rows[0]["checks"] is None else np.concatenate([np.frombuffer(r["checks"], U64) for r in rows])
            rows.clear()
            member, hub = repeats(keys, checks, docs, pos)
            if len(member):
                k, d, p, h = _settled(mode, keys, docs, pos, member, hub)
                if mode == "edges":
                    for i in range(0, len(d), 1 << 16):
                        s = slice(i, i + (1 << 16))
                        yield _edges(k[s], d[s], h[s])
                else:
                    marks.append((d, p))
        if marks:
            # a bucket per task: more would only cut the rows smaller
            yield _marks(*(np.concatenate(x) for x in zip(*marks)), n)

    if mode == "edges":
        return sent.mapInArrow(settle, "key bigint, a bigint, b bigint")
    return sent.mapInArrow(settle, MARKS).repartition(n, "bucket").mapInArrow(_by_document, "doc_id bigint, text_hash bigint, found binary")
