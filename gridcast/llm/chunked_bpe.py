"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; all chunks are pre-tokenised in parallel. Where two
neighbours both see a pre-token border in their overlap, they agree from there on, so the text is cut at that border:
pre-tokens depend on what follows a border, never on what precedes it. A chunk that shares no border with its
neighbour (one pre-token longer than the overlap) is pre-tokenised again together with it. The pieces between cuts
are encoded in parallel, and a document's ids are those of its pieces in order. Decoding concatenates raw bytes.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import documents_of, fan_out, stored

CHUNK = 1 << 15  # characters
OVERLAP = 1 << 10


class Codec:
    """Ids of a text and bytes of ids, under a list of ranks and a pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.names = [str(i) for i in range(max(table.values(), default=0) + 1)]
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def borders(self, text: str) -> list[int]:
        """Ends of pre-tokens after which a text may be cut: not behind white space, which a longer run of it
        would have split in another way."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    return [text[i:i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]


def cut_marks(c: Codec, text: str, chunk: int) -> tuple[list[int], list[int]]:
    """Borders of a chunk inside its overlap with the chunk before it, and inside that with the next one, each
    counted from the overlap's start."""
    at = c.borders(text)
    overlap = max(0, len(text) - chunk)
    return [b for b in at if b <= OVERLAP], [b - chunk for b in at if chunk <= b < chunk + overlap]


def stitch(c: Codec, parts: list[tuple[str, list[int], list[int]]], chunk: int = CHUNK) -> list[str]:
    """Pieces of a document whose encodings follow one another, from its chunks in order with their marks."""
    pieces, open_text = [], parts[0][0][:chunk]  # what follows the last cut, up to the end of the chunk in hand
    tail = set(parts[0][2])
    for k in range(1, len(parts)):
        text, head, own_tail = parts[k]
        common = [b for b in head if b in tail and b > 0]
        if common:
            cut = common[0]
            pieces.append(open_text + text[:cut])
            open_text, tail = text[cut:chunk], set(own_tail)
        else:
            open_text += text[:chunk]
            seen = c.borders(open_text + text[chunk:])
            # a border at the very end may be there only because the text ends
            tail = {b - len(open_text) for b in seen if len(open_text) <= b < len(open_text) + len(text) - chunk}
    return [*pieces, open_text]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``; a null text counts as empty and has no ids. With ``digest``:
    (doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and of the bytes that decoding gives back."""
    ranks = Path(ranks_path).read_bytes()
    base = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids array<int>"

    def row(c: Codec, doc_id, ids: list[int]):
        if not digest:
            return doc_id, ids
        sha = hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest()
        return doc_id, len(ids), sha, hashlib.sha256(c.decode(ids)).hexdigest()

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow.types)], schema=arrow)

    def short(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids), 500):
                yield batch_of([row(c, d, c.encode(t.as_py())) for d, t in zip(ids[lo:lo + 500], texts[lo:lo + 500])])

    def split(batches):
        for batch in batches:
            for uid, doc_id, n, text in zip(*(batch.column(x).to_pylist() for x in ("uid", "doc_id", "copies", "text"))):
                parts = chunks_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(parts)), pa.array([doc_id] * len(parts), pa.int64()), pa.array([n] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["uid", "doc_id", "copies", "k", "part"])

    def mark(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            marks = [cut_marks(c, t.as_py(), CHUNK) for t in batch.column("part")]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in marks], kind), pa.array([m[1] for m in marks], kind)], names=[*batch.schema.names, "head", "tail"])

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = stitch(codec(ranks, pattern), [(t, list(h), list(e)) for t, h, e in zip(pdf["part"], pdf["head"], pdf["tail"])])
        first = pdf.iloc[0]
        return pd.DataFrame({"uid": first["uid"], "doc_id": [None if pd.isna(first["doc_id"]) else first["doc_id"]] * len(found), "copies": first["copies"], "k": range(len(found)), "part": found}).astype({"doc_id": "Int64"})

    def encode_pieces(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            ids = [np.array(c.encode(t.as_py()), np.int32).tobytes() for t in batch.column("part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("uid", "doc_id", "copies", "k")), pa.array(ids, pa.binary())], names=["uid", "doc_id", "copies", "k", "ids"])

    def whole(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            for doc_id, n, parts in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "copies", "parts"))):
                ids = np.concatenate([np.frombuffer(p["ids"], np.int32) for p in sorted(parts, key=lambda p: p["k"])]).tolist()
                yield batch_of([row(c, doc_id, ids)] * n)

    size = F.length("text")
    n = fan_out(base)
    # equal rows are cut and stitched once
    long = base.where(size > CHUNK).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("uid", F.xxhash64("doc_id", "text"))
    cut = long.mapInArrow(split, "uid bigint, doc_id bigint, copies bigint, k int, part string").repartition(n, "uid", "k")
    marked = cut.mapInArrow(mark, "uid bigint, doc_id bigint, copies bigint, k int, part string, head array<int>, tail array<int>")
    pieces = marked.groupBy("uid", "doc_id").applyInPandas(join_up, "uid bigint, doc_id bigint, copies bigint, k int, part string").repartition(n, "uid", "k")
    done = pieces.mapInArrow(encode_pieces, "uid bigint, doc_id bigint, copies bigint, k int, ids binary")
    joined = done.groupBy("uid", "doc_id").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("k", "ids")).alias("parts"))
    return base.where(size <= CHUNK).mapInArrow(short, schema).unionByName(joined.mapInArrow(whole, schema))


def decoded(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids): the tokens' raw bytes, which need not be whole characters."""
    ranks = Path(ranks_path).read_bytes()

    def rows(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(rows, "doc_id bigint, bytes binary")
