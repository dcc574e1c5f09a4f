"""Exact top-k inner products over a bit-sliced index.

Vectors become integers. The index keeps blocks of rows; in a block every attribute is a set of bitmaps, one per
binary digit, with a bit per row. A query's scores are sums of such bitmaps, shifted by the digits of the query's
components, and are added by full adders on whole bitmaps: the result is again one bitmap per binary digit, from
which the best rows are selected digit by digit, most significant first. Rows that tie at the border are settled by
their id. A negative component adds the complement of a bitmap, which shifts all scores of the block alike.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridcast.llm.common import fan_out, stored

BLOCK = 16384  # rows of an index block
QUERIES = 4096  # queries that meet a block at once: the index is copied to every group of so many
FEWEST = 128  # queries of a group where smaller groups are needed to occupy all tasks


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component, for rows with an id whose vector and
    components are neither null nor NaN nor infinite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(e * float(scale))).alias("v"))


def _matrix(vectors: pa.Array | list) -> np.ndarray:
    rows = [np.asarray(v, np.int64) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for o, r in zip(out, rows):
        o[:len(r)] = r
    return out


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest value of each attribute, bitmaps [attribute, digit, word]) of a block [row, attribute]."""
    low = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
    up = x - low
    digits = max(1, int(up.max(initial=0)).bit_length())
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], digits, words * 8), np.uint8)
    for b in range(digits):
        packed = np.packbits(((up >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, :len(packed)] = packed.T
    return low, out.view(np.uint64)


def index_blocks(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(block, ids, low, maps, digits, dims): the index, a row per block."""

    def build(batches):
        held, ids, k = [], [], 0

        def flush():
            x = _matrix(held)
            low, maps = slices(x)
            record = {"block": f"{part}-{k}", "ids": np.array(ids, np.int64).tobytes(), "low": low.tobytes(), "maps": maps.tobytes(), "digits": maps.shape[1], "dims": x.shape[1]}
            return pa.RecordBatch.from_pylist([record], schema=pa.schema([("block", pa.string()), ("ids", pa.binary()), ("low", pa.binary()), ("maps", pa.binary()), ("digits", pa.int32()), ("dims", pa.int32())]))

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids.append(i)
                held.append(v)
                if len(ids) >= rows:
                    yield flush()
                    held, ids, k = [], [], k + 1
        if ids:
            yield flush()

    tagged = vectors.withColumn("part", F.spark_partition_id())
    return tagged.mapInArrow(build, "block string, ids binary, low binary, maps binary, digits int, dims int")


def total(query: np.ndarray, maps: np.ndarray, flipped: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, least digit first, of sum |q| * (attribute, or its complement where q < 0)."""
    levels: dict[int, list] = {}
    dims, digits = maps.shape[0], maps.shape[1]
    q = query[:dims]
    magnitude, bit = np.abs(q), np.arange(digits)
    for j in range(int(magnitude.max(initial=0)).bit_length()):
        for source, sign in ((maps, q > 0), (flipped, q < 0)):
            at = np.flatnonzero(sign & ((magnitude >> j) & 1 == 1))
            if len(at):
                for b in bit:
                    levels.setdefault(j + int(b), []).append(source[at, b])
    out, w = [], 0
    while levels:
        stack = levels.pop(w, None)
        if stack is None:
            out.append(np.zeros(maps.shape[2], np.uint64))
            w += 1
            continue
        a = np.concatenate(stack)
        carry = levels.setdefault(w + 1, []) if len(a) > 1 else None
        while len(a) > 1:
            t = len(a) // 3
            if t:
                x, y, z = a[:t], a[t:2 * t], a[2 * t:3 * t]
                half = x ^ y
                carry.append((x & y) | (z & half))
                a = np.concatenate([half ^ z, a[3 * t:]])
            else:
                carry.append((a[:1] & a[1:2]))
                a = a[:1] ^ a[1:2]
        out.append(a[0])
        w += 1
    return out


def best(digits: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k largest, and of those that tie for the rest."""
    sure, tied = np.zeros_like(rows), rows
    for d in reversed(digits):
        x = sure | (tied & d)
        n = int(np.bitwise_count(x).sum())
        if n > k:
            tied = tied & d
        elif n < k:
            sure, tied = x, tied & ~d
        else:
            return x, np.zeros_like(rows)
    return sure, tied


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, low: np.ndarray, maps: np.ndarray, query_ids, queries: list, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of the block, ties to the smaller id; fewer if there
    are fewer. A row with the query's id takes no part."""
    flipped, out = ~maps, []
    every = np.packbits(np.arange(maps.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    weight = np.int64(1) << np.arange(maps.shape[1], dtype=np.int64)
    for qid, q in zip(query_ids, queries):
        full = np.zeros(maps.shape[0], np.int64)
        q = np.asarray(q, np.int64)[:len(full)]
        full[:len(q)] = q
        digits = total(full, maps, flipped)
        rows = every
        own = np.flatnonzero(ids == qid)
        if len(own):
            rows = rows.copy()
            for r in own.tolist():
                rows[r >> 6] &= ~np.uint64(1 << (r & 63))
        sure, tied = best(digits, rows, k)
        at = _rows_of(sure)
        ties = _rows_of(tied)
        if len(at) < k and len(ties):
            at = np.r_[at, ties[np.argsort(ids[ties], kind="stable")[:k - len(at)]]]
        for r in at.tolist():
            digit = (maps[:, :, r >> 6] >> np.uint64(r & 63)) & np.uint64(1)
            value = low + digit.astype(np.int64) @ weight
            out.append((int(qid), int(ids[r]), int(full @ value)))
    return out


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` rows of the
    table with the highest integer inner products, the row itself left out; ties go to the smaller vec_id.

    Rows with a null id or vector, or a null or non-finite component, take no part; missing components of a shorter
    vector count as 0. Of repeated rows each counts; a repeated query is asked once. Scores must fit in 63 bits.
    Queries and index meet block by block: every query against every row.
    """
    vectors = stored(whole_vectors(table, scale), "vectors")
    index = stored(index_blocks(vectors), "index")
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # a cell is a group of queries and a slot of blocks; blocks go to every group, queries to every slot
    n, slots = asked.count(), max(1, index.count())
    # four cells for each task of the exchange; from there on groups grow with the queries, not in number
    groups = max(1, -(-n // QUERIES), min(-(-n // FEWEST), -(-4 * fan_out(vectors) // slots)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = index.withColumn("slot", part("block", slots)).withColumn("group", each(groups))
    right = asked.withColumn("group", part("vec_id", groups)).withColumn("slot", each(slots))

    def meet(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in (block if len(queries) else block[:0]).iterrows():
            ids, low = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["low"], np.int64)
            maps = np.frombuffer(r["maps"], np.uint64).reshape(r["dims"], r["digits"], -1)
            out += search_block(ids, low, maps, queries["vec_id"], list(queries["v"]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("slot", "group").cogroup(right.groupBy("slot", "group")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
