"""Token files: a wavelet matrix per shard.

A shard file holds the ids of consecutive documents. Ids are replaced by their rank among the shard's distinct ids;
the ranks are stored digit by digit: plane k has, for each position, the k-th binary digit, and before the next plane
the zeros are moved stably in front of the ones. Counts of ones give rank and select, by which a token, the number of
its occurrences and their places are found without decoding the rest.

Planes are compressed in blocks of 65,536 digits. A directory holds each block's place in the file and the ones
before it, a block the ones before each 512 of its digits. So ``access``, ``count`` and ``occurrence`` read one or two
blocks of a plane, whatever the shard's size.
"""
from __future__ import annotations

import io
import json
import re
import struct
import zlib
from array import array
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from gridcast.llm.common import documents_of, fan_out, in_order, stored
from gridcast.scratch import scratch_path
from gridcast.sources.files import open_input, write_atomic

MAGIC = b"WMTX2\n"
SHARD_TOKENS = 4_000_000
PLANE_BLOCK = 1 << 16  # digits compressed together
RANK_BLOCK = 512  # digits between stored counts; those of a block fit in 16 bits
COUNTS = PLANE_BLOCK // RANK_BLOCK
BLOCKS_OPEN = 256  # unpacked blocks a reader holds
CACHED = 500_000  # words a worker remembers, and parts of words; it starts anew beyond


def _plane(ones: np.ndarray, press: zstandard.ZstdCompressor) -> tuple[list[bytes], np.ndarray]:
    """A plane's compressed blocks, each with its counts in front, and the ones before each block (and in all)."""
    packed = np.packbits(ones, bitorder="little")
    packed = np.pad(packed, (0, -len(packed) % (PLANE_BLOCK // 8))).reshape(-1, PLANE_BLOCK // 8)
    count = np.bitwise_count(packed.reshape(len(packed), COUNTS, RANK_BLOCK // 8)).sum(axis=2, dtype=np.int64)
    inside = (np.cumsum(count, axis=1) - count).astype("<u2")
    return [press.compress(c.tobytes() + x.tobytes()) for c, x in zip(inside, packed)], np.r_[0, np.cumsum(count.sum(axis=1))]


def to_bytes(tokens: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard file of some documents' ids, one document after another."""
    top = int(tokens.max(initial=0))
    seen = np.zeros(top + 1, bool)
    seen[tokens] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    rank = np.zeros(top + 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    now = rank[tokens]
    width = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    press = zstandard.ZstdCompressor(level=1)
    parts, zeros, before = [], [], []
    for k in reversed(range(width)):
        ones = (now & now.dtype.type(1 << k)) != 0
        blocks, sums = _plane(ones, press)
        parts += blocks
        before.append(sums)
        a, b = np.flatnonzero(~ones), np.flatnonzero(ones)
        zeros.append(len(a))
        if k:
            now = np.concatenate([now.take(a), now.take(b)])
    ends = np.cumsum([0] + [len(p) for p in parts])
    tables = [press.compress(np.ascontiguousarray(x).tobytes()) for x in (np.stack(before).astype("<i8"), ends.astype("<i8"), alphabet, doc_ids.astype(np.int64), counts.astype(np.int64))]
    head = json.dumps({"n": len(tokens), "docs": len(doc_ids), "zeros": zeros, "tables": [len(t) for t in tables]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(tables) + b"".join(parts)


class WaveletMatrix:
    """Access to one shard file, given as bytes or as an open file that can seek; parts are read when needed."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, bytes) else source
        lead = self._read(0, len(MAGIC) + 4)
        if lead[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", lead[len(MAGIC):])[0]
        head = json.loads(self._read(len(lead), size))
        self.n, self.zeros = head["n"], head["zeros"]
        self._tables = np.cumsum([len(lead) + size, *head["tables"]])
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _table(self, k: int, kind) -> np.ndarray:
        at, end = self._tables[k:k + 2].tolist()
        return np.frombuffer(self._unpack(self._read(at, end - at)), kind)

    @cached_property
    def _ones(self) -> np.ndarray:
        """[plane, block]: ones before the block; last, of the whole plane."""
        return self._table(0, "<i8").reshape(len(self.zeros), -1)

    @cached_property
    def _ends(self) -> np.ndarray:
        return self._table(1, "<i8") + self._tables[5]

    @cached_property
    def alphabet(self) -> np.ndarray:
        return self._table(2, np.uint32)

    @cached_property
    def doc_ids(self) -> np.ndarray:
        return self._table(3, np.int64)

    @cached_property
    def counts(self) -> np.ndarray:
        return self._table(4, np.int64)

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(ones before each 512 digits, digits as bytes) of a plane's block."""
        if (level, block) not in self._held:
            if len(self._held) >= BLOCKS_OPEN:
                self._held.clear()
            at, end = self._ends[level * (self._ones.shape[1] - 1) + block:][:2].tolist()
            raw = self._unpack(self._read(at, end - at))
            self._held[level, block] = np.frombuffer(raw, "<u2", COUNTS), np.frombuffer(raw, np.uint8, offset=2 * COUNTS)
        return self._held[level, block]

    def _digits(self, level: int) -> np.ndarray:
        """A whole plane, read at once."""
        blocks = self._ones.shape[1] - 1
        ends = self._ends[level * blocks:(level + 1) * blocks + 1].tolist()
        raw = self._read(ends[0], ends[-1] - ends[0])
        whole = b"".join(self._unpack(raw[a - ends[0]:b - ends[0]])[2 * COUNTS:] for a, b in zip(ends, ends[1:]))
        return np.unpackbits(np.frombuffer(whole, np.uint8), count=self.n, bitorder="little").astype(bool)

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone, last first."""
        now = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k, level in enumerate(reversed(range(len(self.zeros)))):
            ones, z = self._digits(level), self.zeros[level]
            out = np.empty_like(now)
            out[np.flatnonzero(~ones)] = now[:z]
            out[np.flatnonzero(ones)] = now[z:] | now.dtype.type(1 << k)
            now = out
        return self.alphabet[now]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i digits of a plane."""
        block, inside = divmod(i, PLANE_BLOCK)
        known = int(self._ones[level, block])
        if not inside:
            return known
        counts, digits = self._block(level, block)
        part, rest = divmod(inside, RANK_BLOCK)
        if part == COUNTS:
            part, rest = part - 1, RANK_BLOCK
        at = part * RANK_BLOCK // 8
        return known + int(counts[part]) + int(np.unpackbits(digits[at:at + (rest + 7) // 8], count=rest, bitorder="little").sum() if rest else 0)

    def _bit(self, level: int, i: int) -> int:
        block, inside = divmod(i, PLANE_BLOCK)
        return int(self._block(level, block)[1][inside >> 3] >> (inside & 7)) & 1

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, z in enumerate(self.zeros):
            bit, one = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = z + one if bit else i - one
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, i: int, j: int) -> tuple[int, int]:
        width = len(self.zeros)
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, i), self._rank1(level, j)
            i, j = (z + a, z + b) if code >> (width - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often an id occurs in positions i to j - 1."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi = self._range(code, i, self.n if j is None else j)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """The position of an id's k-th occurrence, from 0."""
        code = self._code(token)
        lo, hi = self._range(code, 0, self.n) if code is not None else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(len(self.zeros))):
            at = self._select(level, code >> (len(self.zeros) - 1 - level) & 1, at)
        return at

    def _select(self, level: int, bit: int, at: int) -> int:
        """Where the digit stands in this plane that stands at ``at`` after the move: the block by the directory, the
        512 digits by the block's counts, then the digit."""
        want = at - self.zeros[level] if bit else at
        before = self._ones[level]
        before = before if bit else np.minimum(np.arange(len(before)) * PLANE_BLOCK, self.n) - before
        block = int(np.searchsorted(before, want, side="right")) - 1
        counts, digits = self._block(level, block)
        counts = counts.astype(np.int64) if bit else np.arange(COUNTS) * RANK_BLOCK - counts
        want -= int(before[block])
        part = int(np.searchsorted(counts, want, side="right")) - 1
        some = np.unpackbits(digits[part * RANK_BLOCK // 8:(part + 1) * RANK_BLOCK // 8], bitorder="little") == bit
        return block * PLANE_BLOCK + part * RANK_BLOCK + int(np.flatnonzero(some)[want - int(counts[part])])


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 upwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, more = [], 256
    for b in range(256):
        names.append(chr(b) if b in own else chr(more))
        more += b not in own
    return names


class Words(dict):
    """Word (bytes without white space) -> its ids as uint32 bytes, by the library.

    For this tokenizer (lower case, white space dropped, letter runs, single digits and other runs encoded apart) a
    text's ids are those of its words. Words of printable ASCII and Latin-1 letters are split here and their parts
    given to the library's model; all other words go through its whole pipeline.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(spec.decode())
        self.model = self.library.model
        self.names = _byte_names()
        self.parts: dict[str, bytes] = {}
        self.plain, self.split = self.PLAIN.fullmatch, self.PARTS.findall
        kind = json.loads(spec)
        special = sorted(t["content"] for t in kind.get("added_tokens", []))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        steps = [s["type"] for s in kind["normalizer"].get("normalizers", [])] if kind.get("normalizer") else []
        splits = [s.get("pattern", {}).get("Regex") for s in (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        # the short way is for tokenizers of exactly this make
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def part(self, text: str) -> bytes:
        if len(self.parts) >= CACHED:
            self.parts.clear()
        # printable ASCII stands for itself
        named = text if text.isascii() else "".join(map(self.names.__getitem__, text.encode()))
        self.parts[text] = out = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        return out

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        text = word.decode()
        if self.plain(text) and not (self.special and self.special.search(text)):
            known = self.parts
            parts = self.split(text.lower())
            out = known.get(parts[0]) or self.part(parts[0])
            for p in parts[1:]:
                out += known.get(p) or self.part(p)
        else:
            out = self.whole(text)
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=1)
def words(spec: bytes) -> Words:
    return Words(spec)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` to each document and write shard files in ascending order of doc_id (null
    first; a null text counts as empty). Returns (pid, part, path, n_tokens, n_docs), a row per file in that order.

    Documents are range-partitioned by doc_id, rows with one doc_id (or none) by text and by where they were read, so
    that many of them are spread as well; a task writes its documents as one or more files, under names that a
    repeated task uses again. An empty table gives no file.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer_path).read_bytes()
    folder = folder or scratch_path(spark, "tokens")
    base = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    placed = in_order(base, fan_out(base))
    end = np.array([end_id], np.uint32).tobytes()
    least = -(1 << 63)  # a null doc_id in a file

    def write(batches):
        encode = words(spec).encode
        held, ids, total, part, pid = [], [], 0, 0, 0

        def flush():
            tokens = np.frombuffer(b"".join(held), np.uint32)
            path = f"{folder}/{pid:07d}-{part:05d}.wmx"
            write_atomic(path, to_bytes(tokens, np.array(ids), np.array([len(x) // 4 for x in held])))
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([part], pa.int32()), pa.array([path]), pa.array([len(tokens)]), pa.array([len(ids)])], names=["pid", "part", "path", "n_tokens", "n_docs"])

        for batch in batches:
            for doc_id, text, p in zip(batch.column("doc_id"), batch.column("text"), batch.column("pid").to_pylist()):
                pid = p
                x = encode(text.as_py()) + end
                held.append(x)
                ids.append(least if doc_id.as_py() is None else doc_id.as_py())
                total += len(x) // 4
                if total >= SHARD_TOKENS:
                    yield flush()
                    held, ids, total, part = [], [], 0, part + 1
        if held:
            yield flush()

    return stored(placed.mapInArrow(write, "pid int, part int, path string, n_tokens bigint, n_docs bigint"), "shards")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts the ids of all
    documents before it, ids_crc32 is that of its ids as little-endian unsigned 32-bit numbers."""
    # file names and sizes only: a row per file
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("pid", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("base", base).select("path", "base").repartition(fan_out(files), "path")

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with open_input(path) as stream:
                    shard = WaveletMatrix(stream)
                    tokens = shard.tokens().astype("<u4", copy=False)
                    shard.counts, shard.doc_ids  # read while the file is open
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                ids = pa.array([None if d == -(1 << 63) else d for d in shard.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + first), pa.array(shard.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
