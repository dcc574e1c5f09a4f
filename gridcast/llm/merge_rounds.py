"""BPE encoding and decoding by batched merge rounds in NumPy.

The symbols of many words lie in one flat array. A round looks up every adjacent pair in the sorted pair keys by
binary search, finds the lowest rank of each word, merges all places of that pair in all words at once, and looks up
again only the pairs next to a merge. Words that have no pair left drop out. A very long word would need a pass over
itself for each rank; its places wait in a queue by rank instead, and symbols are linked, so a merge costs what it
touches. A worker merges a word once and then gathers its ids.

The file's own normaliser and pre-tokeniser say what a word's parts are, except for plain Western words under one known
pattern, which are split by the same pattern here. Merging and decoding are done here.
"""
from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import documents_of, pieces

NONE = np.int32(np.iinfo(np.int32).max)  # no merge
LONG = 1024  # symbols of a word from which on its places wait by rank
CACHED = 400_000  # words a worker remembers; it starts anew beyond
BLOCK = 4 << 20  # bytes of one text in hand at once
WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
# fixed values: the pattern by which words of this make are split, white space dropped
BY_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for words of printable ASCII and Latin-1 letters, which NFC leaves as they are
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Merges:
    """The merge table: pair keys in order, and for each its rank."""

    def __init__(self, vocab: dict[str, int], rules: list[tuple[str, str]], prefix: str = ""):
        a = np.array([vocab[x] for x, _ in rules], np.int64)
        b = np.array([vocab[y] for _, y in rules], np.int64)
        self.made = np.array([vocab[x + y.removeprefix(prefix)] for x, y in rules], np.int32)
        self.base = max(vocab.values(), default=0) + 1
        keys = a * self.base + b
        # a rule given twice counts with the later rank, as in a table filled in order
        order = np.argsort(keys, kind="stable")
        last = np.r_[keys[order][1:] != keys[order][:-1], True] if len(keys) else np.zeros(0, bool)
        self.keys, self.rank = keys[order][last], order[last].astype(np.int32)
        # where no rule precedes one that makes a symbol of it, all places of a pair can be merged at once
        latest = np.full(self.base, -1, np.int64)
        np.maximum.at(latest, self.made, np.arange(len(rules)))
        self.ordered = bool((np.maximum(latest[a], latest[b]) < np.arange(len(rules))).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose symbols follow one another, and how many each word has."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        long = np.flatnonzero(lengths > LONG) if self.ordered else np.zeros(0, int)
        ends = np.cumsum(lengths)
        out = [(np.full(len(x), w), x) for w in long for x in [self._linked(symbols[ends[w] - lengths[w]:ends[w]].copy())]]
        if len(long):
            rest = ~np.isin(word, long)
            symbols, word = symbols[rest], word[rest]
        out += self._rounds(symbols.copy(), word)
        words, ids = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(lengths))

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at``."""
        found = np.full(len(at), NONE)
        inside = at + 1 < len(symbols)
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        found[inside] = self.ranks(symbols[at[inside]], symbols[at[inside] + 1])
        return found

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        rank = self._pairs(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), size)
            done = lowest == NONE
            if done.any():
                out.append((word[done], symbols[done]))
                symbols, word, rank, lowest = (x[~done] for x in (symbols, word, rank, lowest))
                continue
            at = np.flatnonzero(rank == lowest)
            if self.ordered:
                at = every_other(at, np.r_[False, at[1:] == at[:-1] + 1])
            else:  # the first place of each word
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            now = (np.cumsum(keep) - 1)[at]
            touched = np.zeros(len(symbols), bool)
            touched[now] = touched[np.maximum(now - 1, 0)] = True
            near = np.flatnonzero(touched)
            rank[near] = self._pairs(symbols, word, near)
        return out or [(np.zeros(0, np.int64), np.zeros(0, np.int32))]

    def _linked(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.r_[self.ranks(symbols[:-1], symbols[1:]), NONE]
        gone = np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            order = np.argsort(rank[at], kind="stable")
            for part in np.split(at[order], np.flatnonzero(np.diff(rank[at][order])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        heapq.heappush(queue, r)
                    waiting.setdefault(r, []).append(part)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = every_other(at, np.r_[False, after[at[:-1]] == at[1:]])
            right = after[at]
            symbols[at], gone[right], rank[right] = self.made[r], True, NONE
            after[at] = after[right]
            follows = after[at] < n
            before[after[at][follows]] = at[follows]
            near = np.unique(np.r_[at, before[at][before[at] >= 0]])
            has = after[near] < n
            rank[near] = NONE
            rank[near[has]] = self.ranks(symbols[near[has]], symbols[after[near[has]]])
            wait(near)
        return symbols[~gone]


def every_other(at: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Of places that overlap in a chain (``goes_on``: with the one before) the first, the third and so on."""
    i = np.arange(len(at))
    start = np.maximum.accumulate(np.where(goes_on, 0, i))
    return at[(i - start) % 2 == 0]


def _byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Known(dict):
    """Unit -> its number; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, unit) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Codec:
    """Encoding and decoding by a tokenizer file with a byte-level BPE model.

    Refused, as they would change the result: dropout, byte fallback, an unknown token, whole words kept unmerged, added
    tokens with conditions, decoders other than none and the byte-level one. Truncation and padding are not applied.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec.decode())
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        kind = json.loads(spec)
        model, added = kind["model"], kind.get("added_tokens") or []
        steps = (kind.get("pre_tokenizer") or {})
        steps = steps.get("pretokenizers", [steps])
        odd = [k for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        odd += [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        decoder = (kind.get("decoder") or {}).get("type")
        if model.get("type", "BPE") != "BPE" or odd or not steps[-1:] or steps[-1].get("type") != "ByteLevel" or decoder not in (None, "ByteLevel"):
            raise ValueError(f"not a plain byte-level BPE file: {odd or decoder or steps[-1:]}")
        vocab = model["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(vocab, rules, model.get("continuing_subword_prefix") or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=lambda s: (-len(s), s)))) + ")") if added else None
        suffix = model.get("end_of_word_suffix") or ""
        table = _byte_table()
        self.letters = [c for c, _ in sorted(table.items(), key=lambda x: x[1])]
        self.inner = np.full(512, -1, np.int32)
        self.final = np.full(512, -1, np.int32)
        for c in table:
            self.inner[ord(c)] = vocab.get(c, -1)
            self.final[ord(c)] = vocab.get(c + suffix, -1)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.joint = b"" if decoder else b" "
        spelled = (lambda t: bytes(map(table.__getitem__, t))) if decoder else str.encode
        self.names = {i: t.encode() if t in self.special else spelled(t) for i, t in names.items()}
        # words of such a file do not depend on what stands beside them
        shape = [s["type"] for s in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = shape == ["NFC", "Replace", "Lowercase"] and [s.get("pattern", {}).get("Regex") for s in steps] == [BY_WORD, None] and not any(WHITE.search(s.encode()) for s in self.special)
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def word_parts(self, word: str) -> list[str | int]:
        if not PLAIN.fullmatch(word) or self.specials and self.specials.search(word):
            return self.parts(word)
        found = PLAIN_PARTS.findall(word.lower())
        return found if word.isascii() else ["".join(map(self.letters.__getitem__, p.encode())) for p in found]

    def parts(self, text: str) -> list[str | int]:
        """A text's pre-tokens in byte-level spelling; ids of added tokens."""
        out: list[str | int] = []
        for k, piece in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(self.special[piece])
            elif piece:
                piece = self.normalizer.normalize_str(piece) if self.normalizer else piece
                out += [t for t, _ in self.splitter.pre_tokenize_str(piece)]
        return out

    def learn(self) -> None:
        """Merge the units that were met for the first time."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        units = [self.word_parts(u.decode()) for u in new] if self.by_word else [[u] for u in new]
        flat = [p for parts in units for p in parts]
        spelled = [chr(0) if isinstance(p, int) else p for p in flat]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        code = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        symbols = self.inner[code]
        symbols[ends - 1] = self.final[code[ends - 1]]
        fixed = np.array([i for i, p in enumerate(flat) if isinstance(p, int)], int)
        symbols[ends[fixed] - 1] = [flat[i] for i in fixed]
        # a byte that the vocabulary lacks has no symbol
        there = symbols >= 0
        sizes = np.diff(np.r_[0, np.cumsum(there)[ends - 1]]) if len(ends) else sizes
        ids, counts = self.merges.merge(symbols[there], sizes)
        per = np.fromiter(map(len, units), np.int64, len(units))
        upto = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(per)]]
        self.ids, self.counts = np.r_[self.ids, ids.astype(np.int32)], np.r_[self.counts, np.diff(upto)]

    def blocks(self, text: str) -> Iterator[list]:
        """The units of a text, some MB at a time."""
        if not self.by_word:
            yield self.parts(text)
            return
        data = text.encode()
        lo = 0
        while lo < len(data):
            cut = WHITE.search(data, min(len(data), lo + BLOCK))
            hi = cut.end() if cut else len(data)
            yield data[lo:hi].split()
            lo = hi

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        out, totals = [], []
        for text in texts:
            total = 0
            for units in self.blocks(text):
                if len(self.known) > CACHED:
                    self._settle(out)
                    self.forget()
                out.append(np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)))
                total += len(units)
            totals.append(total)
        counts = self._settle(out)
        ids = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int32)
        return ids, np.diff(np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(totals)]])

    def _settle(self, out: list) -> np.ndarray:
        """Replace the lists of unit numbers by (ids, ids per unit). Returns the latter of all lists."""
        self.learn()
        starts = np.cumsum(self.counts) - self.counts
        for i, units in enumerate(out):
            if isinstance(units, np.ndarray):
                n = self.counts[units]
                at = np.repeat(starts[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out[i] = (self.ids[at], n)
        return np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens' text, added ones included: joined by spaces, or by bytes if the file has a byte-level decoder.
        Ids without a token are passed over."""
        return self.joint.join([self.names[i] for i in ids if i in self.names]).decode(errors="replace")


@lru_cache(maxsize=1)
def codec(spec: bytes) -> Codec:
    return Codec(spec)


def encoded(docs: DataFrame, tokenizer_path: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs`` (doc_id, text), with ``decode`` also ``decoded``, the text that
    the ids give back. No special tokens are added; those spelled out in a text count as such.

    A null or empty text has no ids. Repeated rows and rows with a null doc_id stand for themselves; an empty table
    gives an empty one; other columns are not looked at. Rows need no exchange.
    """
    spec = Path(tokenizer_path).read_bytes()

    def rows(batches):
        c = codec(spec)
        for batch in batches:
            for lo, hi in pieces(batch):
                ids, counts = c.encode([t or "" for t in batch.column("text")[lo:hi].to_pylist()])
                ends = np.r_[0, np.cumsum(counts)]
                columns = [batch.column("doc_id")[lo:hi], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    columns.append(pa.array([c.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return documents_of(docs).mapInArrow(rows, "doc_id bigint, ids array<int>" + ", decoded string" * decode)


def decoded(ids: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, decoded string) per row of (doc_id, ids array<int>); null ids count as none."""
    spec = Path(tokenizer_path).read_bytes()

    def rows(batches):
        c = codec(spec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(rows, "doc_id bigint, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
