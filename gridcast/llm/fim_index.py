"""Fill-in-the-middle with a piecewise-linear learned rank index.

The line ends of all texts of a batch are one rising array: rank of a line -> byte offset of its end. Segments with a
bounded error are fitted to all of it, and what a segment misses is stored per line as a small number. A cut after so
many lines is then a rank: the segment predicts its offset and the stored residual corrects it exactly, so offsets
need two bytes a line instead of eight, and no text is searched again for its cuts.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import documents_of, pieces

ERROR = 8192  # bytes by which a segment may miss a line end; residuals fit 16 bits with room for rounding
WINDOW = 64  # points that a segment tries to cover at first, then twice as many each time
MARKS = (b"<P>", b"<S>", b"<M>")
MARKED = re.compile(b"<[PSM]>")


@dataclass
class RankIndex:
    """rank -> offset: ``start`` (first rank), ``base`` (its offset) and ``slope`` of each segment, residuals by rank."""

    start: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.start, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.start[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of some ranks."""
        return self.predict(rank) + self.residual[rank]


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments over the rising ``offsets``, each as long as one line through its first point stays within ``error``
    of all its points: the slopes that do so form a cone, which narrows until it is empty."""
    n, lo, start, slope = len(offsets), 0, [], []
    while lo < n:
        low, high, hi, width = -np.inf, np.inf, lo + 1, WINDOW
        while hi < n:
            steps = np.arange(hi, min(n, hi + width)) - lo
            rise = offsets[hi:hi + width] - offsets[lo]
            lows = np.maximum.accumulate(np.maximum((rise - error) / steps, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / steps, high))
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(steps)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            hi += fits
            if fits < len(steps):
                break
            width *= 2
        start.append(lo)
        slope.append((low + high) / 2 if hi > lo + 1 else 0.0)
        lo = hi
    at = np.array(start, np.int64)
    index = RankIndex(at, offsets[at], np.array(slope), np.zeros(0, np.int16))
    missed = offsets - index.predict(np.arange(n))
    index.residual = missed.astype(np.int16 if error < 30_000 else np.int64)
    return index


def line_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that lie one after another in ``data``: the ends of their lines, each text's start in front of its
    own, and the rank of each start. A text's last line may lack its line feed."""
    feeds = np.flatnonzero(data == 10) + 1
    open_ = ends[ends > starts]
    lines = np.sort(np.concatenate([feeds, open_[data[open_ - 1] != 10]]))
    # an end that is also the next text's start stands before it
    rank = np.searchsorted(lines, starts, side="right") + np.arange(len(starts))
    return np.insert(lines, np.searchsorted(lines, starts, side="right"), starts), rank


@dataclass
class Cut:
    """A text as it was cut; ``middle`` is None if it stays plain."""

    lines: int
    form: str
    output: bytes
    prefix: bytes | None = None
    middle: bytes | None = None


def draws(seed: int, doc_id: int | None) -> list[int]:
    """h1 to h4 of a document; a null doc_id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def cut_all(texts: list[bytes], doc_ids: list[int | None], seed: int, fim_percent: int, spm_percent: int) -> Iterator[Cut]:
    data = b"".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = ends - np.diff(np.r_[0, ends])
    offsets, rank = line_ends(np.frombuffer(data, np.uint8), starts, ends)
    index = fit(offsets)
    lines = np.diff(np.r_[rank, len(offsets)]) - 1
    h = np.array([draws(seed, d) for d in doc_ids], np.int64).reshape(-1, 4)
    chosen = np.sort(h[:, :2] % (lines + 1)[:, None], axis=1)
    cuts = index.offset(rank[:, None] + chosen)
    for text, n, (_, _, h3, h4), (a, b) in zip(texts, lines.tolist(), h.tolist(), (cuts - starts[:, None]).tolist()):
        if not text or h3 % 100 >= fim_percent or MARKED.search(text):
            yield Cut(n, "plain", text)
            continue
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        p, s, m = MARKS
        if h4 % 100 < spm_percent:
            yield Cut(n, "spm", b"".join((s, suffix, p, prefix, m, middle)), prefix, middle)
        else:
            yield Cut(n, "psm", b"".join((p, prefix, s, suffix, m, middle)), prefix, middle)


def characters(part: bytes | None) -> int | None:
    return None if part is None else len(part.decode())


def transformed(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text).

    A text is cut after the smaller and the larger of two numbers of its ``n`` lines, drawn from ``seed`` and doc_id.
    ``form`` is plain for a text that is null or empty (n 0, output empty), that contains a mark, or that the draw
    leaves; else spm or psm. A row with a null doc_id draws as if it were empty text; repeated rows give repeated
    results; an empty table gives an empty one; other columns are not looked at. Rows need no exchange.
    """

    def rows(batches):
        for batch in batches:
            for lo, hi in pieces(batch):
                ids = batch.column("doc_id")[lo:hi]
                texts = [(t or "").encode() for t in batch.column("text")[lo:hi].to_pylist()]
                found = list(cut_all(texts, ids.to_pylist(), seed, fim_percent, spm_percent))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array([c.lines for c in found], pa.int64()), pa.array([c.form for c in found], pa.string()),
                        pa.array([characters(c.prefix) for c in found], pa.int64()), pa.array([characters(c.middle) for c in found], pa.int64()),
                        pa.array([c.output for c in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return documents_of(docs).mapInArrow(rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (form, output and any others) plus ``restored``, the exact text that each was made from. Null for a
    null output."""
    kept = outputs.columns
    form, output = F.col("form"), F.col("output")
    second = F.when(form == "psm", "<S>").otherwise("<P>")
    # parts hold no mark, so the first of each kind is the one that was set
    at_second, at_middle = F.instr(output, second), F.instr(output, F.lit("<M>"))
    one = F.substring(output, F.lit(4), at_second - 4)
    two = F.substring(output, at_second + 3, at_middle - at_second - 3)
    middle = F.substring(output, at_middle + 3, F.length(output))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return outputs.select(*[F.col(f"`{c}`") for c in kept], F.when(form == "plain", output).otherwise(whole).alias("restored"))


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs' digests in place of their texts."""
    back = restored(outputs)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
