"""Language identification by n-gram filters whose cells are bitmasks of languages.

One Bloom filter per language, stored bit-sliced: cell i holds bit i of every language's filter, so two look-ups and
an AND give all languages that have an n-gram. A text's hits are counted per language, corrected for the share of
cells that are set by chance, and the language with the largest corrected share wins.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import U64, documents_of, mix, pieces

PER_LANGUAGE = 2000  # the fit reads about so many documents of a language
LEAST_SHARE = 0.003  # of a language's documents in which an n-gram must occur
CELLS = 1 << 18
GRAM = 4  # bytes
NONE = "und"
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Every GRAM bytes in a row of the lower-case text, non-letters as single spaces, as numbers."""
    words = b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" "
    b = np.frombuffer(words, np.uint8).astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    out = b[:n].copy()
    for i in range(1, GRAM):
        out |= b[i:n + i] << np.uint32(8 * i)
    return out


def cells(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(g.astype(U64))
    return (h & U64(CELLS - 1)).astype(np.int64), (h >> U64(40) & U64(CELLS - 1)).astype(np.int64)


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # uint64, a row of cells for every 64 languages, in each cell a bit per language
    chance: list[float] = field(default_factory=list)  # that an n-gram a language lacks is found in it

    def shares(self, text: str) -> np.ndarray:
        """Corrected share of the text's n-grams that each language has."""
        g = grams(text)
        a, b = cells(g)
        counts = []
        for k, masks in enumerate(self.masks):
            hit = masks[a] & masks[b]
            m = min(64, len(self.langs) - 64 * k)
            if m <= 12:
                n = np.bincount(hit.astype(np.int64), minlength=1 << m)
                sets = np.arange(len(n))
                counts += [n[(sets >> i) & 1 == 1].sum() for i in range(m)]
            else:
                counts += [((hit >> U64(i)) & U64(1)).sum() for i in range(m)]
        chance = np.array(self.chance)
        return np.clip((np.array(counts, float) / max(1, len(g)) - chance) / (1 - chance), 0, 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from the text and non-null lang of ``docs``. A language with more than ``per_language`` documents is
    sampled by the hash of doc_id and text to about that number (exact copies of a row are taken all or none); n-grams
    are counted by Spark over the sample, and one that is in fewer than ``LEAST_SHARE`` of a language's documents is left
    out."""
    base = documents_of(docs, F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = {r.lang: r.n for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    masks = np.zeros((-(-len(langs) // 64), CELLS), U64)
    if not langs:
        return Filters([], masks)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / totals[k]))])
    toss = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    sample = base.where(toss < share[F.col("lang")])

    def count(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    found.setdefault(lang, []).append(np.unique(grams(text)))
        for lang, parts in found.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    kept = F.create_map(*[F.lit(x) for k in langs for x in (k, LEAST_SHARE * min(totals[k], per_language))])
    counted = sample.select("lang", "doc_id", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # bounded by the sample: at most as many n-grams as its texts have
    frequent = counted.where(F.col("n") >= kept[F.col("lang")]).select("lang", "gram").toPandas()
    bit = lambda i: U64(1 << i % 64)
    for i, lang in enumerate(langs):
        a, b = cells(frequent.loc[frequent["lang"] == lang, "gram"].to_numpy().astype(np.uint32))
        masks[i // 64, a] |= bit(i)
        masks[i // 64, b] |= bit(i)
    chance = [float(((masks[i // 64] & bit(i)) > 0).mean() ** 2) for i in range(len(langs))]
    return Filters(langs, masks, chance)


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language whose filter has the largest corrected share of the text's
    n-grams, and that share. Ties go to the smaller name. ``und`` with score 0 where the text is null or has no letter,
    or no language was learned."""
    base = documents_of(docs)

    def rows(batches):
        for batch in batches:
            for lo, hi in pieces(batch, limit=1 << 20):
                names, scores = [], []
                for text in batch.column("text")[lo:hi].to_pylist():
                    if model.langs and has_letter(text):
                        s = model.shares(text)
                        names.append(model.langs[int(s.argmax())])
                        scores.append(float(s.max()))
                    else:
                        names.append(NONE)
                        scores.append(0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return base.mapInArrow(rows, "doc_id bigint, lang_pred string, score double")
