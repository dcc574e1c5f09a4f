"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words. Among all document rates that meet the targets, the ones nearest to "each
document once" in relative entropy are exp(lambda_source * size), held at the most copies allowed. The convex dual
has one unknown per source; Newton steps run over a table of (source, size, count), all sources at once. Rates
are rounded to whole copies by a hash of the row, and per source one common shift of the rounding threshold makes the
words taken meet the target up to a single document.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridcast.llm.circulant import numbered
from gridcast.llm.common import documents_of, shielded, stored, words_of
from gridcast.operators.ordered import ordinal_rank
from gridcast.scratch import broadcast_if_small

STEPS = 60  # a safeguard: each step halves a bracket at least, about eight are needed
EXACT = 1e-9  # relative distance from a target at which a source's rates are done
BINS, LEVELS = 1024, 3  # the shift is found to 2 / BINS**LEVELS


TOSSES = 1 << 52


def sizes_of(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, source, text_hash, size): words of every text, 0 for null. With ``rows``, also ``row``."""
    kept = ["doc_id", "source", "text_hash", *["row"] * rows]

    def count(batches):
        for batch in batches:
            n = [len(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "size"])

    base = documents_of(docs, F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), *["row"] * rows)
    return base.mapInArrow(count, "doc_id bigint, source string, text_hash bigint" + ", row bigint" * rows + ", size bigint")


def told_apart(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``copy``: rows equal in doc_id, source and text are counted from 0, all others have 0."""
    key = ["doc_id", "source", "text_hash"]
    more = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    more = stored(more.select(*[F.col(c).alias(f"_{c}") for c in key]), "repeated")
    if more.isEmpty():
        return sizes.withColumn("copy", F.lit(0).cast("long"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    more = broadcast_if_small(more)
    order = ["row"] if "row" in sizes.columns else []
    some = ordinal_rank(sizes.join(more, same, "left_semi"), key, order, "copy")
    return sizes.join(more, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(some)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """(source, sid, source_size, target): sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source, and what is left over is shared again."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = ordinal_rank(totals.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        used, left = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not left or (total - used) / left <= level:
            break
        level = (total - used) / left
    return ranked.select("source", "sid", "n", "source_size", F.least("cap", F.lit(max(level, 0.0)) * F.col("weight") if left else F.col("cap")).alias("target"))


def rate(most: int):
    """A document's rate; ``lam`` is null where every document is taken as often as allowed, or never."""
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(most))).otherwise(
        F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
    )


def capped(most: int):
    return F.least(rate(most), F.lit(float(most)))


def solve(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Newton steps on the dual, within a bracket. Adds ``mean`` and ``lam`` to the sources."""
    table = stored(sizes.where("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("c")), "histogram")
    ratio = F.col("target") / F.col("source_size")
    open_ = (F.col("target") > 0) & (ratio < most * (1 - EXACT))
    none = F.lit(None).cast("double")
    state = sources.withColumn("mean", F.greatest(F.col("source_size"), F.lit(1)) / F.greatest(F.col("n"), F.lit(1)))
    state = state.select("sid", "source_size", "target", "mean", F.when(open_, F.log(ratio)).alias("lam"), none.alias("low"), none.alias("high"), F.lit(1.0).alias("gap"))
    state = stored(state, "newton")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        words = F.col("c") * F.col("size")
        free = rate(most) < most
        joined = table.join(broadcast_if_small(state.where("lam IS NOT NULL AND gap > 0")), "sid")
        sums = joined.groupBy("sid").agg(F.sum(words * capped(most)).alias("f"), F.sum(F.when(free, words * x * rate(most)).otherwise(0.0)).alias("df"))
        new = state.join(sums, "sid", "left")
        miss = F.log(F.col("f") / F.col("target"))
        low = F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - miss * F.col("f") / F.col("df")
        inside = (F.col("df") > 0) & (F.col("l2").isNull() | (newton > F.col("l2"))) & (F.col("h2").isNull() | (newton < F.col("h2")))
        fallback = F.when(F.col("l2").isNull(), F.col("h2") - 1 - F.abs("h2")).when(F.col("h2").isNull(), F.col("l2") + 1 + F.abs("l2")).otherwise((F.col("l2") + F.col("h2")) / 2)
        done = F.col("f").isNull() | (F.abs(miss) < EXACT)
        new = new.withColumns({"l2": low, "h2": high})
        state = stored(new.select("sid", "source_size", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(fallback).alias("lam"), F.col("l2").alias("low"), F.col("h2").alias("high"), F.when(done, 0.0).otherwise(F.abs(miss)).alias("gap")), "newton")
        if not (state.agg(F.max("gap")).first()[0] or 0):
            break
    return state.select("sid", "source_size", "target", "mean", "lam")


def shifts(rated: DataFrame) -> DataFrame:
    """(sid, shift): documents with key < shift get a copy more, so that the words taken come nearest the target."""
    state = rated.groupBy("sid").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need")).select("sid", "need", F.lit(-1.0).alias("lo"))
    width = 2.0
    rows = rated.select("sid", "key", "size")
    for _ in range(LEVELS):
        state = stored(state, "shift")
        inside = rows.join(broadcast_if_small(state), "sid").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + width))
        width /= BINS
        bins = inside.groupBy("sid", F.floor((F.col("key") - F.col("lo")) / width).alias("bin")).agg(F.sum("size").alias("w"))
        w = Window.partitionBy("sid").orderBy("bin")
        upto = bins.withColumn("upto", F.sum("w").over(w)).join(broadcast_if_small(state), "sid")
        # the bin in which the sum passes what is needed; whole bins before it are taken
        upto = upto.where(F.col("upto") <= F.col("need")).groupBy("sid").agg(F.max("bin").alias("bin"), F.max("upto").alias("done"))
        state = state.join(upto, "sid", "left").select("sid", (F.col("need") - F.coalesce("done", F.lit(0))).alias("need"), (F.col("lo") + (F.coalesce("bin", F.lit(-1)) + 1) * width).alias("lo"))
    state = stored(state, "shift")
    last = rows.join(broadcast_if_small(state), "sid").where((F.col("key") >= F.col("lo")) & (F.col("size") > 0))
    # the next key of all that follow; it is taken too if that comes nearer
    nearest = last.groupBy("sid").agg(F.min("key").alias("next"), F.min_by("size", "key").alias("w"))
    return state.join(nearest, "sid", "left").select("sid", F.when((F.col("w") / 2 <= F.col("need")), F.col("next") + 1 / float(TOSSES)).otherwise(F.col("lo")).alias("shift"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1, rows: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) for each row of ``docs`` (doc_id, text, source).

    ``taken`` is copies * size, at most ``most`` times the size. A null text has size 0; so has an empty one. A
    null source is a source like others, last in order. Rows are rounded apart, also where doc_id is null or shared and
    where whole rows repeat. The result depends on rows and ``seed`` alone, not on partitions. With ``rows``, ``docs``
    is ``numbered`` and the result has ``row``.
    """
    sizes = told_apart(stored(sizes_of(docs, rows), "sizes"))
    toss = F.pmod(F.xxhash64("doc_id", "text_hash", "source", "copy", F.lit(seed)), F.lit(TOSSES)) / float(TOSSES)
    own = ["doc_id", *["row"] * rows]
    sizes = stored(sizes.select(*own, "source", "size", toss.alias("toss")), "tossed")
    found = targets(sizes, weights, share, most)
    found = stored(found, "targets")
    by_source = sizes.join(broadcast_if_small(found.select(F.col("source").alias("_s"), "sid")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    state = solve(by_source, found, most)
    rated = by_source.join(broadcast_if_small(state), "sid").withColumn("rate", capped(most))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("key", F.col("toss") - (F.col("rate") - F.col("base")))
    # a document at the limit gets no further copy
    rated = stored(rated.withColumn("key", F.when(F.col("base") >= most, F.lit(None)).otherwise(F.col("key"))), "rated")
    shift = shifts(rated.where("lam IS NOT NULL AND target > 0"))
    out = rated.join(broadcast_if_small(shift), "sid", "left")
    copies = (F.col("base") + F.coalesce((F.col("key") < F.col("shift")).cast("long"), F.lit(0))).alias("copies")
    return out.select(*own, "size", "source_size", "target", "rate", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with all its columns. Rows are told apart by number."""
    own, back = shielded(docs, "doc_id", "text", "source")
    own = numbered(own)
    taken = mix_sources(own, rows=True, **options).where("copies > 0").select(F.col("row").alias("_row"), "copies")
    out = own.join(taken, F.col("row") == F.col("_row"))
    return back(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
