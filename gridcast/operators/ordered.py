"""Ordered operators that never put one group into one task.

``ordered_blocks`` range-partitions by (keys, order), sorts, and writes the result once. Every key is then a
run of consecutive blocks, so an ordered computation is: something inside a block, plus a carry computed on
one summary row per (key, block). A key holding a third of the table simply spans a third of the blocks.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridcast.scratch import broadcast_if_small, materialise

BLOCK = "_block"
SLOT = "_slot"


def ordered_blocks(
    df: DataFrame, keys: list[str], order: list[str], n_blocks: int | None = None, fold=None, folded: str = "",
    kept: list[str] | None = None, arrow: bool = False,
) -> DataFrame:
    """``df`` plus ``_block`` (BIGINT) and ``_slot`` (order inside the block). ``fold`` maps the sorted batches
    of one block to batches with the extra columns declared in ``folded``, in the same pass; they are pandas frames, or
    Arrow batches with ``arrow``. Of ``df`` only the columns ``kept`` go on after the sort, all if it is None.

    Rows equal in ``keys + order`` are interchangeable. They are split by input partition, so that copies of
    one row do not end in one block; rows of one input partition stay together, which keeps the placement the
    same when a task is repeated. Without ``n_blocks`` AQE sizes the blocks.
    """
    sort_keys = [*keys, *order]
    tagged = df.withColumn("_pid", F.spark_partition_id())
    ranges = [*sort_keys, "_pid"]
    spread = tagged.repartitionByRange(n_blocks, *ranges) if n_blocks else tagged.repartitionByRange(*ranges)
    placed = spread.drop("_pid").sortWithinPartitions(*sort_keys)
    columns = df.columns if kept is None else kept
    placed = placed.select(*columns)
    if fold is not None:
        extra = StructType.fromDDL(folded)
        placed = (placed.mapInArrow if arrow else placed.mapInPandas)(fold, StructType(placed.schema.fields + extra.fields))
        columns = placed.columns
    placed = placed.withColumn("_mid", F.monotonically_increasing_id())
    return materialise(placed, "blocks").select(
        *columns,
        F.shiftright("_mid", 33).alias(BLOCK),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias(SLOT),
    )


def blocks_for(df: DataFrame, mb: int = 64) -> int | None:
    """Blocks for rows that are worked on while they are sorted: as many as the session runs at once at least, as
    small tables would else go to one core; more by size. None (AQE decides) where Spark knows no size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, size // (mb << 20)) if size < 1 << 50 else None


def block_summaries(blocks: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """One row per (keys, block); at most (number of blocks + number of groups) rows in all."""
    summary = blocks.groupBy(*keys, BLOCK).agg(
        F.min(SLOT).alias("_first"), F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in aggregates.items()]
    )
    return materialise(summary, "summary")


def before(keys: list[str]) -> Window:
    """All earlier blocks of the same key."""
    return (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )


def join_summary(blocks: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a carry to its block's rows: broadcast when counted small, shuffled otherwise."""
    on = [BLOCK, *keys]
    right = broadcast_if_small(carry.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in carry.columns if c not in on]))
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return blocks.join(right, condition, "left").drop(*[f"_r_{c}" for c in on])


def ordinal_rank(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", n_blocks: int | None = None
) -> DataFrame:
    """``df`` plus the 0-based position of each row in its group, ties resolved by the later ``order``
    columns."""
    blocks = ordered_blocks(df, keys, order, n_blocks)
    carry = block_summaries(blocks, keys).withColumn(
        "_start", F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)) - F.col("_first")
    )
    ranked = join_summary(blocks, carry.drop("_first", "_rows"), keys)
    return ranked.select(*df.columns, (F.col(SLOT) + F.col("_start")).alias(name))


def value_at_rank(df: DataFrame, keys: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Order statistics: for every group one column per entry of ``positions``, each an expression over
    ``n`` (rows of the group) giving a 0-based rank. Equal values are counted first, so a value that fills
    most of a table (zero rain) stays one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    blocks = ordered_blocks(counts, keys, [value])
    carry = block_summaries(blocks, keys, _total=F.sum("_c"))
    carry = carry.withColumn("_start", F.coalesce(F.sum("_total").over(before(keys)), F.lit(0))).withColumn(
        "n", F.sum("_total").over(Window.partitionBy(*(keys or [F.lit(0)])))
    )
    wanted = carry.select(
        *keys, BLOCK, "n", "_start", (F.col("_start") + F.col("_total")).alias("_stop"),
        *[p.cast("long").alias(f"_p_{name}") for name, p in positions.items()],
    )
    hit = F.lit(False)
    for name in positions:
        hit = hit | ((F.col(f"_p_{name}") >= F.col("_start")) & (F.col(f"_p_{name}") < F.col("_stop")))
    # only blocks that hold a wanted rank go on: a handful per group
    rows = join_summary(blocks, wanted.where(hit).drop("_stop"), keys).where(F.col("n").isNotNull())
    inside = Window.partitionBy(*keys, BLOCK).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_lo", F.coalesce(F.sum("_c").over(inside), F.lit(0)) + F.col("_start"))
    picked = [
        F.max(F.when((F.col(f"_p_{name}") >= F.col("_lo")) & (F.col(f"_p_{name}") < F.col("_lo") + F.col("_c")), F.col(value))).alias(name)
        for name in positions
    ]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def percentile_linear(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The exact percentile with linear interpolation between neighbours."""
    at = F.lit(q) * (F.col("n") - 1)
    stats = value_at_rank(df, keys, value, {"_below": F.floor(at), "_above": F.ceil(at)})
    part = at - F.floor(at)
    return stats.select(*keys, (F.col("_below") + (F.col("_above") - F.col("_below")) * part).alias(name))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, name: str = "ema") -> DataFrame:
    """Exponential moving average ``s = d*s + (1-d)*x`` seeded with each series' first value.

    The recurrence is linear, so a block needs only its own values and the state at its start:
    ``s = local + d**step * start``. Blocks are folded in the sorting pass, batch by batch.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError(f"decay must be in (0, 1), got {decay}")

    def fold(batches):
        last, state, step = None, 0.0, 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            group, last, goes_on = _runs(pdf, keys, last)
            at = np.arange(n)
            place = at - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
            # sums over 1, 2, 4, ... values of a series, all series of the batch at once
            local, width = pdf[value].to_numpy(dtype=float) * (1.0 - decay), 1
            while width <= place.max():
                local[width:] += np.where(place[width:] >= width, decay**width * local[:-width], 0.0)
                width *= 2
            steps = place + 1
            if goes_on:
                head = group == group[0]
                local[head] += state * decay ** steps[head].astype(float)
                steps[head] += step
            state, step = local[-1], steps[-1]
            yield pdf.assign(_local=local, _step=steps)

    blocks = ordered_blocks(df, keys, order, fold=fold, folded="_local double, _step bigint")
    summary = block_summaries(
        blocks, keys, _seed=F.min_by(F.col(value).cast("double"), SLOT), _last=F.max_by("_local", SLOT)
    ).withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*(keys or [F.lit(0)]))))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        states, state = [], pdf["_seed"].iloc[0]
        for rows, last in zip(pdf["_rows"], pdf["_last"]):
            states.append(state)
            state = state * decay**rows + last
        return pdf.assign(_state=states)[[*keys, BLOCK, "_state"]]

    # a block border cuts at most one series, so at most n_blocks series need chaining
    cut = summary.where(F.col("_blocks") > 1)
    whole = summary.where(F.col("_blocks") == 1).select(*keys, BLOCK, F.col("_seed").alias("_state"))
    schema = StructType([summary.schema[c] for c in [*keys, BLOCK]] + [StructField("_state", DoubleType())])
    carry = materialise(whole.unionByName(cut.groupBy(*keys).applyInPandas(chain, schema)), "carry")
    # the seed is also the first value: d*x0 + (1-d)*x0 = x0
    return join_summary(blocks, carry, keys).select(
        *df.columns, (F.col("_local") + F.col("_state") * F.pow(F.lit(decay), F.col("_step"))).alias(name)
    )


def _runs(pdf: pd.DataFrame, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple, bool]:
    """For one sorted batch: the group number of each row, the last row's key, and whether the first row goes on
    with the key ``last`` of the batch before."""
    if not keys:
        return np.zeros(len(pdf), int), (), last is not None
    key_at = lambda i: tuple(None if pd.isna(v) else v for v in pdf[keys].iloc[i])
    return pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(), key_at(-1), key_at(0) == last


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` plus ``running_<value>``, the inclusive prefix sum of each value; a NULL adds nothing.

    Prefixes inside a block are taken in the sorting pass; afterwards a carry per block is added.
    """
    whole = {v: df.schema[v].dataType.typeName() in ("long", "integer", "short", "byte") for v in values}

    def fold(batches):
        last, state = None, dict.fromkeys(values, 0)
        for pdf in batches:
            if not len(pdf):
                continue
            group, key, goes_on = _runs(pdf, keys, last)
            extra = {}
            for v in values:
                x = pdf[v].fillna(0).astype("int64" if whole[v] else "float64")
                total = x.groupby(group).cumsum().to_numpy()
                if goes_on:
                    total[group == group[0]] += state[v]
                extra[f"_p_{v}"] = total
                state[v] = total[-1]
            last = key
            yield pdf.assign(**extra)

    kinds = ", ".join(f"`_p_{v}` {'bigint' if whole[v] else 'double'}" for v in values)
    blocks = ordered_blocks(df, keys, order, fold=fold, folded=kinds)
    summary = block_summaries(blocks, keys, **{f"_t_{v}": F.max_by(f"_p_{v}", SLOT) for v in values})
    carry = summary.select(*keys, BLOCK, *[F.coalesce(F.sum(f"_t_{v}").over(before(keys)), F.lit(0)).alias(f"_t_{v}") for v in values])
    rows = join_summary(blocks, carry, keys)
    return rows.select(*df.columns, *[(F.col(f"_p_{v}") + F.col(f"_t_{v}")).alias(f"running_{v}") for v in values])


def prefix_records(df: DataFrame, keys: list[str], order: list[str], value: str, n_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows with their 0-based ``_pos``, and those of them strictly below everything before them in
    their group. Both come from one sort."""
    blocks = ordered_blocks(df, keys, order, n_blocks)
    summary = block_summaries(blocks, keys, _low=F.min(value))
    carry = summary.select(
        *keys, BLOCK,
        (F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)) - F.col("_first")).alias("_start"),
        F.min("_low").over(before(keys)).alias("_low"),
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_summary(blocks, carry, keys).withColumn("_pos", F.col(SLOT) + F.col("_start"))
    rows = placed.withColumn("_best", F.least(F.min(value).over(inside), F.col("_low")))
    records = rows.where(F.col("_best").isNull() | (F.col(value) < F.col("_best")))
    return placed.select(*df.columns, "_pos"), records.select(*df.columns, "_pos")


def previous_row(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "previous") -> DataFrame:
    """``lag(value)`` without a whole group in one task: inside a block in the sorting pass, from the last row of
    the block before otherwise. The value travels as text there, so that any type and NULL survive."""

    def fold(batches):
        last, end = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            group, key, goes_on = _runs(pdf, keys, last)
            text = pdf["_text"].astype(object)
            lag = text.groupby(group).shift(1)
            start = np.r_[True, group[1:] != group[:-1]]
            if goes_on:
                lag.iloc[0] = end
                start[0] = False
            last, end = key, text.iloc[-1]
            yield pdf.assign(_lag=lag.where(lag.notna(), None), _head=start)

    kind = df.schema[value].dataType
    tagged = df.withColumn("_text", F.col(value).cast("string"))
    blocks = ordered_blocks(tagged, keys, order, fold=fold, folded="_lag string, _head boolean")
    summary = block_summaries(blocks, keys, _end=F.max_by(F.struct("_text"), SLOT))
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK)
    carry = summary.select(*keys, BLOCK, F.lag("_end").over(ordered)["_text"].alias("_carry"))
    rows = join_summary(blocks, carry, keys)
    return rows.select(*df.columns, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_lag")).cast(kind).alias(name))


def last_known(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with each NULL of the whole numbers ``value`` replaced by the largest one before it. For values that
    grow in ``order`` this is the last one before it."""
    least = -(1 << 63)

    def fold(batches):
        high = least
        for pdf in batches:
            if len(pdf):
                seen = np.maximum.accumulate(np.r_[high, pdf["_filled"].to_numpy(dtype=np.int64)])
                high = seen[-1]
                yield pdf.assign(_high=seen[1:])

    filled = df.withColumn("_filled", F.coalesce(F.col(value).cast("long"), F.lit(least))).drop(value)
    blocks = ordered_blocks(filled, [], order, fold=fold, folded="_high bigint")
    summary = block_summaries(blocks, [], _top=F.max("_high"))
    carry = summary.select(BLOCK, F.max("_top").over(before([])).alias("_carry"))
    rows = join_summary(blocks, carry, [])
    found = F.greatest("_high", "_carry")
    return rows.select(*[c for c in df.columns if c != value], F.when(found > least, found).alias(value))


def first_per_group(df: DataFrame, keys: list[str], order: list, k: int, n_salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in ``order``. A first pass keeps k rows per (group, salt), so the
    last pass sees at most k * n_salts rows of a group however large it is. The salt is the input
    partition: copies of one row spread as evenly as the files do."""
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(n_salts)))
    narrow = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(narrow)).where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= k)
        .drop("_salt", "_rn")
    )
