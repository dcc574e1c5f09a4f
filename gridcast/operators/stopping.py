"""Early stopping as a composition of functions over blocks.

What a block of a series does depends on the state in which it is entered: the best value so far and where it came
from. Only the first row that improves on that best matters, and from there on the block's course is its own. So a
block is a step function of the entry best: for each row that can be the first improvement, the best and its place at
the block's end, or the place where patience ran out. Functions of neighbouring blocks compose to one of the same kind,
a few blocks at a time and level by level; the whole series is then one function, asked at the start.

The best is never more than ``min_delta`` above the minimum of all rows before, so a function needs no more steps than
its block has new minima within ``min_delta`` of that minimum, and one below.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.operators.ordered import BLOCK, SLOT, before, block_summaries, join_summary, ordered_blocks
from gridcast.scratch import broadcast_if_small, materialise

FAN = 32  # functions composed in one step
STEPS = "values array<double>, places array<bigint>, best array<double>, at array<bigint>, stop array<bigint>"


class Course:
    """A step function: entered with a best b, the first of the falling ``values`` that is better by more than min_delta is
    the first improvement, at its place; ``best`` and ``at`` are those at the end, or those that stood when patience ran out at
    ``stop`` (-1: it did not)."""

    def __init__(self, values, places, best, at, stop):
        self.values, self.best = np.asarray(values, float), np.asarray(best, float)
        self.places, self.at, self.stop = (np.asarray(x, np.int64) for x in (places, at, stop))

    def columns(self) -> dict[str, np.ndarray]:
        return {"values": self.values, "places": self.places, "best": self.best, "at": self.at, "stop": self.stop}


def first_better(falling: np.ndarray, best: np.ndarray, min_delta: float) -> np.ndarray:
    """For each best the index of the first of some falling values with best - value > min_delta; their number where
    none is. Differences are rounded, so the place found for best - min_delta is corrected by comparing them."""
    n = len(falling)
    at = np.searchsorted(-falling, min_delta - best, side="right")
    better = lambda i: (i >= 0) & (i < n) & (best - falling[np.clip(i, 0, max(0, n - 1))] > min_delta) if n else np.zeros(len(best), bool)
    while (back := better(at - 1)).any():
        at = at - back
    while (on := (at < n) & ~better(at)).any():
        at = at + on
    return at


def course_of(values: np.ndarray, places: np.ndarray, low: float | None, lag: int, min_delta: float) -> Course:
    """The function of a block from its rows in order. ``low`` is the minimum before it, None for a first block, which
    is only ever entered without a best."""
    running = np.minimum.accumulate(values)
    record = np.r_[True, running[1:] < running[:-1]][: len(values)]
    v, p = values[record], places[record]
    n = len(v)
    follow = first_better(v, v, min_delta)
    last = follow == n
    # the row after which patience runs out before the next improvement; the last improvement of the block is open
    over = ~last & (p[np.minimum(follow, n - 1)] > p + lag)
    end = np.where(last | over, np.arange(n), follow)
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    reach = 1 if low is None else int(first_better(v, np.array([low]), min_delta)[0]) + 1
    own = end[:reach]
    return Course(v[:reach], p[:reach], v[own], p[own], np.where(over[own], p[own] + lag, -1))


def composed(courses: list[Course], lag: int, min_delta: float) -> Course:
    """One function for blocks that follow one another."""
    out = courses[-1]
    for f in reversed(courses[:-1]):
        at = first_better(out.values, f.best, min_delta)
        meets = (f.stop < 0) & (at < len(out.values))
        to = np.minimum(at, max(0, len(out.values) - 1))
        if len(out.values):
            late = meets & (out.places[to] > f.at + lag)
            goes = meets & ~late
            best, place = np.where(goes, out.best[to], f.best), np.where(goes, out.at[to], f.at)
            stop = np.where(goes, out.stop[to], np.where(late, f.at + lag, f.stop))
        else:
            best, place, stop = f.best, f.at, f.stop
        out = Course(*(np.r_[a, b] for a, b in ((f.values, out.values), (f.places, out.places), (best, out.best), (place, out.at), (stop, out.stop))))
    return out


def _row(keys: list[str], key: tuple, block: int, course: Course) -> dict:
    return {**dict(zip(keys, key)), BLOCK: block, **course.columns()}


def _courses(rows: DataFrame, keys: list[str], lag: int, min_delta: float) -> DataFrame:
    """(keys, block, the block's function) from (keys, block, slot, value, place, low)."""

    def run(batches):
        held: list[pd.DataFrame] = []
        last = None

        def done():
            part = pd.concat(held) if len(held) > 1 else held[0]
            low = part["_low"].iloc[0]
            course = course_of(part["_v"].to_numpy(), part["_pos"].to_numpy(), None if pd.isna(low) else float(low), lag, min_delta)
            return _row(keys, last[:-1], last[-1], course)

        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            group = pdf.groupby([*keys, BLOCK], sort=False, dropna=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            heads = pdf[[*keys, BLOCK]].iloc[starts].astype(object)
            heads = [tuple(None if pd.isna(x) else x for x in h) for h in heads.itertuples(index=False)]
            for head, lo, hi in zip(heads, starts, np.r_[starts[1:], len(pdf)]):
                if head != last and held:
                    out.append(done())
                    held = []
                last = head
                held.append(pdf.iloc[lo:hi])
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([done()])

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(BLOCK, T.LongType()), *T.StructType.fromDDL(STEPS).fields])
    return rows.repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, SLOT).mapInPandas(run, schema)


def _level(courses: DataFrame, keys: list[str], lag: int, min_delta: float) -> DataFrame:
    """Every ``FAN`` neighbours composed. Functions that stand alone pass by."""
    schema = courses.schema
    grouped = courses.withColumn(BLOCK, F.floor(F.col(BLOCK) / FAN).cast("long"))
    sizes = grouped.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_order"), *[F.first(c).alias(c) for c in schema.names if c not in (*keys, BLOCK, "_order")])
    single = sizes.where("_n = 1").select(*schema.names)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        course = composed([Course(*x) for x in zip(*(pdf[c] for c in ("values", "places", "best", "at", "stop")))], lag, min_delta)
        key = tuple(None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0] for k in keys)
        return pd.DataFrame([{**_row(keys, key, pdf[BLOCK].iloc[0], course), "_order": pdf["_order"].iloc[0]}])[schema.names]

    same = F.lit(True)
    many = sizes.where("_n > 1").select(*[F.col(c).alias(f"_g_{c}") for c in (*keys, BLOCK)])
    for c in (*keys, BLOCK):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return single.unionByName(grouped.join(many, same, "left_semi").groupBy(*keys, BLOCK).applyInPandas(join, schema))


def stops(rows: DataFrame, keys: list[str], order: str, value: str, lag: int, min_delta: float, n_blocks: int | None = None) -> DataFrame:
    """(keys, ``order`` of the row at which patience ran out or NULL, best value by then) of every series: the best moves
    on a fall by more than ``min_delta``, and ``lag`` rows without one end the series. NULL and NaN are rows that improve
    nothing; a series of such rows alone has neither best nor stop."""
    clean = F.when(~F.isnan(value), F.col(value))
    blocks = ordered_blocks(rows.select(*keys, order, clean.alias("_v")), keys, [order], n_blocks)
    summary = block_summaries(blocks, keys, _min=F.min("_v"))
    carry = materialise(
        summary.select(
            *keys, BLOCK, (F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)) - F.col("_first")).alias("_start"),
            F.min("_min").over(before(keys)).alias("_low"), "_min",
        ),
        "carry",
    )
    placed = join_summary(blocks, carry.drop("_min"), keys).withColumn("_pos", F.col(SLOT) + F.col("_start"))
    # a row at or above all before it improves nothing, whatever the best
    able = placed.where(F.col("_v").isNotNull() & (F.col("_low").isNull() | (F.col("_v") < F.col("_low")))).drop("_start")
    courses = materialise(_courses(able.select(*keys, BLOCK, SLOT, "_v", "_pos", "_low"), keys, lag, min_delta).withColumn("_order", F.col(BLOCK)), "courses")
    most = (courses.agg(F.max(BLOCK)).first()[0] or 0) + 1
    while most > 1:
        courses, most = materialise(_level(courses, keys, lag, min_delta), "courses"), -(-most // FAN)
    first = lambda c: F.element_at(c, 1)
    known = courses.select(*keys, first("best").alias("_best"), F.when(first("stop") >= 0, first("stop")).otherwise(first("at") + lag).alias("_stop"))
    every = carry.select(*keys, F.lit(None).cast("double").alias("_best"), F.lit(None).cast("long").alias("_stop"))
    verdict = materialise(known.unionByName(every).groupBy(*keys).agg(F.max("_best").alias("_best"), F.max("_stop").alias("_stop"), F.count(F.lit(1)).alias("_n")).where("_n > 0"), "verdict")
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    match = lambda extra: _all([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + extra)
    at_stop = placed.join(broadcast_if_small(verdict.select(*named, "_stop")), match([F.col("_pos") == F.col("_stop")]))
    at_stop = at_stop.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(order).alias("stop"))
    return verdict.join(at_stop, match([]), "left").select(*keys, "stop", F.col("_best").alias("best"))


def _all(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
