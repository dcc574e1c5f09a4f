"""Forecast verification: pair forecasts with truth, reduce to sums once, derive the scores."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast import dims
from gridcast.functions.rows import unpack
from gridcast.functions.columns import exceeds
from gridcast.operators.ordered import BLOCK, SLOT, before, blocks_for, join_summary, ordered_blocks, ordinal_rank
from gridcast.scratch import materialise

SCORES = (
    "rmse", "mae", "mse", "bias", "r2", "pearson", "csi", "pod", "far", "ets",
    "rain_f1", "rain_accuracy", "heavy_f1", "heavy_rmse",
)
MERGE_PARTS = 256  # parts in which the cells of a scope meet first


def _scopes() -> Column:
    """The three scopes a row counts in."""
    sensor, site = F.col("sensor_id").cast("int"), F.col("site_id").cast("long")
    nothing = F.lit(None)
    triples = [("all", nothing.cast("int"), nothing.cast("long")), ("sensor", sensor, nothing.cast("long")), ("site", nothing.cast("int"), site)]
    return F.array(*[F.struct(F.lit(s).alias("scope"), a.alias("sensor_id"), b.alias("site_id")) for s, a, b in triples])


def pair_pixels(pred: DataFrame, truth: DataFrame, uid: str = "uid") -> DataFrame:
    """Join forecasts (uid, pred) and truth (uid, target, ...) on the sample, then zip the grids. The
    shuffle moves one row per sample; pixels appear only after it. A sample on one side only fails; see
    :func:`pair_faults` for a list, with repeated samples."""
    joined = pred.join(truth, uid, "full")
    lone = F.raise_error(F.concat(F.lit("no partner for "), F.coalesce(F.col(uid).cast("string"), F.lit("NULL"))))
    both = F.col("pred").isNotNull() & F.col("target").isNotNull()
    joined = joined.withColumn("pred", F.when(both, F.col("pred")).otherwise(lone.cast(joined.schema["pred"].dataType)))
    kinds = [joined.schema[c].dataType.elementType.simpleString() for c in ("pred", "target")]
    size_ok = F.size("pred") == F.size("target")
    pairs = F.when(size_ok, F.arrays_zip("pred", "target")).otherwise(
        F.raise_error(F.concat(F.lit("shape mismatch for "), F.col(uid).cast("string"))).cast(
            f"array<struct<pred:{kinds[0]},target:{kinds[1]}>>"
        )
    )
    others = [c for c in joined.columns if c not in ("pred", "target")]
    out = unpack(joined, others, pairs, "pixel", "_pair")
    return out.select(*others, "pixel", F.col("_pair.pred").alias("pred"), F.col("_pair.target").alias("target"))


def pair_faults(pred: DataFrame, truth: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, fault): samples on one side only, repeated ones, and ones without a grid."""
    side = lambda df, c, n: df.groupBy(F.col(uid).alias(f"_{n}")).agg(F.count(F.lit(1)).alias(n), F.count(c).alias(f"{n}_full"))
    both = side(pred, "pred", "p").join(side(truth, "target", "t"), F.col("_p").eqNullSafe(F.col("_t")), "full")
    fault = (
        F.when(F.col("p").isNull(), "no forecast").when(F.col("t").isNull(), "no truth").when((F.col("p") > 1) | (F.col("t") > 1), "repeated")
        .when((F.col("p_full") == 0) | (F.col("t_full") == 0), "no grid")
    )
    return both.select(F.coalesce("_p", "_t").alias(uid), fault.alias("fault")).where(F.col("fault").isNotNull())


def value_kinds(pairs: DataFrame, kind: str | None = None) -> tuple[str, str]:
    """How forecast and truth are stored: thresholds are compared in that precision. ``kind`` overrides."""
    of = lambda c: "float" if pairs.schema[c].dataType.typeName() == "float" else "double"
    return (kind, kind) if kind else (of("pred"), of("target"))


def pair_sums(p: Column, t: Column, rain: float, heavy: float, kinds: tuple[str, str] = ("double", "double")) -> dict[str, Column]:
    """Mergeable sums behind the 14 sum-based scores. Moments are central, so nothing cancels."""
    wet_p, wet_t = exceeds(p, rain, kinds[0]), exceeds(t, rain, kinds[1])
    big_p, big_t = exceeds(p, heavy, kinds[0]), exceeds(t, heavy, kinds[1])
    p, t = p.cast("double"), t.cast("double")
    d = p - t
    n = F.count(F.lit(1))
    return {
        "n": n,
        "sum_d": F.sum(d),
        "sum_abs": F.sum(F.abs(d)),
        "sum_sq": F.sum(d * d),
        "mean_p": F.avg(p),
        "mean_t": F.avg(t),
        "m2_p": F.var_pop(p) * n,
        "m2_t": F.var_pop(t) * n,
        "m2_pt": F.covar_pop(p, t) * n,
        "tp": F.count_if(wet_p & wet_t),
        "fp": F.count_if(wet_p & ~wet_t),
        "fn": F.count_if(~wet_p & wet_t),
        "heavy_tp": F.count_if(big_p & big_t),
        "heavy_fp": F.count_if(big_p & ~big_t),
        "heavy_fn": F.count_if(~big_p & big_t),
        "heavy_sq": F.sum(F.when(big_t, d * d).otherwise(0.0)),
    }


def cell_sums(
    pairs: DataFrame, by: tuple[str, ...] = ("sensor_id", "site_id"), rain: float = dims.RAIN_MM_H,
    heavy: float = dims.HEAVY_MM_H, kind: str | None = None,
) -> DataFrame:
    """One pass over the pixels: sums per (sensor, site), combined on the map side. Works on streams too. A pair with
    a NULL counts nowhere."""
    sums = pair_sums(F.col("pred"), F.col("target"), rain, heavy, value_kinds(pairs, kind))
    return pairs.where(F.col("pred").isNotNull() & F.col("target").isNotNull()).groupBy(*by).agg(*[c.alias(name) for name, c in sums.items()])


def _merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of one key as one cell: counts and sums add up, moments are taken around the common mean first."""
    over = Window.partitionBy(*keys)
    moments = ("mean_p", "mean_t", "m2_p", "m2_t", "m2_pt")
    total = F.sum("n").over(over)
    centred = cells.withColumns({f"_{m}": F.sum(F.col(m) * F.col("n")).over(over) / total for m in moments[:2]})
    dp, dt = F.col("mean_p") - F.col("_mean_p"), F.col("mean_t") - F.col("_mean_t")
    between = {"m2_p": dp * dp, "m2_t": dt * dt, "m2_pt": dp * dt}
    plain = [c for c in cells.columns if c not in (*keys, *moments)]
    return centred.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in plain],
        *[F.first(f"_{m}").alias(m) for m in moments[:2]],
        *[F.sum(F.col(c) + F.col("n") * extra).alias(c) for c, extra in between.items()],
    )


def roll_up(cells: DataFrame) -> DataFrame:
    """Merge cells to the scopes all / sensor / site. Input is one row per (sensor, site), so the
    threefold expansion happens on the summary, never on pixels. A scope's cells meet in ``MERGE_PARTS`` parts
    first, then its parts: however many sites there are, no task holds all of them."""
    sums = [c for c in cells.columns if c not in ("sensor_id", "site_id")]
    part = F.pmod(F.xxhash64("sensor_id", "site_id"), F.lit(MERGE_PARTS)).cast("int")
    spread = cells.select(*sums, part.alias("_part"), F.explode(_scopes()).alias("_s")).select(*sums, "_part", "_s.*")
    scope = ["scope", "sensor_id", "site_id"]
    return _merged(_merged(spread, [*scope, "_part"]), scope).drop("mean_p", "mean_t")


def _ratio(above: Column, below: Column) -> Column:
    return F.when(below == 0, 0.0).otherwise(F.try_divide(above.cast("double"), below.cast("double")))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return _ratio(2 * precision * recall, precision + recall)


def scores(rolled: DataFrame) -> DataFrame:
    """The 14 scores from merged sums; degenerate denominators give 0."""
    c = F.col
    n = c("n").cast("double")
    tiny = F.lit(1e-12)
    spread = F.sqrt(c("m2_p") * c("m2_t"))
    chance = (c("tp") + c("fp")) * (c("tp") + c("fn")) / n
    ets_below = c("tp") + c("fp") + c("fn") - chance
    heavy_n = c("heavy_tp") + c("heavy_fn")
    columns = {
        "n": c("n"),
        "rmse": F.sqrt(c("sum_sq") / n),
        "mae": c("sum_abs") / n,
        "mse": c("sum_sq") / n,
        "bias": c("sum_d") / n,
        "r2": F.when(c("m2_t") < tiny, 0.0).otherwise(1.0 - F.try_divide(c("sum_sq"), c("m2_t"))),
        "pearson": F.when(spread < tiny, 0.0).otherwise(F.try_divide(c("m2_pt"), spread)),
        "csi": _ratio(c("tp"), c("tp") + c("fp") + c("fn")),
        "pod": _ratio(c("tp"), c("tp") + c("fn")),
        "far": _ratio(c("fp"), c("tp") + c("fp")),
        "ets": F.when(F.abs(ets_below) < tiny, 0.0).otherwise(F.try_divide(c("tp") - chance, ets_below)),
        "rain_f1": _f1(c("tp"), c("fp"), c("fn")),
        "rain_accuracy": (n - c("fp") - c("fn")) / n,
        "heavy_f1": _f1(c("heavy_tp"), c("heavy_fp"), c("heavy_fn")),
        "heavy_rmse": F.sqrt(_ratio(c("heavy_sq"), heavy_n)),
    }
    return rolled.select("scope", "sensor_id", "site_id", *[v.alias(k) for k, v in columns.items()])


def report(pairs: DataFrame, rain: float = dims.RAIN_MM_H, heavy: float = dims.HEAVY_MM_H, kind: str | None = None) -> DataFrame:
    """Sum-based scores overall, per sensor and per site; no rows in, no rows out."""
    return scores(roll_up(cell_sums(pairs, rain=rain, heavy=heavy, kind=kind)))


def rank_correlation(pairs: DataFrame, by: list[str], position: list[str]) -> DataFrame:
    """Spearman correlation on ordinal ranks (ties by ``position``), exact over all rows without a NULL.

    Ordinal ranks of n rows are a permutation of 0..n-1, so both variances are (n*n-1)/12 and only the
    covariance needs the data.
    """
    rows = pairs.select(*by, *position, "pred", "target").where(F.col("pred").isNotNull() & F.col("target").isNotNull())
    by_pred = ordinal_rank(rows, by, ["pred", *position], "_rp").drop("pred")
    by_both = ordinal_rank(by_pred, by, ["target", *position], "_rt")
    n = F.count(F.lit(1)).cast("double")
    spread = (n * n - 1) / 12
    rho = F.when(n < 2, 0.0).otherwise(F.covar_pop(F.col("_rp").cast("double"), F.col("_rt").cast("double")) / spread)
    return by_both.groupBy(*by).agg(rho.alias("spearman"))


def _scope_ranks(rows: DataFrame, order: list[str], names: tuple[str, str, str], n_blocks: int | None, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``rows``, both ids among them, plus the 0-based rank of each in ``order`` among all rows, among those of its sensor and among those
    of its site, from one sort: a rank is the number of such rows earlier in the block, counted in the sorting pass,
    plus those of the blocks before."""
    groups = ("sensor_id", "site_id")
    missing = -(1 << 62)  # a NULL id is a group too

    def fold(batches):
        seen = {g: {} for g in groups}
        for batch in batches:
            extra = []
            for g in groups:
                key = batch[g].fill_null(missing).to_numpy(zero_copy_only=False)
                by_key = np.argsort(key, kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(key[by_key]) != 0][: len(key)])
                size = np.diff(np.r_[start, len(key)])
                names = key[by_key[start]].tolist()
                before_batch = np.array([seen[g].get(k, 0) for k in names], np.int64)
                inside = np.empty(len(key), np.int64)
                inside[by_key] = np.arange(len(key)) + np.repeat(before_batch - start, size)
                extra.append(pa.array(inside))
                seen[g].update(zip(names, (before_batch + size).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *[f"_in_{g}" for g in groups]])

    folded = "_in_sensor_id bigint, _in_site_id bigint"
    blocks = ordered_blocks(rows, [], order, n_blocks, fold=fold, folded=folded, kept=kept, arrow=True)
    counts = materialise(blocks.groupBy(BLOCK, *groups).agg(F.count(F.lit(1)).alias("_n"), F.min(SLOT).alias("_first")), "summary")
    # earlier blocks of the same group; a block has a row for each pair of groups in it
    upto = lambda g: Window.partitionBy(g).orderBy(BLOCK).rangeBetween(Window.unboundedPreceding, -1)
    carry = counts.select(BLOCK, *groups, *[F.coalesce(F.sum("_n").over(upto(g)), F.lit(0)).alias(f"_before_{g}") for g in groups])
    whole = counts.groupBy(BLOCK).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    whole = whole.select(F.col(BLOCK).alias("_b"), (F.coalesce(F.sum("_n").over(before([])), F.lit(0)) - F.col("_first")).alias("_before"))
    carry = materialise(carry.join(whole, F.col(BLOCK) == F.col("_b")).drop("_b"), "carry")
    # one join gives the rows all three
    out = join_summary(blocks, carry, list(groups))
    ranks = (F.col(SLOT) + F.col("_before"), *[F.col(f"_in_{g}") + F.col(f"_before_{g}") for g in groups])
    return out.select(*kept, *[r.alias(n) for r, n in zip(ranks, names)])


def rank_report(pairs: DataFrame, position: list[str]) -> DataFrame:
    """Spearman overall, per sensor and per site, on ordinal ranks (ties by ``position``), exact over all rows without
    a NULL. Rows are sorted once by forecast and once by truth; each sort gives the ranks of all three scopes.

    Ranks of n rows are a permutation, so the correlation is 1 - 6 * sum(d * d) / (n * (n * n - 1)) with d the
    difference of both ranks: sums that combine on the map side.
    """
    rows = pairs.select(*dict.fromkeys([*position, "sensor_id", "site_id", "pred", "target"])).where(F.col("pred").isNotNull() & F.col("target").isNotNull())
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("sensor_id", "site_id")})
    n = blocks_for(pairs)
    by_pred, ids = ("_pa", "_ps", "_pt"), ["sensor_id", "site_id"]
    # what no later step needs is dropped right after the sort
    once = _scope_ranks(rows, ["pred", *position], by_pred, n, list(dict.fromkeys([*position, *ids, "target"])))
    both = _scope_ranks(once, ["target", *position], ("_ta", "_ts", "_tt"), n, [*ids, *by_pred])
    square = lambda p, t: F.sum((F.col(p) - F.col(t)).cast("double") * (F.col(p) - F.col(t)))
    cells = both.groupBy("sensor_id", "site_id").agg(
        F.count(F.lit(1)).alias("n"), square("_pa", "_ta").alias("all"), square("_ps", "_ts").alias("sensor"), square("_pt", "_tt").alias("site")
    )
    of = lambda scope, a, b: F.struct(F.lit(scope).alias("scope"), a.alias("sensor_id"), b.alias("site_id"), F.col(scope).alias("_d"))
    none = F.lit(None)
    scopes = F.array(
        of("all", none.cast("int"), none.cast("long")), of("sensor", F.col("sensor_id").cast("int"), none.cast("long")),
        of("site", none.cast("int"), F.col("site_id")),
    )
    sums = cells.select("n", F.explode(scopes).alias("_s")).groupBy("_s.scope", "_s.sensor_id", "_s.site_id").agg(F.sum("n").cast("double").alias("_n"), F.sum("_s._d").alias("_d"))
    rho = F.when(F.col("_n") < 2, 0.0).otherwise(1 - F.try_divide(6 * F.col("_d"), F.col("_n") * (F.col("_n") * F.col("_n") - 1)))
    return sums.select("scope", "sensor_id", "site_id", rho.alias("spearman"))


def full_report(pairs: DataFrame, position: list[str], rain: float = dims.RAIN_MM_H, heavy: float = dims.HEAVY_MM_H, kind: str | None = None) -> DataFrame:
    """All 15 scores. The rank part is joined on the scope's keys (summary rows only)."""
    ranks = rank_report(pairs, position).select(
        *[F.col(c).alias(f"_k_{c}") for c in ("scope", "sensor_id", "site_id")], "spearman"
    )
    main = report(pairs, rain, heavy, kind)
    same = F.lit(True)
    for c in ("scope", "sensor_id", "site_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return main.join(ranks, same).drop("_k_scope", "_k_sensor_id", "_k_site_id")


def flat_metrics(scored: DataFrame) -> DataFrame:
    """(metric, value) rows with flat names: ``rmse``, ``sat0/rmse``, ``loc3/rmse``."""
    names = [c for c in scored.columns if c not in ("scope", "sensor_id", "site_id", "n")]
    prefix = (
        F.when(F.col("scope") == "sensor", F.concat(F.lit("sat"), F.col("sensor_id").cast("string"), F.lit("/")))
        .when(F.col("scope") == "site", F.concat(F.lit("loc"), F.col("site_id").cast("string"), F.lit("/"))).otherwise("")
    )
    long = scored.select(prefix.alias("_p"), *names).unpivot("_p", names, "_m", "value")
    return long.select(F.concat("_p", "_m").alias("metric"), "value")


def batch_rmse(pairs: DataFrame, batch: str) -> DataFrame:
    d = F.col("pred") - F.col("target")
    return pairs.groupBy(batch).agg(F.sqrt(F.avg(d * d)).alias("rmse"))
