"""Forecast losses as table aggregates.

Pixel rows carry ``mean`` (log space), ``y`` (log target), ``rain_logit``, ``rain_mask`` and, for some terms,
``log_var``. A pixel expression is averaged per sample, then over valid samples.
"""
from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions import kernels
from gridcast.functions.columns import pixel_weight, sigmoid


# ---- pixel expressions ----------------------------------------------------------------------------
def squared(pred: Column, target: Column, weight: Column | None = None) -> Column:
    d = pred - target
    return d * d if weight is None else d * d * weight


def absolute(pred: Column, target: Column, weight: Column | None = None) -> Column:
    d = F.abs(pred - target)
    return d if weight is None else d * weight


def smooth_l1(pred: Column, target: Column, beta: float = 1.0) -> Column:
    d = F.abs(pred - target)
    if beta == 0:
        return d
    return F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2)


def huber(pred: Column, target: Column, delta: float = 1.0) -> Column:
    d = F.abs(pred - target)
    return F.when(d <= delta, d * d / 2).otherwise((d - delta / 2) * delta)


def logit_entropy(logit: Column, mask: Column, focal_gamma: float = 0.0) -> Column:
    z, y = logit.cast("double"), mask.cast("double")
    entropy = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    if focal_gamma <= 0:
        return entropy
    p = sigmoid(z)
    missed = F.when(y == 1, 1 - p).otherwise(p)
    return entropy * F.pow(missed, F.lit(focal_gamma))


def gaussian_nll(mean: Column, log_var: Column, target: Column) -> Column:
    d = mean - target
    return (log_var + d * d / F.exp(log_var)) * 0.5


# ---- reductions -----------------------------------------------------------------------------------
def sample_means(pixels: DataFrame, terms: dict[str, Column], uid: str = "uid", keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every term per sample; rows of one sample collapse on the map side before the shuffle."""
    return pixels.groupBy(uid, *keep).agg(*[F.avg(c).alias(name) for name, c in terms.items()])


def masked_mean(samples: DataFrame, terms: list[str], valid: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """``sum(valid*m) / max(sum(valid), 1)`` per group."""
    if valid is None:
        return samples.groupBy(*by).agg(*[F.avg(t).alias(t) for t in terms])
    v = F.col(valid).cast("double")
    return samples.groupBy(*by).agg(
        *[(F.sum(F.col(t) * v) / F.greatest(F.sum(v), F.lit(1.0))).alias(t) for t in terms]
    )


def pixel_loss(pixels: DataFrame, terms: dict[str, Column], uid: str = "uid", valid: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Terms reduced in two levels. Without a mask the plain mean over pixels needs no per-sample step."""
    if valid is None:
        return pixels.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in terms.items()])
    return masked_mean(sample_means(pixels, terms, uid, (*by, valid)), list(terms), valid, by)


def dice(pixels: DataFrame, prob: Column, mask: Column, uid: str = "uid", valid: str | None = None, by: tuple[str, ...] = (), smooth: float = 1.0) -> DataFrame:
    keep = (*by, valid) if valid else by
    samples = pixels.groupBy(uid, *keep).agg(
        F.sum(prob * mask).alias("_i"), F.sum(prob + mask).alias("_t")
    )
    samples = samples.withColumn("dice", 1.0 - (2 * F.col("_i") + smooth) / (F.col("_t") + smooth))
    return masked_mean(samples, ["dice"], valid, by)


def grid_losses(grids: DataFrame, shape: tuple[int, int], pred: str = "pred", target: str = "target") -> DataFrame:
    """``grids`` plus per-sample means of the gradient and SSIM losses (narrow: one Arrow pass, no shuffle)."""
    gradient = kernels.pair_loss_column(shape, kernels.sobel_difference)
    ssim = kernels.pair_loss_column(shape, kernels.ssim_loss)
    return grids.withColumns({"gradient": gradient(pred, target), "ssim": ssim(pred, target)})


# ---- composite ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class LossWeights:
    """Weights of the composite; a term with weight 0 is not computed."""

    mse_weight: float = 1.0
    mae_weight: float = 0.0
    smooth_l1_weight: float = 0.0
    huber_weight: float = 0.0
    huber_delta: float = 1.0
    rain_weighted: bool = True
    rain_weight_scale: float = 3.0
    bce_weight: float = 0.5
    focal_gamma: float = 0.0
    nll_weight: float = 0.0
    gradient_weight: float = 0.0
    ssim_weight: float = 0.0
    dice_weight: float = 0.0
    mask_missing_frames: bool = True

    @classmethod
    def of(cls, config: dict) -> "LossWeights":
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in config.items() if k in known})


def composite(
    pixels: DataFrame, weights: LossWeights = LossWeights(), uid: str = "uid", valid: str = "has_data",
    by: tuple[str, ...] = (), grids: DataFrame | None = None, shape: tuple[int, int] = (41, 41),
) -> DataFrame:
    """One column per enabled term plus ``total``. ``grids`` (uid, pred, target arrays) is needed only for
    the gradient and SSIM terms and joins on the sample, where the pixel part is already grouped."""
    w = weights
    mean, y = F.col("mean"), F.col("y")
    rain = pixel_weight(y, w.rain_weight_scale) if w.rain_weighted else None
    terms: dict[str, tuple[float, Column]] = {}
    if w.mse_weight > 0:
        terms["mse"] = (w.mse_weight, F.avg(squared(mean, y, rain)))
    if w.mae_weight > 0:
        terms["mae"] = (w.mae_weight, F.avg(absolute(mean, y, rain)))
    if w.smooth_l1_weight > 0:
        terms["smooth_l1"] = (w.smooth_l1_weight, F.avg(smooth_l1(mean, y)))
    if w.huber_weight > 0:
        terms["huber"] = (w.huber_weight, F.avg(huber(mean, y, w.huber_delta)))
    if w.bce_weight > 0:
        terms["bce"] = (w.bce_weight, F.avg(logit_entropy(F.col("rain_logit"), F.col("rain_mask"), w.focal_gamma)))
    if w.nll_weight > 0 and "log_var" in pixels.columns:
        terms["nll"] = (w.nll_weight, F.avg(gaussian_nll(mean, F.col("log_var"), y)))
    if w.dice_weight > 0:
        prob, mask = sigmoid(F.col("rain_logit")), F.col("rain_mask").cast("double")
        inter, total = F.sum(prob * mask), F.sum(prob + mask)
        terms["dice"] = (w.dice_weight, 1.0 - (2 * inter + 1.0) / (total + 1.0))
    mask_col = valid if w.mask_missing_frames else None
    keep = [c for c in (*by, mask_col) if c]
    samples = pixels.groupBy(uid, *keep).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, (_, c) in terms.items()])
    factors = {k: f for k, (f, _) in terms.items()}
    structural = {k: f for k, f in (("gradient", w.gradient_weight), ("ssim", w.ssim_weight)) if f > 0}
    if structural:
        if grids is None:
            raise ValueError("gradient and SSIM terms need grids")
        scored = grid_losses(grids, shape).select(uid, *structural)
        samples = samples.join(scored, uid)
        factors |= structural
    if mask_col is None:
        # a plain mean over pixels weighs samples by their pixel count; dice is per sample
        reduced = [
            (F.avg(k) if k == "dice" else F.sum(F.col(k) * F.col("_n")) / F.sum("_n")).alias(k) for k in factors
        ]
        out = samples.groupBy(*by).agg(*(reduced or [F.count(F.lit(1)).alias("_n")]))
    elif factors:
        out = masked_mean(samples, list(factors), mask_col, by)
    else:
        out = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = F.lit(0.0)
    for k, f in factors.items():
        total = total + F.col(k) * f
    return out.select(*by, *factors, total.alias("total"))
