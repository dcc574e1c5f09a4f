"""Batched scoring with a user's model function."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

from gridcast import dims
from gridcast.functions.kernels import to_block

# (features (N, C, H, W) float32, aux (N, A) float32) -> {"mean", "rain_logit"[, "log_var"]}: (N, h, w)
Model = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]

MODELS: dict[str, Model] = {}


def register_model(name: str, model: Model) -> None:
    MODELS[name] = model


def find_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}, expected one of {sorted(MODELS)}")
    return MODELS[name]


# models that this worker process has made, by the digest of their factory
_LOADED: dict[str, Model] = {}


@dataclass(frozen=True)
class Factory:
    """A model that each Python worker makes once and keeps over its tasks: ``make`` travels, the model does not."""

    make: Callable[[], Model]
    digest: str

    def model(self) -> Model:
        if self.digest not in _LOADED:
            _LOADED.clear()  # one model at a time
            _LOADED[self.digest] = self.make()
        return _LOADED[self.digest]


def factory(make: Callable[[], Model]) -> Factory:
    """``make`` loads a model, say from a file that all executors see."""
    return Factory(make, hashlib.sha256(cloudpickle.dumps(make)).hexdigest())


def _rate(out: dict[str, np.ndarray], gate: float) -> np.ndarray:
    rate = np.expm1(np.maximum(out["mean"].astype(np.float64), 0.0))
    z = np.clip(out["rain_logit"].astype(np.float64), -700, 700)
    return rate * (1.0 / (1.0 + np.exp(-z)) > gate)


def score(
    rows: DataFrame, model: Model | Factory | str, shape: tuple[int, int, int], keep: list[str], gate: float = dims.GATE_INFERENCE,
    mirrored: bool = False, batch_size: int = 64, features: str = "features", aux: str = "aux", raw: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``rate`` ARRAY<FLOAT> in mm/h. ``mirrored`` also scores the x-flipped input,
    flips that forecast back and averages; both orientations share one pass, so no join is needed.
    ``model`` is a function, a registered name, or a :func:`factory` whose model each worker makes once.
    ``raw`` returns ``mean``, ``rain_logit`` and ``log_var`` (clamped, NULL if absent) instead."""
    given = find_model(model) if isinstance(model, str) else model
    source = rows.select(*dict.fromkeys([*keep, features, aux]))
    outputs = ["mean", "rain_logit", "log_var"] if raw else ["rate"]
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(o, T.ArrayType(T.FloatType())) for o in outputs])

    def lists(grid: np.ndarray | None, n: int) -> pa.Array:
        if grid is None:
            return pa.nulls(n, pa.list_(pa.float32()))
        return pa.array(list(grid.reshape(n, -1).astype(np.float32)), pa.list_(pa.float32()))

    def run(batches):
        run_model = given.model() if isinstance(given, Factory) else given
        for big in batches:
            for at in range(0, big.num_rows, batch_size):
                batch = big.slice(at, batch_size)
                n = batch.num_rows
                sat = to_block(batch[features], shape, np.float32)
                extra = np.array(batch[aux].to_pylist(), dtype=np.float32).reshape(n, -1)
                out = run_model(sat, extra)
                if raw:
                    log_var = out.get("log_var")
                    clamped = None if log_var is None else np.clip(log_var, -10.0, 5.0)
                    columns = [lists(out["mean"], n), lists(out["rain_logit"], n), lists(clamped, n)]
                else:
                    rate = _rate(out, gate)
                    if mirrored:
                        flipped = run_model(np.ascontiguousarray(sat[..., ::-1]), extra)
                        rate = 0.5 * (rate + _rate(flipped, gate)[..., ::-1])
                    columns = [lists(rate, n)]
                yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + columns, names=[*keep, *outputs])

    return source.mapInArrow(run, schema)
