"""Sequence features and the pooled sequence model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickline.bindings import CUTOFF
from brickline.functions.dates import months_since
from brickline.functions.numbers import clip_non_negative, pct_change
from brickline.operators.joins import chain_left
from brickline.operators.panel import (
    lagged,
    minmax,
    rolling_mean,
    sequence_windows,
    series_with_min_history,
    whole,
    yoy,
    zscore,
)
from brickline.operators.regression import fit_ridge
from brickline.plans.baselines import BACKTEST_COLUMNS, HORIZON, SERIES, filled
from brickline.plans.gated import EVALUATIONS, Correction, fit_corrections
from brickline.session import settle

# Window length, step limits and history limits.
WINDOW = 12
STEP_LIMIT = 0.30
BAND = 0.05
MIN_WINDOWS = 50
MIN_TRAIN = WINDOW + 24
MIN_VALID = 1
RIDGE = 1e-3


def build_sequence_features(
    price: DataFrame, rent: DataFrame, macro: DataFrame, demo: DataFrame, lags: Sequence[int], rolls: Sequence[int]
) -> DataFrame:
    """Price joined with rent, inflation and population, with lags, rolling means and yearly change."""
    k = ["city"]
    joined = chain_left(
        price,
        [
            rent.withColumnRenamed("y", "rent"),
            macro.select("date", "city", "cpi_yoy"),
            demo.select("date", "city", "population"),
        ],
        ["city", "date"],
    )
    return joined.withColumns(
        {
            **{f"lag_{n}": lagged("y", n, k) for n in lags},
            **{f"roll_{n}": rolling_mean("y", n, k) for n in rolls},
            "yoy": yoy("y", k),
        }
    )


def _shape(window: Column) -> list[Column]:
    """Each window value relative to the newest one."""
    return [pct_change(F.element_at(window, i), F.element_at(window, WINDOW)) for i in range(1, WINDOW)]


class Model:
    """One target's next value: a linear part over all inputs, and what the gated network adds from the window."""

    def __init__(self, coefs: np.ndarray, correction: Correction | None, width: int):
        self.coefs, self.correction, self.width = coefs, correction, width

    def __call__(self, x: np.ndarray) -> np.ndarray:
        linear = self.coefs[0] + x @ self.coefs[1:]
        return linear + self.correction(x[:, : self.width]) if self.correction else linear


def fit_models(samples: DataFrame, names: list[str], label: str, width: int, evaluations: int = EVALUATIONS) -> dict[str, Model]:
    """A model per target from ``names`` (the first ``width`` are the window); as many models as there are targets."""
    complete = samples.where(F.col(label).isNotNull()).select("target", F.array(*[F.coalesce(c, F.lit(0.0)) for c in names]).alias("x"), F.col(label).alias("y"))
    kept = settle(complete, "sequence-samples")
    inputs = {f"x{i}": F.element_at("x", i + 1) for i in range(len(names))}
    fitted = fit_ridge(kept.withColumns({"one": F.lit(1.0), **inputs}), ["target"], ["one", *inputs], "y", RIDGE)
    linear = {r["target"]: np.array(r["coefs"]) for r in fitted.collect()}
    corrections = fit_corrections(kept, width, linear, evaluations)
    return {name: Model(coefs, corrections.get(name), width) for name, coefs in linear.items()}


def _paths(models: dict[str, Model], horizon: int):
    """Every series' path from its last window: steps are clipped, a step from 0 stays there."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("target").to_pylist(), dtype=object)
            windows = np.array(batch.column("w").to_pylist(), dtype=float).reshape(batch.num_rows, WINDOW)
            held = np.array(batch.column("held").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            path = np.zeros((batch.num_rows, horizon, 3))
            for name in sorted(set(names)):
                at = np.flatnonzero(names == name)
                w, fixed = windows[at], held[at]
                for h in range(horizon):
                    base = w[:, -1]
                    shape = np.divide(w[:, :-1], base[:, None], out=np.ones((len(at), WINDOW - 1)), where=base[:, None] != 0) - 1
                    step = np.clip(models[name](np.hstack([shape, fixed])), -STEP_LIMIT, STEP_LIMIT)
                    path[at, h] = np.stack([base * (1 + step), base * (1 + step - BAND), base * (1 + step + BAND)], axis=1)
                    w = np.hstack([w[:, 1:], (base * (1 + step))[:, None]])
            rows = np.repeat(np.arange(batch.num_rows), horizon)
            keys = [batch.column(c).take(pa.array(rows)) for c in ("target", "city", "last_ds")]
            steps = pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), batch.num_rows))
            flat = path.reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*keys, steps, *(pa.array(flat[:, i]) for i in range(3))],
                names=["target", "city", "last_ds", "horizon_months", "yhat", "lower", "upper"],
            )

    return out


def forecast_sequence(panel: DataFrame, regressors: list[str], horizon: int = HORIZON, evaluations: int = EVALUATIONS) -> DataFrame:
    """One pooled model per target from the last 12 values to the next change, then recursion.

    The linear part is sums over all series, the network is trained by summed gradients. Each series' path starts from
    its own state row: every step is clipped to +-30 %, the band is +-5 %, and the last known regressors stay in place.
    """
    ready = filled(panel).filter("y is not null").withColumns(
        {f"r_{c}": F.coalesce(zscore(c, SERIES), F.lit(0.0)) for c in regressors}
    )
    held = [f"r_{c}" for c in regressors]
    rows = ready.withColumn("w", sequence_windows("y", WINDOW, SERIES, "ds")).withColumns(
        {f"prev_{c}": lagged(c, 1, SERIES, "ds") for c in held}
    )
    shape = {f"s{i}": c for i, c in enumerate(_shape(F.col("w")))}
    samples = rows.filter("w is not null").withColumns({**shape, "step": pct_change(F.col("y"), F.element_at("w", WINDOW))})
    counted = settle(samples.withColumn("__n", F.count("step").over(whole(SERIES))).filter(F.col("__n") >= MIN_WINDOWS), "sequence-windows")
    models = fit_models(counted, [*shape, *[f"prev_{c}" for c in held]], "step", WINDOW - 1, evaluations)

    newest = F.struct("ds", "y", *held)
    tail = counted.groupBy(*SERIES).agg(F.max_by(F.struct(newest.alias("r"), F.col("w")), "ds").alias("l"))
    state = tail.select(
        *SERIES,
        F.col("l.r.ds").alias("last_ds"),
        F.concat(F.slice("l.w", 2, WINDOW - 1), F.array("l.r.y")).alias("w"),
        F.array(*[F.col(f"l.r.{c}") for c in held]).cast("array<double>").alias("held"),
    ).filter(F.col("target").isin(list(models)))
    kinds = dict(state.dtypes)
    schema = f"target {kinds['target']}, city {kinds['city']}, last_ds {kinds['last_ds']}, horizon_months int, yhat double, lower double, upper double"
    return state.mapInArrow(_paths(models, horizon), schema).select(
        F.lit("sequence").alias("model_name"),
        "target",
        "city",
        "horizon_months",
        F.add_months("last_ds", F.col("horizon_months")).alias("predict_date"),
        "yhat",
        clip_non_negative(F.col("lower")).alias("yhat_lower"),
        clip_non_negative(F.col("upper")).alias("yhat_upper"),
    )


def backtest_sequence(panel: DataFrame, cutoff: str = CUTOFF, evaluations: int = EVALUATIONS) -> DataFrame:
    """Pooled model on scaled 12-step windows up to the cutoff; one-step predictions, no interval."""
    train = F.col("ds") <= F.lit(cutoff).cast("date")
    kept = series_with_min_history(filled(panel), SERIES, "y", cutoff, MIN_TRAIN, MIN_VALID, "ds")
    fit = F.when(train, F.col("y"))
    w = whole(SERIES)
    scaled = kept.withColumns(
        {"u": minmax("y", SERIES, train), "lo": F.min(fit).over(w), "hi": F.max(fit).over(w)}
    ).withColumn("w", sequence_windows("u", WINDOW, SERIES, "ds"))
    xs = {f"u{i}": F.element_at("w", i + 1) for i in range(WINDOW)}
    rows = settle(scaled.filter("w is not null").withColumns(xs), "sequence-backtest")
    models = fit_models(rows.filter(train), list(xs), "u", WINDOW, evaluations)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("target").to_pylist(), dtype=object)
            x = np.array(batch.column("w").to_pylist(), dtype=float).reshape(batch.num_rows, WINDOW)
            said = np.zeros(batch.num_rows)
            for name in set(names):
                said[names == name] = models[name](x[names == name])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said)], names=[*batch.schema.names, "said"])

    later = rows.filter(~train & F.col("target").isin(list(models))).select(*SERIES, "ds", "y", "w", "lo", "hi")
    valid = later.mapInArrow(predict, StructType([*later.schema.fields]).add("said", "double"))
    pred = F.col("lo") + F.col("said") * (F.col("hi") - F.col("lo"))
    none = F.lit(None).cast("double")
    return valid.select(
        F.lit("sequence_backtest").alias("model_name"),
        "target",
        "city",
        months_since(F.col("ds"), cutoff).alias("horizon_months"),
        F.col("ds").alias("predict_date"),
        clip_non_negative(pred).alias("yhat"),
        none.alias("yhat_lower"),
        none.alias("yhat_upper"),
        F.col("y").alias("y_true"),
    ).select(*BACKTEST_COLUMNS)
