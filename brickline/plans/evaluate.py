"""Forecast scores and the best model per metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.operators.merge import upsert_last_wins

# Score columns, and the one where larger is better.
SCORE_COLUMNS = ["mae", "mape", "rmse", "mse", "r2"]
LARGER_IS_BETTER = "r2"
SCORE_KEYS = ["city", "target", "horizon_months", "model_name"]


def score_models(predictions: DataFrame, with_horizon: bool = True, digits: int = 4) -> DataFrame:
    """MAE, MAPE %, RMSE, MSE and R2 per series and model; R2 is null without variance."""
    keys = ["model_name", "city", "target"] + (["horizon_months"] if with_horizon else [])
    e = F.col("y_true") - F.col("yhat")
    sse = F.sum(e * e)
    return (
        predictions.filter("y_true is not null and yhat is not null")
        .groupBy(*keys)
        .agg(
            F.round(F.avg(F.abs(e)), digits).alias("mae"),
            F.round(F.avg(F.abs(F.try_divide(e, F.col("y_true")))) * 100, digits).alias("mape"),
            F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
            F.round(F.avg(e * e), digits).alias("mse"),
            F.round(1 - F.try_divide(sse, F.var_pop("y_true") * F.count("y_true")), digits).alias("r2"),
        )
    )


def best_model_per_metric(scores: DataFrame, missing: str = "skip") -> DataFrame:
    """Model with the best mean over horizons per series and metric; ties go to the first name.

    ``missing="zero"`` counts an absent score as 0, ``"skip"`` leaves it out.
    """
    value = F.coalesce(F.col("v"), F.lit(0.0)) if missing == "zero" else F.col("v")
    long = scores.unpivot(["city", "target", "model_name"], SCORE_COLUMNS, "metric", "v")
    mean = long.groupBy("city", "target", "metric", "model_name").agg(F.avg(value).alias("v")).filter("v is not null")
    cost = F.when(F.col("metric") == LARGER_IS_BETTER, -F.col("v")).otherwise(F.col("v"))
    return mean.groupBy("city", "target", "metric").agg(
        F.min_by("model_name", F.struct(cost, F.col("model_name"))).alias("best_model")
    )


def store_scores(stored: DataFrame, scores: DataFrame, evaluated_at: str) -> DataFrame:
    """The stored score table after an evaluation: new and scored-again keys get the new scores and ``evaluated_at``.

    Other rows stay as they are. Of scores with equal keys the largest row counts; rows with a null key are left out. An
    empty evaluation leaves the table as it is.
    """
    fresh = scores.select(*SCORE_KEYS, *SCORE_COLUMNS).withColumn("evaluated_at", F.lit(evaluated_at).cast("timestamp"))
    return upsert_last_wins(stored, fresh, SCORE_KEYS, SCORE_COLUMNS)
