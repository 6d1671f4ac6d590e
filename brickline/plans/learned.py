"""Tree models trained with Spark's own distributed learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.session import settle

# Tree ensemble settings.
TREE_DEPTH = 4
TREE_COUNT = 10
SEED = 42
# Months that the price label lies ahead of its row.
LABEL_MONTHS = 12


def train_price_model(
    history: DataFrame, columns: Sequence[str], label: str, cutoff: str, label_months: int = LABEL_MONTHS
) -> DataFrame:
    """Gradient-boosted trees; predictions ``city, date, label, prediction`` of the months after the cutoff.

    A label lies ``label_months`` ahead of its row, so only rows whose label is known by the cutoff are learned from.
    A month whose label is not known yet is predicted too; its label is null. With nothing to learn from there are no
    predictions.
    """
    data = history.select("city", "date", F.col(label).alias("label"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    data = settle(data, "model-history")
    known_by = F.add_months(F.lit(cutoff).cast("date"), -label_months)
    train = data.filter((F.col("date") <= known_by) & F.col("label").isNotNull())
    if train.first() is None:
        return data.select("city", "date", "label", F.lit(0.0).alias("prediction")).limit(0)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    trees = GBTRegressor(maxDepth=TREE_DEPTH, maxIter=TREE_COUNT, seed=SEED)
    model = Pipeline(stages=[assembler, trees]).fit(train)
    later = data.filter(F.col("date") > F.lit(cutoff).cast("date"))
    return model.transform(later).select("city", "date", "label", "prediction")


def prediction_scores(predictions: DataFrame) -> DataFrame:
    """``metric, value`` over the predictions whose label is known: rmse, mae, r2 and their number."""
    e, known = F.col("label") - F.col("prediction"), F.col("label").isNotNull()
    one = predictions.filter(known).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))).alias("r2"),
        F.count("label").cast("double").alias("n"),
    )
    return one.unpivot([], ["rmse", "mae", "r2", "n"], "metric", "value")
