"""End-user reads over the fact tables. A city of None answers for all cities in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions import labels
from brickline.functions.text import strip_model_suffix
from brickline.operators.filters import filter_ci, filter_segment_or_any
from brickline.operators.merge import dedupe_keep_first, dedupe_keep_last
from brickline.operators.panel import sample_horizon
from brickline.operators.reshape import nest_points
from brickline.operators.topk import top_per_group
from brickline.schemas import ANOMALY_KEYS, FORECAST_KEYS, RISK_KEYS

RISK_NAMES = ["affordability", "price_to_rent", "inventory", "composite_index"]


def _for(df: DataFrame, **wanted: str | None) -> DataFrame:
    return filter_ci(df, **{c: v for c, v in wanted.items() if v is not None})


def latest_run(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of facts that several runs wrote, the rows of each key's latest run; without run times all rows."""
    return dedupe_keep_last(facts, keys, ["created_at"]) if "created_at" in facts.columns else facts


def fill_interval(df: DataFrame) -> DataFrame:
    """A missing bound becomes the point forecast."""
    return df.withColumns({c: F.coalesce(c, "yhat") for c in ("yhat_lower", "yhat_upper")})


def distinct_cities(df: DataFrame) -> DataFrame:
    return df.select("city").distinct().orderBy("city")


def city_property_types(listings: DataFrame) -> DataFrame:
    pairs = listings.select("city", "property_type").distinct()
    return pairs.groupBy("city").agg(F.array_sort(F.collect_list("property_type")).alias("property_types"))


def serve_forecast(
    facts: DataFrame, months: int, city: str | None = None, target: str | None = None, model: str | None = None
) -> DataFrame:
    """Monthly path up to the horizon, in date order, thinned for long horizons."""
    facts = latest_run(_for(facts, city=city, target=target, model_name=model), FORECAST_KEYS)
    path = facts.filter(F.col("horizon_months").between(1, months))
    thin = sample_horizon(path, ["city", "target", "model_name"], months, "predict_date")
    return thin.select(
        "city",
        "target",
        "model_name",
        F.col("predict_date").alias("date"),
        F.col("yhat").alias("value"),
        F.col("yhat_lower").alias("lower"),
        F.col("yhat_upper").alias("upper"),
    )


def serve_forecast_segment(facts: DataFrame, months: int, as_of: str, city: str | None = None, **segment) -> DataFrame:
    """Rows of exactly this horizon inside the next ``30 * months`` days, one per date."""
    start = F.lit(as_of).cast("date")
    rows = _for(facts, city=city).filter(
        (F.col("horizon_months") == months)
        & (F.col("predict_date") >= start)
        & (F.col("predict_date") <= F.date_add(start, 30 * months))
    )
    wanted = filter_segment_or_any(rows, **segment)
    slim = wanted.select("city", "target", "predict_date", "model_name", "yhat", "yhat_lower", "yhat_upper")
    return dedupe_keep_first(slim, ["city", "target", "predict_date"], ["model_name", "yhat"])


def serve_anomalies(signals: DataFrame, city: str | None = None, target: str | None = None) -> DataFrame:
    return _for(signals, city=city, target=target).orderBy("city", "target", "detect_date")


def top3_anomalies(signals: DataFrame, k: int = 3) -> DataFrame:
    """Newest flagged rows per city."""
    flagged = signals.filter("is_anomaly")
    return top_per_group(flagged, ["city"], [F.desc("detect_date"), F.asc("target")], k)


def latest3_headlines(news: DataFrame, k: int = 3) -> DataFrame:
    return top_per_group(news, ["city"], [F.desc("date"), F.desc("id")], k)


def latest_forecast(facts: DataFrame) -> DataFrame:
    """Newest forecast row per city and target."""
    row = F.struct("predict_date", "model_name", "horizon_months", "yhat")
    return facts.groupBy("city", "target").agg(F.max_by(row, F.struct("predict_date", "model_name")).alias("r")).select(
        "city", "target", "r.*"
    )


def serve_model_comparison(scores: DataFrame) -> DataFrame:
    """``{model: [points by horizon]}`` and the horizons per city and target."""
    plain = scores.withColumn("model", strip_model_suffix(F.col("model_name")))
    return nest_points(plain, ["city", "target"], "model", ["mae", "mape", "rmse", "mse", "r2"], "horizon_months")


def serve_risk_gauge(risks: DataFrame, keep: str = "latest") -> DataFrame:
    """Newest date, score and three labels per city; a missing component counts as 0.

    ``keep="oldest"`` takes the oldest value per type instead of the latest.
    """
    pick = F.max_by if keep == "latest" else F.min_by
    wide = risks.groupBy("city").agg(
        F.max("predict_date").alias("date"),
        *[
            F.coalesce(pick("risk_value", F.when(F.col("risk_type") == n, F.col("predict_date"))), F.lit(0.0)).alias(n)
            for n in RISK_NAMES
        ],
    )
    return wide.select(
        "city",
        "date",
        F.round(F.round(F.col("composite_index") * 100, 6)).cast("int").alias("score"),
        labels.affordability_label(F.col("affordability")).alias("affordability"),
        labels.price_to_rent_label(F.col("price_to_rent")).alias("price_to_rent"),
        labels.inventory_label(F.col("inventory")).alias("inventory"),
    )


def anomaly_deviation(actuals: DataFrame, expected: DataFrame) -> DataFrame:
    """Actual value, expected value and the deviation in percent per series and date."""
    e = expected.select("city", "target", F.col("predict_date").alias("ds"), F.col("yhat").alias("expected"))
    joined = actuals.join(e, ["city", "target", "ds"])
    deviation = F.try_divide(F.col("y") - F.col("expected"), F.col("expected")) * 100
    return joined.select("city", "target", "ds", F.col("y").alias("value"), "expected", deviation.alias("deviation_pct"))


def daily_anomaly_series(signals: DataFrame) -> DataFrame:
    """Price points with their flag, one per city and date, in order."""
    price = signals.filter("target = 'price'").select("city", "detect_date", "value", "is_anomaly", "model_name")
    last = price.groupBy("city", "detect_date").agg(
        F.max_by(F.struct("value", "is_anomaly"), "model_name").alias("r")
    )
    return last.select("city", "detect_date", "r.*").orderBy("city", "detect_date")


def city_report(facts: DataFrame, risks: DataFrame, signals: DataFrame) -> DataFrame:
    """Forecast, risk and anomaly sections of every city as one tagged table."""
    risks, signals = latest_run(risks, RISK_KEYS), latest_run(signals, ANOMALY_KEYS)
    forecast = fill_interval(latest_run(facts.filter("target = 'price'"), FORECAST_KEYS)).select(
        "city",
        F.lit("forecast").alias("section"),
        F.row_number().over(Window.partitionBy("city").orderBy("predict_date", "model_name")).alias("ord"),
        F.col("predict_date").alias("date"),
        F.col("model_name").alias("label"),
        F.col("yhat").alias("value"),
        F.col("yhat_lower").alias("lower"),
        F.col("yhat_upper").alias("upper"),
    )
    none = F.lit(None).cast("double")
    risk = risks.select(
        "city",
        F.lit("risk").alias("section"),
        F.row_number().over(Window.partitionBy("city").orderBy(F.desc("predict_date"), "risk_type")).alias("ord"),
        F.col("predict_date").alias("date"),
        F.col("risk_type").alias("label"),
        F.col("risk_value").alias("value"),
        none.alias("lower"),
        none.alias("upper"),
    )
    anomaly = top3_anomalies(signals).select(
        "city",
        F.lit("anomaly").alias("section"),
        F.col("rank").alias("ord"),
        F.col("detect_date").alias("date"),
        F.col("target").alias("label"),
        F.col("anomaly_score").alias("value"),
        none.alias("lower"),
        none.alias("upper"),
    )
    return forecast.unionByName(risk).unionByName(anomaly)
