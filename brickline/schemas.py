"""Target tables: column types and keys."""

from __future__ import annotations

# Column types and keys of the stored tables.
FORECAST_TYPES = {
    "run_id": "string", "model_name": "string", "target": "string", "horizon_months": "int", "city": "string",
    "property_type": "string", "beds": "int", "baths": "int", "sqft_min": "int", "sqft_max": "int",
    "year_built_min": "int", "year_built_max": "int", "predict_date": "date", "yhat": "double",
    "yhat_lower": "double", "yhat_upper": "double", "y_true": "double", "features_version": "string",
    "model_artifact_uri": "string", "is_micro": "boolean", "created_at": "timestamp",
}
RISK_TYPES = {
    "run_id": "string", "city": "string", "risk_type": "string", "predict_date": "date", "risk_value": "double",
    "model_name": "string", "created_at": "timestamp",
}
ANOMALY_TYPES = {
    "run_id": "string", "city": "string", "target": "string", "detect_date": "date", "value": "double",
    "anomaly_score": "double", "is_anomaly": "boolean", "model_name": "string",
    "created_at": "timestamp",
}
METRIC_TYPES = {"date": "date", "city": "string", "metric": "string", "value": "double", "source": "string"}
LISTING_TYPES = {
    "listing_id": "string", "url": "string", "date_posted": "date", "city": "string", "postal_code": "string",
    "property_type": "string", "listing_type": "string", "price": "double", "bedrooms": "double",
    "bathrooms": "double", "area_sqft": "bigint", "year_built": "int", "description": "string",
}
FORECAST_KEYS = ["model_name", "target", "city", "predict_date"]
RISK_KEYS = ["city", "risk_type", "predict_date"]
ANOMALY_KEYS = ["city", "target", "detect_date", "model_name"]
METRIC_KEYS = ["date", "metric", "city"]

# Feature columns of the month x city table.
RAW_MEASURES = [
    "hpi_benchmark", "rent_avg_city", "mortgage_rate", "unemployment_rate", "overnight_rate", "population",
    "median_income", "migration_rate", "gdp_growth", "cpi_yoy",
]
DERIVED_MEASURES = ["hpi_benchmark_yoy", "rent_avg_city_yoy", "lag_1", "lag_3", "lag_6", "roll_3", "roll_6"]
FEATURE_METRICS = ["mortgage_rate", "unemployment_rate", "overnight_rate"]
FILL_ZERO = ["population", "median_income", "migration_rate", "hpi_benchmark"]
