"""Serving reads, answered for all cities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import query, rounded
from brickline.plans import anomalies, evaluate, sentiment, serve
from brickline.plans.baselines import all_backtests, backtest_seasonal_naive, forecast_drift
from brickline.plans.risk import all_risks
from brickline.schemas import FORECAST_KEYS, FORECAST_TYPES
from brickline.session import new_table_path, settle
from brickline.sources.sinks import write_facts


def facts_of_two_runs(t: Tables) -> DataFrame:
    """Forecast facts written by a first run with other values and by a later one that counts."""
    path, rows = new_table_path(t.spark, "two-runs"), settle(forecast_drift(t.series), "drift")
    first = rows.withColumns({c: F.col(c) / 2 for c in ("yhat", "yhat_lower", "yhat_upper")})
    for run, day in ((first, "2024-01-01"), (rows, "2024-02-01")):
        write_facts(run, path, FORECAST_TYPES, FORECAST_KEYS, created_at=F.lit(day).cast("timestamp"))
    return t.spark.read.parquet(path)


@query("serve_cities", "select distinct city from b_drift order by 1")
def _(t: Tables) -> DataFrame:
    return serve.distinct_cities(forecast_drift(t.series))


@query(
    "serve_city_property_types",
    "select city, unnest(list_sort(list(distinct property_type))) as property_type from b_sales group by city",
)
def _(t: Tables) -> DataFrame:
    return serve.city_property_types(t.sales).select("city", F.explode("property_types").alias("property_type"))


@query(
    "serve_forecast",
    """select city, target, model_name, predict_date as date, round(yhat, 4) as value, round(yhat_lower, 4) as lower, round(yhat_upper, 4) as upper from
       (select *, row_number() over (partition by city, target order by predict_date) - 1 as i, count(*) over (partition by city, target) as n from b_drift)
       where i % greatest(1, n // 12) = 0 and i // greatest(1, n // 12) < 12""",
)
def _(t: Tables) -> DataFrame:
    return rounded(serve.serve_forecast(facts_of_two_runs(t), 60, model="DRIFT"), "value", "lower", "upper", digits=4)


@query(
    "serve_forecast_segment",
    """select city, target, predict_date, model_name, round(yhat, 4) as yhat from b_drift
       where horizon_months = 12 and predict_date >= date '2001-10-01' and predict_date <= date '2001-10-01' + 360""",
)
def _(t: Tables) -> DataFrame:
    facts = forecast_drift(t.series).withColumns(
        {c: F.lit(None).cast("int") for c in ("beds", "baths", "sqft_min", "sqft_max", "year_built_min", "year_built_max")}
    )
    out = serve.serve_forecast_segment(facts, 12, "2001-10-01")
    return rounded(out.select("city", "target", "predict_date", "model_name", "yhat"), "yhat", digits=4)


@query(
    "serve_anomalies",
    "select city, target, detect_date, round(value, 4) as value, is_anomaly from b_signals order by 1, 2, 3",
)
def _(t: Tables) -> DataFrame:
    out = serve.serve_anomalies(anomalies.detect_zscore(t.series))
    return rounded(out.select("city", "target", "detect_date", "value", "is_anomaly"), "value", digits=4)


@query(
    "serve_model_comparison",
    """select city, target, replace(model_name, '_backtest', '') as model, horizon_months, round(abs(y_true - yhat), 4) as mae from b_backtests""",
)
def _(t: Tables) -> DataFrame:
    nested = serve.serve_model_comparison(evaluate.score_models(all_backtests(t.series_dense)))
    flat = nested.select("city", "target", F.explode("models").alias("model", "points"))
    return flat.select("city", "target", "model", F.explode("points").alias("p")).select(
        "city", "target", "model", "p.horizon_months", "p.mae"
    )


def gauge_sql(order: str) -> str:
    def at(kind: str) -> str:
        return f"coalesce(arg_{order}(risk_value, predict_date) filter (where risk_type = '{kind}'), 0)"

    return f"""select city, max(predict_date) as date, cast(round(round({at('composite_index')} * 100, 6), 0) as integer) as score,
        case when {at('affordability')} >= 0.8 then 'Tight' when {at('affordability')} >= 0.5 then 'Moderate' else 'Comfortable' end as affordability,
        case when {at('price_to_rent')} >= 0.7 then 'Elevated' when {at('price_to_rent')} >= 0.4 then 'Balanced' else 'Attractive' end as price_to_rent,
        case when {at('inventory')} < 0.4 then 'Low' when {at('inventory')} < 0.7 then 'Adequate' else 'High' end as inventory
        from b_risk_all group by 1"""


@query("serve_risk_gauge", gauge_sql("max"))
def _(t: Tables) -> DataFrame:
    return serve.serve_risk_gauge(all_risks(t))


@query("serve_risk_gauge_oldest", gauge_sql("min"))
def _(t: Tables) -> DataFrame:
    return serve.serve_risk_gauge(all_risks(t), keep="oldest")


@query(
    "serve_sentiment",
    """select id, date, city, sentiment_score, case when sentiment_score > 0.05 then 'POS' when sentiment_score < -0.05 then 'NEG' else 'NEU' end as sentiment_label, rank
       from (select *, row_number() over (partition by city order by date desc, id desc) as rank from b_scored) where rank <= 3""",
)
def _(t: Tables) -> DataFrame:
    return sentiment.lexicon_scores(serve.latest3_headlines(t.news), keep=["rank"])


@query(
    "anomaly_deviation",
    """select s.city, s.target, s.ds, round(s.y, 4) as value, round(f.yhat, 4) as expected, round((s.y - f.yhat) / nullif(f.yhat, 0) * 100, 4) as deviation_pct
       from b_series s join b_bt_seasonal f on f.city = s.city and f.target = s.target and f.predict_date = s.ds""",
)
def _(t: Tables) -> DataFrame:
    out = serve.anomaly_deviation(t.series, backtest_seasonal_naive(t.series_dense))
    return rounded(out, "value", "expected", "deviation_pct", digits=4)


@query(
    "serve_daily_anomaly_series",
    "select city, detect_date, round(value, 4) as value, is_anomaly from b_signals where target = 'price' order by 1, 2",
)
def _(t: Tables) -> DataFrame:
    return rounded(serve.daily_anomaly_series(anomalies.detect_zscore(t.series)), "value", digits=4)


@query(
    "city_report",
    """select city, 'forecast' as section, row_number() over (partition by city order by predict_date, model_name) as ord, predict_date as date,
         model_name as label, round(yhat, 4) as value, round(yhat_lower, 4) as lower, round(yhat_upper, 4) as upper from b_drift where target = 'price'
       union all select city, 'risk', row_number() over (partition by city order by predict_date desc, risk_type), predict_date, risk_type, round(risk_value, 4), null, null from b_risk_all
       union all select city, 'anomaly', rank, detect_date, target, round(anomaly_score, 4), null, null from
         (select *, row_number() over (partition by city order by detect_date desc, target) as rank from b_signals where is_anomaly) where rank <= 3""",
)
def _(t: Tables) -> DataFrame:
    t.stage("price_panel", "sales_monthly", "shipments")
    out = serve.city_report(facts_of_two_runs(t), all_risks(t), anomalies.detect_zscore(t.series))
    return rounded(out, "value", "lower", "upper", digits=4)
