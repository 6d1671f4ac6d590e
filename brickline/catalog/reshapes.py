"""Wide and long forms, nesting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.operators import reshape
from brickline.plans import evaluate, features, serve
from brickline.plans.baselines import all_backtests, forecast_drift, backtest_naive

@query("melt_years", "select city, year, cast(population as varchar) as population from b_annual")
def _(t: Tables) -> DataFrame:
    years = [str(r["year"]) for r in t.annual.select("year").distinct().orderBy("year").collect()]
    wide = t.annual.groupBy("city").pivot("year", years).agg(F.max(F.col("population").cast("string")))
    return reshape.melt_years(wide, ["city"], "population").filter("population is not null")


add_ctes(
    {
        "b_by_type": """select city, cast(date_trunc('month', date_posted) as date) as date, property_type, avg(price) as price
            from b_sales group by 1, 2, 3""",
    }
)


def wide_types(t: Tables, kinds: list[str]) -> DataFrame:
    month = F.trunc("date_posted", "MM").alias("date")
    means = [F.avg(F.when(F.col("property_type") == k, F.col("price"))).alias(f"{k}_Benchmark") for k in kinds]
    return t.sales.groupBy("city", month).agg(*means) if means else t.sales.select("city", month).distinct()


@query(
    "melt_measures",
    """select city, date, lower(property_type) as measure, round(price, 4) as value from b_by_type""",
)
def _(t: Tables) -> DataFrame:
    kinds = sorted(r["property_type"] for r in t.sales.select("property_type").distinct().collect())
    long = reshape.melt_measures(wide_types(t, kinds), ["city", "date"], {f"{k}_Benchmark": k.lower() for k in kinds})
    return rounded(long, "value", digits=4)


@query(
    "melt_city_matrix",
    "select date, city, round(y, 4) as value from b_price",
)
def _(t: Tables) -> DataFrame:
    names = [r["city"] for r in t.cities.select("city").distinct().orderBy("city").collect()]
    matrix = t.price_panel.groupBy("date").agg(
        *[F.max(F.when(F.col("city") == c, F.col("y"))).alias(c) for c in names],
        *[F.avg("y").alias(c) for c in ("Composite_HPI", "Apartment", "Single_Family_Benchmark", "Detached")],
    )
    return rounded(reshape.melt_city_matrix(matrix, "date"), "value", digits=4)


@query(
    "pivot_metrics",
    """select date, city, round(mortgage_rate, 6) as mortgage_rate, round(unemployment_rate, 6) as unemployment_rate,
         round(overnight_rate, 6) as overnight_rate from b_metric_wide""",
)
def _(t: Tables) -> DataFrame:
    wide = features.pivot_city_metrics(t.metrics, t.cities)
    return rounded(wide, "mortgage_rate", "unemployment_rate", "overnight_rate")


@query("nest_by_model")
def _(t: Tables) -> DataFrame:
    return serve.serve_model_comparison(evaluate.score_models(all_backtests(t.series_dense)))


@query(
    "pivot_models_by_horizon",
    """select city, target, horizon_months, round(max(yhat) filter (where model_name = 'naive_backtest'), 4) as naive_backtest,
         round(max(yhat) filter (where model_name = 'seasonal_naive_backtest'), 4) as seasonal_naive_backtest,
         round(max(yhat) filter (where model_name = 'ar1_backtest'), 4) as ar1_backtest
       from b_backtests group by 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    models = ["naive_backtest", "seasonal_naive_backtest", "ar1_backtest"]
    out = reshape.pivot_models_by_horizon(all_backtests(t.series_dense), models)
    return rounded(out, *models, digits=4)


@query(
    "union_sources",
    """select date, city, metric, round(value, 6) as value, source from b_metrics
       union all select date, city, 'rent', round(y, 6), null from b_rent""",
)
def _(t: Tables) -> DataFrame:
    rent = t.rent_panel.select("date", "city", F.lit("rent").alias("metric"), F.col("y").alias("value"))
    return rounded(t.metrics.unionByName(rent, allowMissingColumns=True), "value")


@query(
    "union_forecasts",
    """select model_name, target, city, predict_date, round(yhat, 4) as yhat from b_drift
       union all select model_name, target, city, predict_date, round(yhat, 4) from b_bt_naive""",
)
def _(t: Tables) -> DataFrame:
    columns = ["model_name", "target", "city", "predict_date", "yhat"]
    out = forecast_drift(t.series).select(*columns).unionByName(backtest_naive(t.series_dense).select(*columns))
    return rounded(out, "yhat", digits=4)


@query("distinct_cities", "select distinct city from b_sales order by 1")
def _(t: Tables) -> DataFrame:
    return serve.distinct_cities(t.sales)


@query(
    "missing_months",
    "select city, date from b_grid except select city, date from b_price",
)
def _(t: Tables) -> DataFrame:
    from brickline.bindings import FIRST_MONTH, LAST_MONTH
    from brickline.operators.joins import month_city_grid

    grid = month_city_grid(t.cities, FIRST_MONTH, LAST_MONTH).select("city", "date")
    return grid.join(t.price_panel.select("city", "date"), ["city", "date"], "left_anti")
