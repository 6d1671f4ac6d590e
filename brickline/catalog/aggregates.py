"""Grouped aggregates, quality profiles and top-k categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import NOISE_DIGITS, add_ctes, query, rounded
from brickline.functions.text import strip_model_suffix
from brickline.operators import aggregates, panel, quality, topk
from brickline.plans import demographics, evaluate
from brickline.plans.baselines import all_backtests, forecast_drift
from brickline.plans.risk import affordability, composite_risk, horizon_risks, risk_components


@query(
    "listings_monthly",
    """select cast(date_trunc('month', date_posted) as date) as date, city, count(*) as listings_count,
       count(*) filter (where listing_type = 'sale') as new_listings,
       round(count(*) filter (where listing_type = 'sale') / count(*), 3) as sales_to_listings_ratio
       from b_sales group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return aggregates.listings_monthly(t.sales)


@query(
    "price_index_from_sales",
    """select city, cast(date_trunc('month', date_posted) as date) as date, round(median(price), 4) as index_value,
       round(median(price) filter (where property_type = 'House'), 4) as median_price_house,
       round(median(price) filter (where property_type = 'Condo'), 4) as median_price_condo,
       count(*) as active_listings_count from b_sales group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    out = aggregates.price_index_from_sales(t.sales)
    return rounded(out, "index_value", "median_price_house", "median_price_condo", digits=4)


add_ctes(
    {
        "b_typed": """select city, cast(date_trunc('month', date_posted) as date) as date, property_type, avg(price) as price,
            count(*) as n, max(price) as top from b_sales group by 1, 2, 3""",
    }
)


def typed(t: Tables) -> DataFrame:
    month = F.trunc("date_posted", "MM").alias("date")
    return t.sales.groupBy("city", month, "property_type").agg(
        F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"), F.max("price").alias("top")
    )


@query(
    "collapse_to_city",
    "select city, date, round(median(price), 4) as price, median(n) as n, round(median(top), 4) as top from b_typed group by 1, 2",
)
def _(t: Tables) -> DataFrame:
    return rounded(aggregates.collapse_to_city(typed(t), ["price", "n", "top"]), "price", "top", digits=4)


@query(
    "mean_by_key",
    "select city, year(date_posted) as year, round(avg(price), 4) as price from b_sales group by 1, 2",
)
def _(t: Tables) -> DataFrame:
    keyed = t.sales.withColumn("year", F.year("date_posted").cast("bigint"))
    return rounded(aggregates.mean_by_key(keyed, ["city", "year"], ["price"]), "price", digits=4)


@query(
    "net_migration",
    """select r_name as province, cast(year(l_shipdate) as integer) as year,
       round(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) / 1000, 2) as migration_rate
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return demographics.net_migration_by_province(t)


@query(
    "signed_component",
    """select l_returnflag as component, case when l_returnflag = 'R' then -1 else 1 end as sign, sum(l_quantity) as total
       from lineitem group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return demographics.migration_components(t).groupBy(
        F.col("flag").alias("component"), "sign"
    ).agg(F.sum("value").alias("total"))


@query(
    "price_yoy_flagship",
    """select city, date, round(y, 4) as y,
       round((y / lag(y, 12) over (partition by city order by date) - 1) * 100, 4) as yoy_pct from b_dense""",
)
def _(t: Tables) -> DataFrame:
    out = t.price_dense.withColumn("yoy_pct", panel.yoy("y", ["city"]) * 100)
    return rounded(out, "y", "yoy_pct", digits=4)


def backtests_in_thousands(t: Tables) -> DataFrame:
    """Prices in thousands, so that four digits of a squared error are within what a double holds."""
    return all_backtests(t.series_dense).withColumns({c: F.col(c) / 1000 for c in ("y_true", "yhat")})


def scores_in_thousands(t: Tables, with_horizon: bool = True) -> DataFrame:
    """Scores without float noise, so that ties at the last digit round alike in both engines."""
    scored = evaluate.score_models(backtests_in_thousands(t), with_horizon, digits=NOISE_DIGITS)
    return rounded(scored, *evaluate.SCORE_COLUMNS, digits=4)


add_ctes({"b_thousands": "select * replace (y_true / 1000 as y_true, yhat / 1000 as yhat) from b_backtests"})
SCORES = """round(avg(abs(y_true - yhat)), 4) as mae, round(avg(abs((y_true - yhat) / y_true)) * 100, 4) as mape,
    round(sqrt(avg((y_true - yhat) * (y_true - yhat))), 4) as rmse, round(avg((y_true - yhat) * (y_true - yhat)), 4) as mse,
    round(1 - sum((y_true - yhat) * (y_true - yhat)) / nullif(var_pop(y_true) * count(*), 0), 4) as r2"""


@query(
    "score_models",
    f"""select replace(model_name, '_backtest', '') as model_name, city, target, horizon_months, {SCORES}
        from b_thousands group by 1, 2, 3, 4""",
)
def _(t: Tables) -> DataFrame:
    scored = scores_in_thousands(t)
    return scored.withColumn("model_name", strip_model_suffix(F.col("model_name")))


@query(
    "score_models_overall",
    f"select model_name, city, target, {SCORES} from b_thousands group by 1, 2, 3",
)
def _(t: Tables) -> DataFrame:
    return scores_in_thousands(t, with_horizon=False)


@query(
    "store_model_scores",
    f"""select city, target, horizon_months, model_name, {SCORES},
          case model_name when 'seasonal_naive_backtest' then '2001-01-01' else '2002-01-01' end as evaluated
        from b_thousands group by 1, 2, 3, 4""",
)
def _(t: Tables) -> DataFrame:
    """A first evaluation of two models, then a second one in which one of them is scored again and a third comes in."""
    scored = scores_in_thousands(t)
    first = scored.filter("model_name <> 'ar1_backtest'").withColumn("evaluated_at", F.lit("2001-01-01").cast("timestamp"))
    stored = first.select(*evaluate.SCORE_KEYS, *evaluate.SCORE_COLUMNS, "evaluated_at")
    second = scored.filter("model_name <> 'seasonal_naive_backtest'")
    out = evaluate.store_scores(stored, second, "2002-01-01")
    return out.withColumn("evaluated", F.date_format("evaluated_at", "yyyy-MM-dd")).drop("evaluated_at")


def best_sql(missing: str) -> str:
    parts = []
    for m in ("mae", "mape", "rmse", "mse", "r2"):
        value = f"coalesce({m}, 0)" if missing == "zero" else m
        sign = "desc" if m == "r2" else "asc"
        parts.append(
            f"""select city, target, '{m}' as metric, model_name as best_model from
                (select city, target, model_name, avg({value}) as v from scored group by 1, 2, 3)
                where v is not null
                qualify row_number() over (partition by city, target order by v {sign}, model_name) = 1"""
        )
    return (
        f"select * from (with scored as (select model_name, city, target, horizon_months, {SCORES} from b_thousands group by 1, 2, 3, 4) "
        + " union all ".join(parts)
        + ")"
    )


@query("best_model_per_metric", best_sql("skip"))
def _(t: Tables) -> DataFrame:
    return evaluate.best_model_per_metric(scores_in_thousands(t))


@query("best_model_per_metric_zero", best_sql("zero"))
def _(t: Tables) -> DataFrame:
    scored = scores_in_thousands(t)
    return evaluate.best_model_per_metric(scored, missing="zero")


add_ctes(
    {
        "b_ratio": """select p.city, p.date, p.y as price, p.y / nullif(12 * r.y, 0) as ratio, l.n as listings
            from b_price p left join b_rent r on p.city = r.city and p.date = r.date
            left join (select city, cast(date_trunc('month', date_posted) as date) as date, count(*) as n from b_sales group by 1, 2) l
            on p.city = l.city and p.date = l.date""",
        "b_risk_parts": """select city, date,
              least(price / 1000000, 1) as affordability,
              (ratio - min(ratio) over (partition by city)) / nullif(max(ratio) over (partition by city) - min(ratio) over (partition by city), 0) as price_to_rent,
              (listings - min(listings) over (partition by city)) / nullif(max(listings) over (partition by city) - min(listings) over (partition by city), 0) as inventory
            from b_ratio""",
        "b_risk": """select city, date as predict_date, risk_type, risk_value from
              (select * from b_risk_parts) unpivot (risk_value for risk_type in (affordability, price_to_rent, inventory))""",
        "b_risk_all": """select city, predict_date, risk_type, risk_value from b_risk
            union all select city, predict_date, 'composite_index', avg(risk_value) from b_risk group by 1, 2""",
    }
)


@query(
    "affordability",
    "select city, round(least(max_by(y, date) / 1000000, 1), 6) as risk_value, max(date) as predict_date from b_price group by 1",
)
def _(t: Tables) -> DataFrame:
    return rounded(affordability(t.price_panel.withColumnRenamed("date", "ds"), ["city"]), "risk_value")


@query(
    "risk_by_horizon",
    """select city, target, model_name, h as horizon_months, max(predict_date) as predict_date, 'affordability' as risk_type,
         round(least(max_by(yhat, predict_date) / 1000000, 1), 6) as risk_value
       from b_drift_long, (select unnest([12, 24, 60, 120]) as h) where horizon_months <= h group by 1, 2, 3, 4""",
)
def _(t: Tables) -> DataFrame:
    return rounded(horizon_risks(forecast_drift(t.series, 120), [12, 24, 60, 120]), "risk_value")


@query(
    "risk_components",
    "select city, predict_date, risk_type, round(risk_value, 6) as risk_value from b_risk",
)
def _(t: Tables) -> DataFrame:
    return rounded(risk_components(t), "risk_value")


@query(
    "composite_risk",
    """select city, predict_date, 'composite_index' as risk_type, round(avg(risk_value), 6) as risk_value
       from b_risk group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return rounded(composite_risk(risk_components(t)), "risk_value")


@query(
    "key_uniqueness",
    """select 'orders' as table_name, count(*) as n_rows, count(distinct o_orderkey) as n_keys from orders
       union all select 'lineitem', count(*), (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) from lineitem
       union all select 'price_panel', count(*), (select count(*) from (select distinct city, date from b_price)) from b_price""",
)
def _(t: Tables) -> DataFrame:
    return quality.key_uniqueness(
        {
            "orders": (t.raw("orders"), ["o_orderkey"]),
            "lineitem": (t.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
            "price_panel": (t.price_panel, ["city", "date"]),
        }
    )


@query("freshness", "select metric, max(date) as last_date from b_metrics group by 1")
def _(t: Tables) -> DataFrame:
    return quality.freshness(t.metrics, "metric")


@query(
    "time_coverage",
    """select 'sales' as table_name, min(date_posted) as first_date, max(date_posted) as last_date,
         count(*) filter (where price is null) as n_null from b_sales
       union all select 'metrics', min(date), max(date), count(*) filter (where value is null) from b_metrics
       union all select 'price_dense', min(date), max(date), count(*) filter (where y is null) from b_dense""",
)
def _(t: Tables) -> DataFrame:
    return quality.time_coverage(
        {
            "sales": (t.sales, "date_posted", "price"),
            "metrics": (t.metrics, "date", "value"),
            "price_dense": (t.price_dense, "date", "y"),
        }
    )


@query(
    "validate_prices",
    """select 'duplicate_key' as rule, (select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_rows
       union all select 'not_positive', count(*) from lineitem where l_extendedprice <= 0
       union all select 'too_large', count(*) from lineitem where l_extendedprice >= 60000""",
)
def _(t: Tables) -> DataFrame:
    return quality.validate_prices(t.raw("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", 60000)


@query(
    "missing_profile",
    """select name as column_name, sum(is_null) as n_null, round(sum(is_null) / count(*), 6) as null_share from (
         select unnest(['date', 'city', 'discount', 'n', 'quantity', 'tax', 'unit_price', 'mean_price', 'population']) as name,
           unnest([date is null, s.city is null, discount is null, n is null, quantity is null, tax is null, unit_price is null,
                   p.y is null, a.population is null]) :: integer as is_null
         from b_ships s left join b_price p using (city, date) left join b_annual a on a.city = s.city and a.year = year(date))
       group by 1""",
)
def _(t: Tables) -> DataFrame:
    price = t.price_panel.withColumnRenamed("y", "mean_price")
    people = t.annual.select("city", "year", "population")
    ships = t.shipments.select("date", "city", "discount", "n", "quantity", "tax", "unit_price")
    wide = ships.join(price, ["city", "date"], "left").withColumn("year", F.year("date")).join(people, ["city", "year"], "left")
    return quality.missing_profile(wide.drop("year"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe_sql(table: str, columns: list[str], key: str | None = None) -> str:
    group = f"{key}, " if key else ""
    tail = f" group by {key}" if key else ""
    parts = [
        f"""select {group}'{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
            min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50,
            round(quantile_cont({c}, 0.75), 6) as q75, max({c}) as max from {table}{tail}"""
        for c in columns
    ]
    return " union all ".join(parts)


@query("describe_numeric", describe_sql("lineitem", NUMERIC))
def _(t: Tables) -> DataFrame:
    return rounded(quality.describe_numeric(t.raw("lineitem"), NUMERIC), "mean", "std", "q25", "q50", "q75")


@query("describe_numeric_grouped", describe_sql("b_sales", ["price"], "city"))
def _(t: Tables) -> DataFrame:
    return rounded(quality.describe_numeric(t.sales, ["price"], ["city"]), "mean", "std", "q25", "q50", "q75")


@query("value_counts_top", "select city, count(*) as n from b_sales group by 1 order by n desc, city limit 10")
def _(t: Tables) -> DataFrame:
    return aggregates.value_counts_top(t.sales, "city", 10)


@query(
    "histogram",
    """select least(29, cast(floor((o_totalprice - lo) / (hi - lo) * 30) as integer)) as bin, count(*) as n
       from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) group by 1""",
)
def _(t: Tables) -> DataFrame:
    return quality.histogram(t.raw("orders"), "o_totalprice")


def corr_sql(columns: list[str]) -> str:
    return " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


@query("correlation_matrix", corr_sql(NUMERIC))
def _(t: Tables) -> DataFrame:
    return quality.correlation_matrix(t.raw("lineitem"), NUMERIC)


@query(
    "top_correlations",
    f"select * from ({corr_sql(NUMERIC)}) order by abs(corr) desc, a, b limit 5",
)
def _(t: Tables) -> DataFrame:
    return quality.top_correlations(quality.correlation_matrix(t.raw("lineitem"), NUMERIC))


OUTLIER_COLUMNS = ["unit_price", "discount", "quantity"]


@query(
    "outlier_counts",
    " union all ".join(
        f"""select '{c}' as column_name, count(*) filter (where abs(({c} - m) / s) > 2) as n_outliers
            from b_ships, (select avg({c}) as m, stddev_pop({c}) as s from b_ships)"""
        for c in OUTLIER_COLUMNS
    ),
)
def _(t: Tables) -> DataFrame:
    return quality.outlier_counts(t.shipments, OUTLIER_COLUMNS, 2.0)


@query(
    "mean_over_time",
    """select scope, date, round(avg(price), 4) as mean_price from (
         select 'all' as scope, cast(date_trunc('month', date_posted) as date) as date, price from b_sales
         union all
         select city, cast(date_trunc('month', date_posted) as date), price from b_sales
         where city in (select city from b_sales group by city order by count(*) desc, city limit 5)) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    month = F.trunc("date_posted", "MM").alias("date")
    top5 = aggregates.value_counts_top(t.sales, "city", 5).select("city")
    per_city = t.sales.groupBy("city", month).agg(F.sum("price").alias("s"), F.count("price").alias("c"))
    mean = (F.sum("s") / F.sum("c")).alias("mean_price")
    overall = per_city.groupBy("date").agg(mean).select(F.lit("all").alias("scope"), "date", "mean_price")
    leaders = per_city.join(top5, "city", "left_semi").groupBy(F.col("city").alias("scope"), "date").agg(mean)
    return rounded(overall.unionByName(leaders), "mean_price", digits=4)


REPORTED = ["n", "unit_price", "discount", "tax", "quantity"]


def report_sql() -> str:
    """Every section of the report over the shipments table, column by column."""
    columns = ["city", "date", *REPORTED]
    pairs = [(a, b) for i, a in enumerate(REPORTED) for b in REPORTED[i + 1 :]]
    parts = ["select 'size' as section, 'rows' as name, cast(count(*) as varchar) as value from b_ships"]
    parts.append(f"select 'size', 'columns', '{len(columns)}'")
    parts += [f"select 'missing', '{c}', cast(count(*) - count({c}) as varchar) from b_ships" for c in columns]
    parts += [f"select 'correlation', '{a}~{b}', printf('%.3f', corr({a}, {b})) from b_ships" for a, b in pairs]
    outlying = "cast(count(*) filter (where abs(({c} - m) / s) > 3) as varchar)"
    moments = "(select avg({c}) as m, stddev_pop({c}) as s from b_ships)"
    parts += [f"select 'outliers', '{c}', {outlying.format(c=c)} from b_ships, {moments.format(c=c)}" for c in REPORTED]
    parts += [f"select 'time', '{name}', cast({f}(date) as varchar) from b_ships" for name, f in (("first", "min"), ("last", "max"))]
    return " union all ".join(parts)


@query("quality_report", report_sql())
def _(t: Tables) -> DataFrame:
    return quality.quality_report(t.shipments, REPORTED, k=10)


@query(
    "city_population_snapshot",
    """select city, date, cast(population as bigint) as population, cast(migration_rate as double) as migration_rate from (
         select a.city, make_date(a.year, 1, 1) as date, a.population, coalesce(r.rate, 1.0) as migration_rate
         from b_annual a join (select city, max(year) as year from b_annual group by 1) l on a.city = l.city and a.year = l.year
         join b_cities c on a.city = c.city left join (values ('AFRICA', 0.95), ('ASIA', 1.05), ('EUROPE', 0.83)) r(province, rate) on r.province = c.province
         union all
         select 'Canada', make_date(max(year), 1, 1), sum(population) filter (where year = (select max(year) from b_annual)), 1.0 from b_annual)""",
)
def _(t: Tables) -> DataFrame:
    rates = t.spark.sql(
        "select * from values ('AFRICA', 0.95D), ('ASIA', 1.05D), ('EUROPE', 0.83D) as r(province, rate)"
    )
    return demographics.population_snapshot(t.annual, t.cities, rates)


@query(
    "listings_rollup",
    """select province, city, count(*) as listings, grouping(province) + grouping(city) as level
       from b_sales group by rollup (province, city)""",
)
def _(t: Tables) -> DataFrame:
    return t.sales.rollup("province", "city").agg(
        F.count(F.lit(1)).alias("listings"), (F.grouping("province") + F.grouping("city")).cast("bigint").alias("level")
    )

