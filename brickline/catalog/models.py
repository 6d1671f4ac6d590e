"""Feature, history and modelling jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF, Tables
from brickline.catalog.registry import CTES, add_ctes, query, rounded
from brickline.functions.dates import month_floor
from brickline.operators.panel import rolling_mean
from brickline.plans import additive, arima, baselines, decomposition, features, hedonic, history, learned, loess, periods, repeat_sales, sequence, statespace
from brickline.session import settle

TRAIN = "ds <= date '1999-12-01'"


def _interval(model: str, select_p: str, sd: str) -> str:
    return f"""select '{model}' as model_name, target, city,
        cast((year(ds) - 1999) * 12 + month(ds) - 12 as integer) as horizon_months, ds as predict_date,
        greatest(0, p) as yhat, greatest(0, p - 1.96 * sd) as yhat_lower, greatest(0, p + 1.96 * sd) as yhat_upper, y as y_true
        from ({select_p}) where ds > date '1999-12-01' and y is not null and p is not null"""


def _lag_sql(model: str, k: int) -> str:
    inner = f"""select *, sqrt(avg(case when {TRAIN} then (y - p) * (y - p) end) over (partition by city, target)) as sd
        from (select *, lag(y, {k}) over (partition by city, target order by ds) as p from b_enough)"""
    return _interval(model, inner, "sd")


add_ctes(
    {
        "b_enough": f"""select * from b_series_dense qualify
            count(case when {TRAIN} then y end) over (partition by city, target) >= 36
            and count(case when not ({TRAIN}) then y end) over (partition by city, target) >= 6""",
        "b_lag1": "select *, lag(y) over (partition by city, target order by ds) as x from b_enough",
        "b_ar1_fit": f"""select city, target, regr_slope(y, x) as b, regr_intercept(y, x) as a from b_lag1 where {TRAIN} group by 1, 2""",
        "b_ar1_rows": "select l.city, l.target, ds, y, a + b * x as p from b_lag1 l join b_ar1_fit f on l.city = f.city and l.target = f.target",
        "b_bt_naive": _lag_sql("naive_backtest", 1),
        "b_bt_seasonal": _lag_sql("seasonal_naive_backtest", 12),
        "b_bt_ar1": _interval(
            "ar1_backtest",
            f"select *, sqrt(avg(case when {TRAIN} then (y - p) * (y - p) end) over (partition by city, target)) as sd from b_ar1_rows",
            "sd",
        ),
        "b_backtests": "select * from b_bt_naive union all select * from b_bt_seasonal union all select * from b_bt_ar1",
        "b_drift": """select 'drift' as model_name, target, city, h as horizon_months, cast(last_ds + to_months(h) as date) as predict_date,
            greatest(0, last_y + h * drift) as yhat, greatest(0, last_y + h * drift - 1.96 * sd * sqrt(h)) as yhat_lower,
            greatest(0, last_y + h * drift + 1.96 * sd * sqrt(h)) as yhat_upper
            from (select city, target, max(ds) as last_ds, max_by(y, ds) as last_y,
                    (max_by(y, ds) - min_by(y, ds)) / (count(*) - 1) as drift, stddev_samp(d) as sd
                  from (select *, y - lag(y) over (partition by city, target order by ds) as d from b_series where y is not null)
                  group by 1, 2), (select cast(unnest(generate_series(1, 60)) as integer) as h)""",
    }
)

add_ctes({"b_drift_long": CTES["b_drift"].replace("generate_series(1, 60)", "generate_series(1, 120)")})

YHAT = ["yhat", "yhat_lower", "yhat_upper"]
BACKTEST_SELECT = """select model_name, target, city, horizon_months, predict_date, round(yhat, 4) as yhat,
    round(yhat_lower, 4) as yhat_lower, round(yhat_upper, 4) as yhat_upper, round(y_true, 4) as y_true from """


def rounded_forecast(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c in [*YHAT, "y_true"] if c in df.columns], digits=4)


@query("backtest_naive", BACKTEST_SELECT + "b_bt_naive")
def _(t: Tables) -> DataFrame:
    return rounded_forecast(baselines.backtest_naive(t.series_dense))


@query("backtest_seasonal_naive", BACKTEST_SELECT + "b_bt_seasonal")
def _(t: Tables) -> DataFrame:
    return rounded_forecast(baselines.backtest_seasonal_naive(t.series_dense))


@query("backtest_ar1", BACKTEST_SELECT + "b_bt_ar1")
def _(t: Tables) -> DataFrame:
    return rounded_forecast(baselines.backtest_ar1(t.series_dense))


@query("forecast_drift", BACKTEST_SELECT.replace(", round(y_true, 4) as y_true", "") + "b_drift")
def _(t: Tables) -> DataFrame:
    return rounded_forecast(baselines.forecast_drift(t.series))


# Regressors of the additive model, and the macro columns of the sequence model.
REGRESSORS = ["mortgage_rate", "unemployment_rate", "cpi_yoy", "roll_3", "roll_6"]
MACRO_COLUMNS = ["mortgage_rate", "unemployment_rate", "overnight_rate", "gdp_growth", "cpi_yoy"]


def panel(t: Tables) -> DataFrame:
    """All series without gaps, stored once: fit and prediction read the small table."""
    return settle(baselines.filled(t.series_dense), "series")


def panel_with_regressors(t: Tables) -> DataFrame:
    """All series with the macro columns of their city and month and their own rolling means up to the month before."""
    t.stage("price_panel", "sales_monthly", "shipments")
    macro = features.macro_by_city(t.macro, t.cities)
    wide = features.pivot_city_metrics(t.metrics, t.cities).join(macro, ["date", "city"], "full_outer")
    joined = t.series_dense.join(wide.withColumnRenamed("date", "ds"), ["city", "ds"], "left")
    rolls = {f"roll_{k}": rolling_mean("y", k, baselines.SERIES, "ds") for k in (3, 6)}
    earlier = Window.partitionBy(*baselines.SERIES).orderBy("ds")
    ended = joined.withColumns(rolls).withColumns({c: F.lag(c).over(earlier) for c in rolls})
    return settle(ended, "series-regressors")


@query("forecast_arima_panel")
def _(t: Tables) -> DataFrame:
    return arima.forecast_arima(panel(t))


@query("backtest_arima_panel")
def _(t: Tables) -> DataFrame:
    return arima.backtest_arima(panel(t))


@query("forecast_sarima_fixed")
def _(t: Tables) -> DataFrame:
    return statespace.forecast_fixed(panel(t), {"price": statespace.SEASONAL, "rent": statespace.PLAIN}, 36)


@query("forecast_additive_panel")
def _(t: Tables) -> DataFrame:
    return additive.forecast_additive(panel_with_regressors(t), REGRESSORS)


@query("backtest_additive_panel")
def _(t: Tables) -> DataFrame:
    return additive.backtest_additive(panel_with_regressors(t), REGRESSORS)


@query("forecast_sequence_panel")
def _(t: Tables) -> DataFrame:
    return sequence.forecast_sequence(panel_with_regressors(t), MACRO_COLUMNS)


@query("backtest_sequence_panel")
def _(t: Tables) -> DataFrame:
    return sequence.backtest_sequence(panel(t))


add_ctes(
    {
        "b_filled": """select city, target, ds, last_value(y ignore nulls) over (partition by city, target order by ds rows unbounded preceding) as y
            from b_series_dense""",
        "b_trend": """select *, case when count(y) over (partition by city, target order by ds rows between 6 preceding and 6 following) = 13 then
              (sum(y) over (partition by city, target order by ds rows between 6 preceding and 5 following)
               + sum(y) over (partition by city, target order by ds rows between 5 preceding and 6 following)) / 24 end as trend from b_filled""",
        "b_month_mean": "select city, target, month(ds) as m, avg(y - trend) as s from b_trend group by 1, 2, 3",
        "b_season": "select *, s - avg(s) over (partition by city, target) as seasonal from b_month_mean",
    }
)


@query(
    "stl_panel",
    """select t.city, t.target, ds, round(y, 4) as y, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(y - trend - seasonal, 4) as resid
       from b_trend t join b_season s on s.city = t.city and s.target = t.target and s.m = month(t.ds)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(decomposition.decompose(t.series_dense), "y", "trend", "seasonal", "resid", digits=4)


@query(
    "stationarity_panel",
    """select city, target, n_obs, round(t, 4) as t_stat, coalesce(t < -2.89, false) as is_stationary from (
         select city, target, cast(regr_count(d, x) as bigint) as n_obs,
           regr_slope(d, x) / sqrt(((regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x)) / (regr_count(d, x) - 2)) / regr_sxx(d, x)) as t
         from (select *, y - x as d from (select *, lag(y) over (partition by city, target order by ds) as x from b_filled)) group by 1, 2)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(decomposition.unit_root(t.series_dense), "t_stat", digits=4)


@query("stl_robust_panel")
def _(t: Tables) -> DataFrame:
    return loess.robust_decomposition(t.series_dense)


@query("stationarity_augmented")
def _(t: Tables) -> DataFrame:
    return decomposition.augmented_unit_root(t.series_dense)


def _critical_sql(powers: tuple[float, ...]) -> str:
    return " + ".join(f"({c}) / power(n, {k})" for k, c in enumerate(powers))


@query(
    "stationarity_one_lag",
    """select city, target, cast(n as bigint) as n_obs, round(b / sqrt((dd - b * xd - c * zd) / (n - 3) * zz / det), 4) as t_stat, """
    + ", ".join(f"round({_critical_sql(powers)}, 6) as {name}" for name, powers in decomposition.CRITICAL.items())
    + """ from (select *, (xd * zz - zd * xz) / det as b, (zd * xx - xd * xz) / det as c from (select *, xx * zz - xz * xz as det from (
         select city, target, count(*) as n, count(*) * var_pop(x) as xx, count(*) * var_pop(z) as zz, count(*) * var_pop(d) as dd,
           count(*) * covar_pop(x, z) as xz, count(*) * covar_pop(x, d) as xd, count(*) * covar_pop(z, d) as zd
         from (select *, lag(d) over (partition by city, target order by ds) as z
               from (select *, y - x as d from (select *, lag(y) over (partition by city, target order by ds) as x from b_filled)))
         where d is not null and z is not null group by 1, 2)))""",
)
def _(t: Tables) -> DataFrame:
    tested = decomposition.augmented_unit_root(t.series_dense, fixed=1).drop("lags", "p_value", "is_stationary")
    return rounded(rounded(tested, "t_stat", digits=4), *decomposition.CRITICAL, digits=6)


SIMILAR = ["hpi_benchmark", "rent_avg_city", "mortgage_rate", "unemployment_rate", "overnight_rate"]


@query(
    "period_similarity",
    "select p.city, p.date, round(("
    + " + ".join(f"p.{c} * n.{c}" for c in SIMILAR)
    + ") / nullif(sqrt("
    + " + ".join(f"p.{c} * p.{c}" for c in SIMILAR)
    + ") * sqrt("
    + " + ".join(f"n.{c} * n.{c}" for c in SIMILAR)
    + "), 0), 4) as similarity from b_z p join (select * from b_z qualify row_number() over (partition by city order by date desc) = 1) n on p.city = n.city where p.date < n.date",
)
def _(t: Tables) -> DataFrame:
    scored = features.model_features_from(t)
    return rounded(decomposition.period_similarity(scored, [f"{c}_z" for c in SIMILAR]), "similarity", digits=4)


def _windows_sql(length: int) -> str:
    frame = f"over (partition by city, k order by date rows between {length - 1} preceding and current row)"
    return f"""select city, {length} as months, date, match_date, round(s, 6) as s from (
        select city, date, match_date, k, sum(sq) {frame} as s, count(*) {frame} as n from b_z_pairs) where n = {length} and k >= {length}"""


def _pairs_sql() -> dict[str, str]:
    squares = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SIMILAR)
    return {
        "b_z_numbered": "select *, row_number() over (partition by city order by date) as i from b_z",
        "b_z_pairs": f"""select a.city, a.date, b.date as match_date, a.i - b.i as k, {squares} as sq
            from b_z_numbered a join b_z_numbered b on a.city = b.city and a.i > b.i""",
        "b_z_windows": " union all ".join(_windows_sql(length) for length in periods.MONTHS),
    }


def _z_columns() -> list[str]:
    return [f"{c}_z" for c in SIMILAR]


@query(
    "period_profile",
    """select city, months, date, match_date, round(sqrt(s), 4) as distance from (
         select * from b_z_windows union all select city, months, match_date as date, date as match_date, s from b_z_windows)
       qualify row_number() over (partition by city, months, date order by s, match_date) = 1""",
)
def _(t: Tables) -> DataFrame:
    return rounded(periods.period_profile(features.model_features_from(t), _z_columns()), "distance", digits=4)


@query(
    "period_matches",
    """select city, months, date, match_date, round(sqrt(s), 4) as distance, cast(rank as integer) as rank from (
         select *, row_number() over (partition by city, months order by s, match_date) as rank
         from (select * from b_z_windows qualify date = max(date) over (partition by city))) where rank <= 5""",
)
def _(t: Tables) -> DataFrame:
    return rounded(periods.period_matches(features.model_features_from(t), _z_columns()), "distance", digits=4)


add_ctes(
    {
        "b_z": "select city, date, "
        + ", ".join(f"coalesce(({c} - avg({c}) over c) / (stddev_samp({c}) over c + 1e-6), 0) as {c}" for c in SIMILAR)
        + " from b_derived window c as (partition by city) qualify row_number() over (partition by city order by date) > 12",
        **_pairs_sql(),
    }
)


def price_predictions(t: Tables) -> DataFrame:
    rows = history.build_history_from(t)
    return learned.train_price_model(rows, ["price", "rent", "median_income", "mortgage_rate"], "target_12m", CUTOFF)


@query("train_price_model")
def _(t: Tables) -> DataFrame:
    return price_predictions(t)


@query("train_price_model_scores")
def _(t: Tables) -> DataFrame:
    return learned.prediction_scores(price_predictions(t))


@query("hedonic_regression")
def _(t: Tables) -> DataFrame:
    """Types and kinds of listing; places and months are absorbed, errors are clustered by place."""
    sales = t.sales.withColumn("month", month_floor(F.col("date_posted")))
    return hedonic.hedonic_regression(sales, ["property_type", "listing_type"], absorbed=["city", "month"], cluster="city")


# One key is absorbed by centring once, and two regressors are solved by hand, so this much can be said in SQL.
@query(
    "hedonic_by_city",
    """select term, round(b, 6) as coefficient, round(e, 6) as std_error, round(b / e, 4) as t_value from (
         with r as (select city, ln(price) - avg(ln(price)) over c as y, z - avg(z) over c as x from
             (select city, price, case listing_type when 'sale' then 1.0 else 0.0 end as z from b_sales) window c as (partition by city)),
         f as (select sum(x * y) / sum(x * x) as b, sum(x * x) as xx, count(*) as n, count(distinct city) as g from r),
         s as (select city, sum(x * (y - b * x)) as s from r, f group by city)
         select 'listing_type=sale' as term, any_value(b) as b,
           sqrt(any_value(g / (g - 1.0) * (n - 1.0) / (n - 1 - g)) * sum(s * s)) / any_value(xx) as e from s, f)""",
)
def _(t: Tables) -> DataFrame:
    out = hedonic.hedonic_regression(t.sales, ["listing_type"], absorbed=["city"], cluster="city")
    return rounded(rounded(out, "coefficient", "std_error"), "t_value", digits=4)


SUMS_SQL = """select province, first_month, second_month, count(*) as n, round(sum(d), 6) as total, round(sum(d * d), 6) as squares from (
     select province, cast(date_trunc('month', d0) as date) as first_month, cast(date_trunc('month', date_posted) as date) as second_month, ln(price / p0) as d from (
       select province, date_posted, price, lag(price) over w as p0, lag(date_posted) over w as d0
       from b_sales window w as (partition by unit_id order by date_posted, listing_id)) where d0 is not null)
   where first_month < second_month group by all"""


@query("repeat_sales_sums", SUMS_SQL)
def _(t: Tables) -> DataFrame:
    return rounded(repeat_sales.pair_sums(t.sales, ["province"]), "total", "squares")


@query("repeat_sales_index")
def _(t: Tables) -> DataFrame:
    return repeat_sales.repeat_sales_index(t.sales)
