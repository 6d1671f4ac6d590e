"""Grids, lookup joins and the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import FIRST_MONTH, LAST_MONTH, Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.operators import joins
from brickline.plans import features
from brickline.schemas import DERIVED_MEASURES, RAW_MEASURES

add_ctes(
    {
        "b_grid": """select city, cast(unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 month)) as date) as date
            from b_cities""",
        "b_national": "select date, c.city, metric, value, source from b_metrics m, b_cities c where m.city = 'Canada'",
        "b_metric_wide": """select date, city,
              arg_min(value, source) filter (where metric = 'mortgage_rate') as mortgage_rate,
              arg_min(value, source) filter (where metric = 'unemployment_rate') as unemployment_rate,
              arg_min(value, source) filter (where metric = 'overnight_rate') as overnight_rate
            from (select * from b_metrics where city <> 'Canada' union all select * from b_national) group by 1, 2""",
        "b_macro_city": """select date, city, max(gdp_growth) as gdp_growth, max(cpi_yoy) as cpi_yoy from (
              select date, city, gdp_growth, cpi_yoy from b_macro where city <> 'Canada'
              union all select date, c.city, gdp_growth, cpi_yoy from b_macro m, b_cities c where m.city = 'Canada') group by 1, 2""",
        "b_features_raw": """select g.date, g.city, coalesce(p.y, 0) as hpi_benchmark, r.y as rent_avg_city,
              mortgage_rate, unemployment_rate, overnight_rate, cast(coalesce(population, 0) as bigint) as population,
              coalesce(migration_rate, 0) as migration_rate, coalesce(median_income, 0) as median_income, gdp_growth, cpi_yoy
            from b_grid g left join b_price p on p.city = g.city and p.date = g.date
            left join b_rent r on r.city = g.city and r.date = g.date
            left join b_metric_wide m on m.city = g.city and m.date = g.date
            left join b_demo d on d.city = g.city and d.date = g.date
            left join b_macro_city x on x.city = g.city and x.date = g.date""",
        "b_features_pad": """select *, last_value(rent_avg_city ignore nulls) over (partition by city order by date rows unbounded preceding) as rent_pad,
            last_value(hpi_benchmark ignore nulls) over (partition by city order by date rows unbounded preceding) as hpi_pad
            from b_features_raw""",
        "b_features": """select * exclude (rent_pad, hpi_pad),
            coalesce((hpi_benchmark / nullif(lag(hpi_benchmark, 12) over w, 0) - 1) * 100, 0) as hpi_change_yoy,
            coalesce((rent_pad / nullif(lag(rent_pad, 12) over w, 0) - 1) * 100, 0) as rent_change_yoy, 'features_v1' as source
            from b_features_pad window w as (partition by city order by date)""",
        "b_derived": """select city, date, hpi_benchmark, rent_avg_city, mortgage_rate, unemployment_rate, overnight_rate,
              cast(population as double) as population, median_income, migration_rate, gdp_growth, cpi_yoy,
              hpi_pad / nullif(lag(hpi_pad, 12) over w, 0) - 1 as hpi_benchmark_yoy,
              rent_pad / nullif(lag(rent_pad, 12) over w, 0) - 1 as rent_avg_city_yoy,
              lag(hpi_benchmark, 1) over w as lag_1, lag(hpi_benchmark, 3) over w as lag_3, lag(hpi_benchmark, 6) over w as lag_6,
              case when count(hpi_benchmark) over w3 = 3 then avg(hpi_benchmark) over w3 end as roll_3,
              case when count(hpi_benchmark) over w6 = 6 then avg(hpi_benchmark) over w6 end as roll_6,
              row_number() over w as rn
            from b_features_pad window w as (partition by city order by date),
              w3 as (partition by city order by date rows 2 preceding), w6 as (partition by city order by date rows 5 preceding)""",
    }
)


@query("month_city_grid", "select date, city from b_grid")
def _(t: Tables) -> DataFrame:
    return joins.month_city_grid(t.cities, FIRST_MONTH, LAST_MONTH)


FEATURE_DOUBLES = [c for c in RAW_MEASURES if c != "population"] + ["hpi_change_yoy", "rent_change_yoy"]


@query(
    "build_features",
    "select date, city, population, source, "
    + ", ".join(f"round({c}, 4) as {c}" for c in FEATURE_DOUBLES)
    + " from b_features",
)
def _(t: Tables) -> DataFrame:
    return rounded(features.build_features_from(t), *FEATURE_DOUBLES, digits=4)


ALL_MEASURES = RAW_MEASURES + DERIVED_MEASURES
Z_SQL = ", ".join(
    f"round(({c} - avg({c}) over c) / (stddev_samp({c}) over c + 1e-6), 4) as {c}_z" for c in ALL_MEASURES
)


@query(
    "model_features",
    "select * exclude (rn) from (select city, date, "
    + ", ".join(f"round({c}, 4) as {c}" for c in ALL_MEASURES)
    + f", {Z_SQL}, 'model_features_city_v1' as etl_version, rn from b_derived window c as (partition by city)) where rn > 12",
)
def _(t: Tables) -> DataFrame:
    out = features.model_features_from(t)
    return rounded(out, *ALL_MEASURES, *[f"{c}_z" for c in ALL_MEASURES], digits=4)


@query(
    "broadcast_province",
    """select c.city, p.date, round(p.cpi_index, 4) as cpi_index from b_province p join b_cities c using (province)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(joins.to_members(t.province_index, t.cities, "province"), "cpi_index", digits=4)


@query(
    "broadcast_national",
    """select date, city, metric, round(value, 6) as value, source from b_metrics
       union all select date, city, metric, round(value, 6), source from b_national""",
)
def _(t: Tables) -> DataFrame:
    return rounded(joins.broadcast_national(t.metrics, t.cities), "value")


@query(
    "attach_province_index",
    """select city, province, cast(coalesce(rate, 1.0) as double) as rate from b_cities
       left join (values ('AFRICA', 0.95), ('ASIA', 1.05), ('EUROPE', 0.83)) r(province, rate) using (province)""",
)
def _(t: Tables) -> DataFrame:
    rates = t.spark.sql(
        "select * from values ('AFRICA', 0.95D), ('ASIA', 1.05D), ('EUROPE', 0.83D) as r(province, rate)"
    )
    return joins.attach_province_rate(t.cities, rates)


@query(
    "year_to_month_lookup",
    """select g.date, g.city, a.median_income from b_grid g
       left join b_annual a on a.city = g.city and a.year = year(g.date)""",
)
def _(t: Tables) -> DataFrame:
    grid = joins.month_city_grid(t.cities, FIRST_MONTH, LAST_MONTH)
    return joins.year_to_month_lookup(grid, t.annual, "median_income")


add_ctes(
    {
        "b_present": "select a.city, year, median_income from b_annual a join b_cities c on c.city = a.city where province <> 'ASIA'",
        "b_absent": "select city from b_cities where city not in (select city from b_present)",
    }
)


def present_income(t: Tables) -> DataFrame:
    """Annual income of the cities outside one province; its cities are the missing members at any size."""
    named = t.cities.filter("province <> 'ASIA'").select("city")
    return t.annual.select("city", "year", "median_income").join(named, "city", "left_semi")


FILL_SQL = """select city, year, median_income from b_present
    union all select a.city, m.year, m.median_income from b_absent a,
      (select year, round(avg(median_income), 2) as median_income from b_present group by 1) m"""


@query("fill_missing_members", FILL_SQL)
def _(t: Tables) -> DataFrame:
    return joins.fill_missing_members(present_income(t), t.cities, "year", "median_income")


@query("missing_members", "select city from b_absent")
def _(t: Tables) -> DataFrame:
    return joins.missing_members(t.cities, present_income(t))


@query(
    "attach_regressors",
    """select s.city, s.target, s.ds, round(s.y, 4) as y, round(m.mortgage_rate, 6) as mortgage_rate, round(m.overnight_rate, 6) as overnight_rate
       from b_series s left join b_metric_wide m on m.city = s.city and m.date = s.ds""",
)
def _(t: Tables) -> DataFrame:
    wide = features.pivot_city_metrics(t.metrics, t.cities).withColumnRenamed("date", "ds")
    out = t.series.join(wide.drop("unemployment_rate"), ["city", "ds"], "left")
    return rounded(rounded(out, "y", digits=4), "mortgage_rate", "overnight_rate")


@query(
    "join_price_macro",
    """select p.city, p.date, round(p.y, 4) as y, m.city as macro_city, m.gdp_growth from b_price p
       join b_macro m on m.date = p.date where m.gdp_growth is not null""",
)
def _(t: Tables) -> DataFrame:
    macro = t.macro.filter("gdp_growth is not null").select("date", F.col("city").alias("macro_city"), "gdp_growth")
    return rounded(t.price_panel.join(macro, "date"), "y", digits=4)


SEQ_LAGS = (1, 3, 6, 12)
SEQ_ROLLS = (3, 6, 12)


@query(
    "build_sequence_features",
    "select city, date, round(y, 4) as y, round(rent, 4) as rent, round(cpi_yoy, 4) as cpi_yoy, population, "
    + ", ".join(f"round(lag(y, {k}) over w, 4) as lag_{k}" for k in SEQ_LAGS)
    + ", "
    + ", ".join(f"round(case when count(y) over w{k} = {k} then avg(y) over w{k} end, 4) as roll_{k}" for k in SEQ_ROLLS)
    + """, round(y / lag(y, 12) over w - 1, 6) as yoy from (
         select p.city, p.date, p.y, r.y as rent, m.cpi_yoy, d.population from b_dense p
         left join b_rent r on r.city = p.city and r.date = p.date
         left join b_macro_city m on m.city = p.city and m.date = p.date
         left join b_demo d on d.city = p.city and d.date = p.date)
       window w as (partition by city order by date), """
    + ", ".join(f"w{k} as (partition by city order by date rows {k - 1} preceding)" for k in SEQ_ROLLS),
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.sequence import build_sequence_features

    out = build_sequence_features(
        t.price_dense, t.rent_panel, features.macro_by_city(t.macro, t.cities), t.demographics, SEQ_LAGS, SEQ_ROLLS
    )
    names = ["y", "rent", "cpi_yoy", *[f"lag_{k}" for k in SEQ_LAGS], *[f"roll_{k}" for k in SEQ_ROLLS]]
    return rounded(rounded(out, *names, digits=4), "yoy")


@query(
    "scale_by_ratio",
    """select d.city, d.target, d.predict_date, s.property_type, round(d.yhat * s.rent_ratio, 4) as value_scaled
       from b_drift d join b_ratios s on s.city = d.city""",
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.baselines import forecast_drift

    macro = forecast_drift(t.series).select("city", "target", "predict_date", F.col("yhat").alias("value"))
    out = joins.scale_by_ratio(macro, segment_ratios(t))
    return rounded(out, "value_scaled", digits=4).select("city", "target", "predict_date", "property_type", "value_scaled")


add_ctes(
    {
        "b_ratios": """select city, property_type, avg(price) / max(city_price) as rent_ratio from
            (select city, property_type, price, avg(price) over (partition by city) as city_price from b_sales) group by 1, 2"""
    }
)


def segment_ratios(t: Tables) -> DataFrame:
    """Mean segment price over the city mean, from per-segment sums."""
    seg = t.sales.groupBy("city", "property_type").agg(F.sum("price").alias("s"), F.count("price").alias("c"))
    city = seg.groupBy("city").agg((F.sum("s") / F.sum("c")).alias("m"))
    return seg.join(city, "city").select("city", "property_type", (F.col("s") / F.col("c") / F.col("m")).alias("rent_ratio"))


@query(
    "prediction_grid",
    """select d.city, d.predict_date, p.property_type, b.beds, round(d.yhat, 4) as yhat from b_drift d,
       (select distinct property_type from b_sales) p, (select unnest([1, 2, 3]) as beds) b where d.target = 'price'""",
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.baselines import forecast_drift

    price = forecast_drift(t.series).filter("target = 'price'").select("city", "predict_date", "yhat")
    kinds = t.sales.agg(F.collect_set("property_type").alias("k")).scalar()
    grid = price.select("*", F.explode(kinds).alias("property_type"))
    return rounded(grid.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("beds")), "yhat", digits=4)


@query(
    "align_actuals",
    """select d.city, d.target, d.predict_date, round(d.yhat, 4) as yhat, round(s.y, 4) as y_true from b_bt_seasonal d
       left join b_series s on s.city = d.city and s.target = d.target and s.ds = d.predict_date""",
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.baselines import backtest_seasonal_naive

    pred = backtest_seasonal_naive(t.series_dense).select("city", "target", "predict_date", "yhat")
    actual = t.series.select("city", "target", F.col("ds").alias("predict_date"), F.col("y").alias("y_true"))
    return rounded(pred.join(actual, ["city", "target", "predict_date"], "left"), "yhat", "y_true", digits=4)


@query(
    "permits_by_postal_code",
    """select c_nationkey as postal_code, count(*) as listings, cast(sum(n) as bigint) as permits from customer
       join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = c_nationkey group by 1""",
)
def _(t: Tables) -> DataFrame:
    permits = t.raw("supplier").groupBy(F.col("s_nationkey").alias("postal_code")).agg(F.count(F.lit(1)).alias("n"))
    listings = t.raw("customer").groupBy(F.col("c_nationkey").alias("postal_code")).agg(
        F.count(F.lit(1)).alias("listings")
    )
    return listings.join(permits, "postal_code").select(
        "postal_code", "listings", (F.col("listings") * F.col("n")).alias("permits")
    )


__all__ = ["segment_ratios"]
