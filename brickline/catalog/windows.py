"""Lags, rolling frames, fills, scaling and annual expansion over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF, FIRST_MONTH, LAST_MONTH, Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.operators import panel
from brickline.plans import annual, history

CITY = ["city"]
W = "over (partition by city order by date)"


@query(
    "lag_features",
    f"""select city, date, round(y, 4) as y, round(lag(y, 1) {W}, 4) as lag_1, round(lag(y, 3) {W}, 4) as lag_3,
        round(lag(y, 6) {W}, 4) as lag_6, round(lag(y, 12) {W}, 4) as lag_12 from b_dense""",
)
def _(t: Tables) -> DataFrame:
    lags = {f"lag_{k}": panel.lagged("y", k, CITY) for k in (1, 3, 6, 12)}
    return rounded(t.price_dense.withColumns(lags), "y", *lags, digits=4)


@query(
    "lead_targets",
    f"""select * from (select city, date, round(y, 4) as y, round(lead(y, 12) {W}, 4) as target_12m, round(lead(y, 24) {W}, 4) as target_24m,
        round(lead(y, 60) {W}, 4) as target_5y, round(lead(y, 120) {W}, 4) as target_10y from b_dense) where target_12m is not null""",
)
def _(t: Tables) -> DataFrame:
    out = history.add_lead_targets(t.price_dense, "y", "target")
    return rounded(out, "y", "target_12m", "target_24m", "target_5y", "target_10y", digits=4)


def rolled(agg: str, k: int) -> str:
    frame = f"over (partition by city order by date rows {k - 1} preceding)"
    return f"round(case when count(y) {frame} = {k} then {agg}(y) {frame} end, 4)"


@query(
    "rolling_mean",
    f"select city, date, {rolled('avg', 3)} as roll_3, {rolled('avg', 6)} as roll_6, {rolled('avg', 12)} as roll_12 from b_dense",
)
def _(t: Tables) -> DataFrame:
    rolls = {f"roll_{k}": panel.rolling_mean("y", k, CITY) for k in (3, 6, 12)}
    return rounded(t.price_dense.withColumns(rolls), *rolls, digits=4).drop("y")


@query(
    "rolling_std",
    f"select city, date, {rolled('stddev_samp', 6)} as std_6 from b_dense",
)
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.select("city", "date", panel.rolling_std("y", 6, CITY).alias("std_6")), "std_6", digits=4)


@query("mom_change", f"select city, date, round(y - lag(y) {W}, 4) as mom_change from b_dense")
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.select("city", "date", panel.diff("y", CITY).alias("mom_change")), "mom_change", digits=4)


@query("mom_pct", f"select city, date, round((y / nullif(lag(y) {W}, 0) - 1) * 100, 4) as mom_pct from b_dense")
def _(t: Tables) -> DataFrame:
    change = (panel.yoy("y", CITY, months=1) * 100).alias("mom_pct")
    return rounded(t.price_dense.select("city", "date", change), "mom_pct", digits=4)


@query(
    "month_dummies",
    "select city, date, " + ", ".join(f"cast(month(date) = {m} as integer) as m_{m}" for m in range(1, 13)) + " from b_dense",
)
def _(t: Tables) -> DataFrame:
    flags = [(F.month("date") == m).cast("int").alias(f"m_{m}") for m in range(1, 13)]
    return t.price_dense.select("city", "date", *flags)


@query(
    "rolling_centered",
    """select city, date, round(coalesce(
         first_value(r ignore nulls) over (partition by city order by date rows between current row and unbounded following),
         last_value(r ignore nulls) over (partition by city order by date rows unbounded preceding)), 4) as smooth
       from (select city, date, case when count(y) over w = 2 then avg(y) over w end as r from b_dense
             window w as (partition by city order by date rows 1 preceding))""",
)
def _(t: Tables) -> DataFrame:
    return rounded(panel.rolling_centered(t.price_dense, "y", "smooth", CITY).drop("y"), "smooth", digits=4)


@query(
    "yoy",
    f"select city, date, round(y / nullif(lag(y, 12) {W}, 0) - 1, 6) as yoy from b_dense",
)
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.select("city", "date", panel.yoy("y", CITY).alias("yoy")), "yoy")


@query("diff", f"select city, date, round(y - lag(y) {W}, 4) as diff from b_dense")
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.select("city", "date", panel.diff("y", CITY).alias("diff")), "diff", digits=4)


FF = "last_value(y ignore nulls) over (partition by city order by date rows unbounded preceding)"
BF = "first_value(y ignore nulls) over (partition by city order by date rows between current row and unbounded following)"


@query("forward_fill", f"select city, date, round({FF}, 4) as y from b_dense")
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.withColumn("y", panel.forward_fill("y", CITY)), "y", digits=4)


@query(
    "fill_both",
    f"""select city, date, round(coalesce({FF}, {BF}), 4) as y from (select g.city, g.date, p.y from b_grid g
        left join b_price p on p.city = g.city and p.date = g.date)""",
)
def _(t: Tables) -> DataFrame:
    wide = panel.reindex_months(t.price_panel, CITY, FIRST_MONTH, LAST_MONTH)
    return rounded(wide.withColumn("y", panel.fill_both("y", CITY)), "y", digits=4)


@query("densify_months", "select city, date, round(y, 4) as y from b_dense")
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense, "y", digits=4)


@query(
    "reindex_months",
    "select g.city, g.date, round(p.y, 4) as y from b_grid g left join b_price p on p.city = g.city and p.date = g.date",
)
def _(t: Tables) -> DataFrame:
    return rounded(panel.reindex_months(t.price_panel, CITY, FIRST_MONTH, LAST_MONTH), "y", digits=4)


add_ctes(
    {
        "b_cpi_grid": """select g.date, g.province, p.cpi_index from
              (select distinct province, date from b_grid join b_cities using (city)) g
              left join b_province p on p.province = g.province and p.date = g.date""",
        "b_cpi_fill": """select date, province, last_value(cpi_index ignore nulls) over (partition by province order by date rows unbounded preceding) as cpi_index,
              case when date > max(case when cpi_index is not null then date end) over (partition by province) then 'cpi_FF' else 'cpi' end as source
            from b_cpi_grid""",
        "b_cpi": """select date, province, (cpi_index / nullif(lag(cpi_index, 12) over (partition by province order by date), 0) - 1) * 100 as cpi_yoy, source
            from b_cpi_fill""",
    }
)


@query(
    "cpi_by_city",
    "select date, city, round(cpi_yoy, 2) as cpi_yoy, source from b_cpi join b_cities using (province) where cpi_yoy is not null",
)
def _(t: Tables) -> DataFrame:
    out = annual.cpi_by_city(t.province_index, t.cities, FIRST_MONTH, LAST_MONTH)
    return rounded(out, "cpi_yoy", digits=2)


@query(
    "gdp_growth_by_city",
    """select g.date, c.city, round((gdp / nullif(lag(gdp, 12) over (partition by c.city order by g.date), 0) - 1) * 100, 2) as gdp_growth
       from (select d.date, last_value(o.gdp ignore nulls) over (order by d.date rows unbounded preceding) as gdp
             from (select distinct date from b_grid) d left join b_output o on o.date = d.date) g, b_cities c""",
)
def _(t: Tables) -> DataFrame:
    return rounded(annual.gdp_by_city(t.national_output, t.cities, FIRST_MONTH, LAST_MONTH), "gdp_growth", digits=2)


@query(
    "flag_imputed",
    """select city, date, round(coalesce(y, ff), 4) as y,
         case when date > max(case when y is not null then date end) over (partition by city) then 'real_FF' else 'real' end as source
       from (select g.city, g.date, r.y, last_value(r.y ignore nulls) over (partition by g.city order by g.date rows unbounded preceding) as ff
             from (select city, cast(unnest(generate_series(date '1995-01-01', date '2002-06-01', interval 1 month)) as date) as date from b_cities) g
             left join b_rent r on r.city = g.city and r.date = g.date)""",
)
def _(t: Tables) -> DataFrame:
    grid = panel.reindex_months(t.rent_panel.join(t.cities.select("city"), "city", "right"), CITY, FIRST_MONTH, "2002-06-01")
    return rounded(annual.fill_and_flag(grid, CITY, "y", "real"), "y", digits=4)


ANNUAL_MONTHLY = """select city, date, round(ff, 2) as value, case when value is null and date > last_real then 'LOCF' else 'DERIVED_ANNUAL' end as data_flag
    from (select g.city, g.date, a.median_income as value,
            last_value(a.median_income ignore nulls) over (partition by g.city order by g.date rows unbounded preceding) as ff,
            max(case when a.median_income is not null then g.date end) over (partition by g.city) as last_real
          from (select city, cast(unnest(generate_series(date '1995-01-01', date '2003-08-01', interval 1 month)) as date) as date from b_cities) g
          left join b_annual a on a.city = g.city and a.year = year(g.date))"""


@query("annual_to_monthly", ANNUAL_MONTHLY)
def _(t: Tables) -> DataFrame:
    yearly = t.annual.select("city", "year", F.col("median_income").alias("value"))
    return rounded(annual.expand_annual(yearly, t.cities, FIRST_MONTH, "2003-08-01"), "value", digits=2)


@query(
    "annual_calendar",
    "select date, city, population from b_demo",
)
def _(t: Tables) -> DataFrame:
    return panel.annual_to_monthly(t.annual.select("city", "year", "population")).select("date", "city", "population")


@query(
    "extrapolate_last3",
    """select city, year, median_income from b_annual
       union all select city, 2003, round(avg(median_income) + regr_slope(median_income, year) * (2003 - avg(year)), 4)
       from (select * from b_annual qualify row_number() over (partition by city order by year desc) <= 3)
       group by city having count(*) = 3""",
)
def _(t: Tables) -> DataFrame:
    out = panel.extrapolate_last3(t.annual, CITY, "year", "median_income", 2003)
    return rounded(out, "median_income", digits=4)


@query(
    "zscore_by_city",
    "select city, date, round((y - avg(y) over c) / (stddev_samp(y) over c + 1e-6), 6) as z from b_dense window c as (partition by city)",
)
def _(t: Tables) -> DataFrame:
    return rounded(t.price_dense.select("city", "date", panel.zscore("y", CITY).alias("z")), "z")


@query(
    "zscore_fit_train",
    f"""select city, date, round((y - avg(case when date <= date '{CUTOFF}' then y end) over c)
        / (stddev_samp(case when date <= date '{CUTOFF}' then y end) over c + 1e-6), 6) as z from b_dense window c as (partition by city)""",
)
def _(t: Tables) -> DataFrame:
    train = F.col("date") <= F.lit(CUTOFF).cast("date")
    return rounded(t.price_dense.select("city", "date", panel.zscore("y", CITY, train).alias("z")), "z")


@query(
    "minmax_scale",
    f"""select city, date, round((y - lo) / nullif(hi - lo, 0), 6) as scaled, round(lo + (y - lo) / nullif(hi - lo, 0) * (hi - lo), 4) as restored from
        (select *, min(case when date <= date '{CUTOFF}' then y end) over (partition by city) as lo,
           max(case when date <= date '{CUTOFF}' then y end) over (partition by city) as hi from b_dense)""",
)
def _(t: Tables) -> DataFrame:
    train = F.col("date") <= F.lit(CUTOFF).cast("date")
    fit = F.when(train, F.col("y"))
    w = panel.whole(CITY)
    low, high = F.min(fit).over(w), F.max(fit).over(w)
    out = t.price_dense.select("city", "date", panel.minmax("y", CITY, train).alias("scaled"), low.alias("lo"), high.alias("hi"))
    out = out.select("city", "date", "scaled", (F.col("lo") + F.col("scaled") * (F.col("hi") - F.col("lo"))).alias("restored"))
    return rounded(rounded(out, "scaled"), "restored", digits=4)


@query(
    "drop_warmup",
    f"select city, date, round(y, 4) as y from (select *, row_number() {W} as rn from b_dense) where rn > 12",
)
def _(t: Tables) -> DataFrame:
    return rounded(panel.drop_warmup(t.price_dense, CITY), "y", digits=4)


@query(
    "sequence_windows",
    """select city, date, round(y, 4) as next_value, len(x) as n, round(list_sum(x), 4) as window_sum, round(x[1], 4) as oldest, round(x[12], 4) as newest
       from (select city, date, y, case when count(y) over w = 12 then list(y) over w end as x from b_dense
             window w as (partition by city order by date rows between 12 preceding and 1 preceding)) where x is not null""",
)
def _(t: Tables) -> DataFrame:
    seq = t.price_dense.withColumn("x", panel.sequence_windows("y", 12, CITY)).filter("x is not null")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    out = seq.select(
        "city",
        "date",
        F.col("y").alias("next_value"),
        F.size("x").cast("bigint").alias("n"),
        total.alias("window_sum"),
        F.element_at("x", 1).alias("oldest"),
        F.element_at("x", 12).alias("newest"),
    )
    return rounded(out, "next_value", "window_sum", "oldest", "newest", digits=4)


@query(
    "train_test_split_by_date",
    f"select city, target, ds, round(y, 4) as y, case when ds <= date '{CUTOFF}' then 'train' else 'valid' end as split from b_series",
)
def _(t: Tables) -> DataFrame:
    train = F.col("ds") <= F.lit(CUTOFF).cast("date")
    return rounded(t.series.withColumn("split", F.when(train, "train").otherwise("valid")), "y", digits=4)


@query(
    "series_with_min_history",
    "select city, target, ds, round(y, 4) as y, case when ds <= date '1999-12-01' then 'train' else 'valid' end as split from b_enough",
)
def _(t: Tables) -> DataFrame:
    out = panel.series_with_min_history(t.series_dense, ["city", "target"], "y", CUTOFF, 36, 6, "ds")
    return rounded(out, "y", digits=4)


@query(
    "horizon_number",
    f"""select city, target, ds, row_number() over (partition by city, target order by ds) as horizon from b_series where ds > date '{CUTOFF}'""",
)
def _(t: Tables) -> DataFrame:
    after = t.series.filter(F.col("ds") > F.lit(CUTOFF).cast("date"))
    number = F.row_number().over(panel.by_date(["city", "target"], "ds")).cast("bigint")
    return after.select("city", "target", "ds", number.alias("horizon"))


def sampled(months: int) -> str:
    keep = "i % 2 = 0" if months == 24 else "i % greatest(1, n // 12) = 0 and i // greatest(1, n // 12) < 12"
    return f"""select city, target, predict_date, round(yhat, 4) as yhat from
        (select *, row_number() over (partition by city, target order by predict_date) - 1 as i, count(*) over (partition by city, target) as n
         from b_drift where horizon_months <= {months}) where {keep}"""


def _sampled(t: Tables, months: int) -> DataFrame:
    from brickline.plans.baselines import forecast_drift

    path = forecast_drift(t.series).filter(F.col("horizon_months") <= months)
    out = panel.sample_horizon(path, ["city", "target"], months, "predict_date")
    return rounded(out.select("city", "target", "predict_date", "yhat"), "yhat", digits=4)


@query("sample_horizon", sampled(60))
def _(t: Tables) -> DataFrame:
    return _sampled(t, 60)


@query("sample_horizon_24", sampled(24))
def _(t: Tables) -> DataFrame:
    return _sampled(t, 24)


@query(
    "impute_group_mean",
    """select g.city, g.date, round(coalesce(p.y, avg(p.y) over (partition by year(g.date))), 4) as y
       from b_grid g left join b_price p on p.city = g.city and p.date = g.date""",
)
def _(t: Tables) -> DataFrame:
    wide = panel.reindex_months(t.price_panel, CITY, FIRST_MONTH, LAST_MONTH)
    return rounded(annual.impute_group_mean(wide, F.year("date"), "y"), "y", digits=4)


@query(
    "price_to_rent",
    "select city, date, round(ratio, 6) as price_to_rent from b_ratio",
)
def _(t: Tables) -> DataFrame:
    from brickline.functions.numbers import price_to_rent

    rent = t.rent_panel.withColumnRenamed("y", "rent")
    out = t.price_panel.join(rent, ["city", "date"], "left").select(
        "city", "date", price_to_rent(F.col("y"), F.col("rent")).alias("price_to_rent")
    )
    return rounded(out, "price_to_rent")


@query(
    "build_history",
    f"""select city, date, round(price, 4) as price, round(rent, 4) as rent, median_income, round(mortgage_rate, 6) as mortgage_rate,
        round(target_12m, 4) as target_12m, round(target_24m, 4) as target_24m, round(target_5y, 4) as target_5y, round(target_10y, 4) as target_10y from (
          select *, lead(price, 12) {W} as target_12m, lead(price, 24) {W} as target_24m, lead(price, 60) {W} as target_5y, lead(price, 120) {W} as target_10y
          from (select h.city, h.date, h.price, r.y as rent, d.median_income, m.mortgage_rate from b_dense_mean h
            left join b_rent r on r.city = h.city and r.date = h.date left join b_demo d on d.city = h.city and d.date = h.date
            left join b_metric_wide m on m.city = h.city and m.date = h.date)) where target_12m is not null""",
)
def _(t: Tables) -> DataFrame:
    out = history.build_history_from(t)
    return rounded(rounded(out, "price", "rent", "target_12m", "target_24m", "target_5y", "target_10y", digits=4), "mortgage_rate")


add_ctes(
    {
        "b_mean": "select city, cast(date_trunc('month', date_posted) as date) as date, avg(price) as price from b_sales group by 1, 2",
        "b_dense_mean": "select g.city, g.date, m.price from b_price_grid g left join b_mean m on m.city = g.city and m.date = g.date",
    }
)
