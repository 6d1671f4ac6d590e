"""Predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import query, rounded
from brickline.operators import filters
from brickline.operators.topk import latest_per_group
from brickline.plans.baselines import all_backtests


@query(
    "filter_dimensions",
    """select l_orderkey, l_linenumber, l_shipdate, l_quantity from lineitem where l_returnflag = 'R' and l_linestatus in ('O', 'F')
       and l_quantity between 10 and 40""",
)
def _(t: Tables) -> DataFrame:
    kept = filters.filter_dimensions(t.raw("lineitem"), l_returnflag="R", l_linestatus=["O", "F"], l_quantity=(10, 40))
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("filter_contains", "select p_partkey, p_name from part where lower(p_name) like '%widget%'")
def _(t: Tables) -> DataFrame:
    return filters.filter_contains(t.raw("part"), "p_name", "Widget").select("p_partkey", "p_name")


@query(
    "filter_range",
    "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_totalprice < 200000 and o_orderdate >= timestamp '1996-01-01'",
)
def _(t: Tables) -> DataFrame:
    inside = filters.open_range(F.col("o_totalprice"), 100000, 200000)
    since = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    return t.raw("orders").filter(inside & since).select("o_orderkey", "o_totalprice")


@query(
    "filter_geo_with_fallback",
    "select date, city, metric, round(value, 6) as value from b_metrics where city = 'Canada'",
)
def _(t: Tables) -> DataFrame:
    kept = filters.filter_geo_with_fallback(t.metrics, ["Kelowna", "Vancouver"])
    return rounded(kept.select("date", "city", "metric", "value"), "value")


@query("filter_geo_targets", "select date, city, metric, round(value, 6) as value from b_metrics where city in ('NATION_1', 'NATION_2')")
def _(t: Tables) -> DataFrame:
    kept = filters.filter_geo_with_fallback(t.metrics, ["NATION_1", "NATION_2"])
    return rounded(kept.select("date", "city", "metric", "value"), "value")


@query("filter_geo_all", "select date, city, round(y, 4) as y from b_rent")
def _(t: Tables) -> DataFrame:
    return rounded(filters.filter_geo_with_fallback(t.rent_panel, ["Kelowna"]), "y", digits=4)


@query("drop_null_subset", "select city, date, round(y, 4) as y from b_dense where y is not null")
def _(t: Tables) -> DataFrame:
    return rounded(filters.drop_null_subset(t.price_dense, ["city", "date", "y"]), "y", digits=4)


@query(
    "filter_segment_or_any",
    """select o_orderkey, property_type, beds from (select o_orderkey, o_orderstatus as property_type,
         case when o_orderpriority = '1-URGENT' then null else cast(left(o_orderpriority, 1) as integer) end as beds from orders)
       where property_type = 'O' and beds is null""",
)
def _(t: Tables) -> DataFrame:
    beds = F.when(F.col("o_orderpriority") != "1-URGENT", F.left("o_orderpriority", F.lit(1)).cast("int"))
    rows = t.raw("orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("property_type"),
        beds.alias("beds"),
        F.lit(None).cast("int").alias("baths"),
        *[F.lit(None).cast("int").alias(c) for c in ("sqft_min", "sqft_max", "year_built_min", "year_built_max")],
    )
    return filters.filter_segment_or_any(rows, property_type="O").select("o_orderkey", "property_type", "beds")


@query(
    "filter_ci",
    "select listing_id, city, property_type from b_sales where lower(city) = 'nation_7' and lower(property_type) = 'condo'",
)
def _(t: Tables) -> DataFrame:
    return filters.filter_ci(t.sales, city="Nation_7", property_type="CONDO").select("listing_id", "city", "property_type")


@query(
    "find_negative_forecasts",
    """select model_name, city, target, predict_date, round(v - 200000, 4) as yhat from
         (select *, yhat as v from b_backtests) where v - 200000 < 0 or yhat_lower - 200000 < 0 or yhat_upper - 200000 < 0""",
)
def _(t: Tables) -> DataFrame:
    shifted = all_backtests(t.series_dense).withColumns(
        {c: F.col(c) - 200000 for c in ("yhat", "yhat_lower", "yhat_upper")}
    )
    bad = filters.negative_forecasts(shifted).select("model_name", "city", "target", "predict_date", "yhat")
    return rounded(bad, "yhat", digits=4)


@query("latest_row", "select city, max(date) as date, round(max_by(y, date), 4) as y from b_price group by 1")
def _(t: Tables) -> DataFrame:
    return rounded(latest_per_group(t.price_panel, ["city"], ["date"]), "y", digits=4)
