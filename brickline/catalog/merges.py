"""Upserts, dedupe and retention. Stored and incoming sides are whole tables of different origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.operators import merge
from brickline.plans.baselines import all_backtests, backtest_ar1
from brickline.schemas import LISTING_TYPES

add_ctes(
    {
        "b_seen": """select l_orderkey as listing_id, city, cast(l_shipdate as date) as date_posted, l_extendedprice as price,
            l_linenumber as line, l_partkey as part, l_suppkey as supp from lineitem join supplier on l_suppkey = s_suppkey
            join b_cities on s_nationkey = city_key""",
        "b_seen_last": """select * from b_seen qualify row_number() over (partition by listing_id
            order by date_posted desc, line desc, part desc, supp desc, price desc) = 1""",
        "b_seen_first": """select * from b_seen qualify row_number() over (partition by listing_id
            order by date_posted, line, part, supp, price) = 1""",
        "b_offered": """select listing_id, city, date_posted, case when listing_type = 'sale' then price end as price from b_sales""",
    }
)
ORDER = ["date_posted", "line", "part", "supp", "price"]


def seen(t: Tables) -> DataFrame:
    """Listing observations: one row per line item, many per listing."""
    return (
        t.raw("lineitem")
        .join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.cities, F.col("s_nationkey") == F.col("city_key"))
        .select(
            F.col("l_orderkey").alias("listing_id"),
            "city",
            F.col("l_shipdate").cast("date").alias("date_posted"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
        )
    )


def seen_last(t: Tables) -> DataFrame:
    return merge.dedupe_keep_last(seen(t), ["listing_id"], ORDER)


def offered(t: Tables) -> DataFrame:
    """Listings with the price known for sales only."""
    return t.sales.select(
        "listing_id", "city", "date_posted", F.when(F.col("listing_type") == "sale", F.col("price")).alias("price")
    )


@query(
    "upsert_last_wins",
    """select listing_id, city, date_posted, price from b_sales where listing_type = 'sale' and listing_id not in (select listing_id from b_seen)
       union all select listing_id, city, date_posted, price from b_seen_last""",
)
def _(t: Tables) -> DataFrame:
    stored = t.sales.filter("listing_type = 'sale'").select("listing_id", "city", "date_posted", "price")
    return merge.upsert_last_wins(stored, seen(t), ["listing_id"], ORDER)


@query(
    "upsert_coalesce",
    """select coalesce(n.listing_id, o.listing_id) as listing_id, case when n.listing_id is not null then n.city else o.city end as city,
         greatest(o.date_posted, n.date_posted) as date_posted, coalesce(case when n.supp % 3 > 0 then n.price end, o.price) as price
       from b_offered o full join b_seen_last n on o.listing_id = n.listing_id""",
)
def _(t: Tables) -> DataFrame:
    incoming = seen(t).withColumn("price", F.when(F.col("supp") % 3 > 0, F.col("price")))
    return merge.upsert_coalesce(offered(t), incoming, ["listing_id"], ["city"], ["date_posted"], ORDER)


@query(
    "upsert_partial",
    """select coalesce(p.city, r.city) as city, coalesce(p.date, r.date) as date, round(p.y, 4) as price, round(r.y, 4) as rent
       from b_price p full join b_rent r on p.city = r.city and p.date = r.date""",
)
def _(t: Tables) -> DataFrame:
    stored = t.price_panel.select("city", "date", F.col("y").alias("price"), F.lit(None).cast("double").alias("rent"))
    rent = t.rent_panel.withColumnRenamed("y", "rent")
    incoming = rent.withColumn("run", F.lit(2)).unionByName(rent.withColumns({"run": F.lit(1), "rent": F.col("rent") * 2}))
    out = merge.upsert_partial(stored, incoming, ["city", "date"], ["rent"], ["run"])
    return rounded(out, "price", "rent", digits=4)


@query(
    "insert_ignore",
    """select * from b_offered
       union all select listing_id, city, date_posted, price from b_seen_first where listing_id not in (select listing_id from b_offered)""",
)
def _(t: Tables) -> DataFrame:
    return merge.insert_ignore(offered(t), seen(t), ["listing_id"], ORDER)


@query("dedupe_keep_last", "select listing_id, city, date_posted, price, line, part, supp from b_seen_last")
def _(t: Tables) -> DataFrame:
    return seen_last(t)


@query(
    "dedupe_keep_first",
    """select listing_id, city, date_posted, price, line, part, supp from b_seen qualify row_number() over (partition by listing_id
       order by date_posted, line, part, supp, price) = 1""",
)
def _(t: Tables) -> DataFrame:
    return merge.dedupe_keep_first(seen(t), ["listing_id"], ORDER)


@query(
    "retain_recent",
    "select id, date, city from b_news where date >= (select max(date) from b_news) - 90",
)
def _(t: Tables) -> DataFrame:
    newest = t.news.agg(F.max("date")).scalar()
    return merge.retain_recent(t.news, "date", newest).select("id", "date", "city")


@query(
    "align_columns",
    """select cast(listing_id as varchar) as listing_id, city, date_posted, property_type, listing_type, price,
         cast(null as varchar) as url, cast(null as varchar) as postal_code, cast(null as double) as bedrooms, cast(null as double) as bathrooms,
         cast(null as bigint) as area_sqft, cast(null as integer) as year_built, cast(null as varchar) as description from b_sales""",
)
def _(t: Tables) -> DataFrame:
    return merge.align_columns(t.sales, LISTING_TYPES)


@query(
    "replace_slice",
    """select model_name, target, city, predict_date, round(yhat, 4) as yhat from b_backtests where target <> 'price'
       union all select model_name, target, city, predict_date, round(yhat, 4) from b_bt_ar1 where target = 'price'""",
)
def _(t: Tables) -> DataFrame:
    columns = ["model_name", "target", "city", "predict_date", "yhat"]
    stored = all_backtests(t.series_dense).select(*columns)
    fresh = backtest_ar1(t.series_dense).filter("target = 'price'").select(*columns)
    return rounded(merge.replace_slice(stored, fresh, ["target", "city"]), "yhat", digits=4)
