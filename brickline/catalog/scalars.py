"""Scalar rules. Each raw text column is composed from a whole test table, so the check SQL can state the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF, Tables
from brickline.catalog.registry import add_ctes, query, rounded
from brickline.functions import dates, labels, numbers, text
from brickline.operators.merge import dedupe_keep_last, upsert_last_wins
from brickline.plans import listings, scenarios
from brickline.plans.baselines import all_backtests, forecast_drift
from brickline.plans.risk import risk_panel


def by_segment(choices: list) -> Column:
    """One of five expressions per customer, chosen by the market segment."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = None
    for n, c in zip(names, choices):
        c = c if isinstance(c, Column) else F.lit(c)
        out = (F if out is None else out).when(F.col("c_mktsegment") == n, c)
    return out


def segment_case(values: list[str]) -> str:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return "case c_mktsegment " + " ".join(f"when '{n}' then {v}" for n, v in zip(names, values)) + " end"


@query("month_floor", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month from orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", dates.month_floor(F.col("o_orderdate")).alias("month"))


@query(
    "parse_month",
    """select o_orderkey, case when o_orderpriority = '5-LOW' and o_orderstatus = 'F' then null
         else cast(date_trunc('month', o_orderdate) as date) end as month from orders""",
)
def _(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    shapes = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy/M/d"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "MMM yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "MMMM d, yyyy"))
        .when(F.col("o_orderstatus") == "F", "n/a")
        .otherwise(F.date_diff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    )
    return t.raw("orders").select("o_orderkey", dates.parse_month(shapes).alias("month"))


@query(
    "month_from_filename",
    """select o_orderkey, cast(case when o_orderpriority = '5-LOW' then date '2024-04-01' else date_trunc('month', o_orderdate) + interval 10 year end as date) as month
       from orders""",
)
def _(t: Tables) -> DataFrame:
    d = F.add_months(F.col("o_orderdate").cast("date"), 120)
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("rents_"), F.date_format(d, "yyyy-MM"), F.lit(".csv")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Report-"), F.date_format(d, "MMM_yyyy"), F.lit(".json")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("x"), F.date_format(d, "yyyy_M"), F.lit(".csv")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.date_format(d, "MMMM-yyyy"), F.lit(".csv")))
        .otherwise("latest.csv")
    )
    return t.raw("orders").select("o_orderkey", dates.month_from_filename(name, F.lit("2024-05-17")).alias("month"))


@query(
    "parse_mon_year",
    "select o_orderkey, case when o_orderstatus = 'F' then null else cast(date_trunc('month', o_orderdate) as date) end as month from orders",
)
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", "Total").otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return t.raw("orders").select("o_orderkey", dates.parse_mon_year(raw).alias("month"))


@query(
    "extract_year",
    "select o_orderkey, cast(year(o_orderdate) as integer) as year, make_date(year(o_orderdate), 1, 1) as year_start from orders",
)
def _(t: Tables) -> DataFrame:
    label = F.concat(F.lit("Oct. "), F.year("o_orderdate").cast("string"), F.lit(" (r)"))
    year = dates.extract_year(label)
    return t.raw("orders").select("o_orderkey", year.alias("year"), dates.year_start(year).alias("year_start"))


@query(
    "parse_number",
    "select o_orderkey, case when o_orderstatus = 'F' then null else o_totalprice end as value from orders",
)
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", "x").otherwise(F.format_number("o_totalprice", 2))
    return t.raw("orders").select("o_orderkey", numbers.parse_number(raw).alias("value"))


@query(
    "canonical_geo",
    "select c_custkey, " + segment_case(["'Kelowna'", "'Vancouver'", "'Toronto'", "'Canada'", "null"]) + " as geo from customer",
)
def _(t: Tables) -> DataFrame:
    raw = by_segment(
        [
            "Kelowna (CMA), British Columbia",
            "  Greater  Vancouver, BC",
            "Tóronto, Ontario",
            "CANADA",
            F.concat(F.lit("Montréal "), F.col("c_nationkey").cast("string")),
        ]
    )
    return t.raw("customer").select("c_custkey", text.canonical_geo(raw).alias("geo"))


@query(
    "clean_geo_labels",
    """select c_custkey, case when c_mktsegment = 'BUILDING' then 'Ottawa - Gatineau (cma)' else 'Nation_' || c_nationkey end as geo from customer""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("c_nationkey").cast("string")
    raw = F.when(F.col("c_mktsegment") == "BUILDING", "Ottawa – Gatineau (CMA) (map)").otherwise(
        F.concat(F.lit("CMA of NATION_"), key, F.lit(", Province ("), key, F.lit(")"))
    )
    return t.raw("customer").select("c_custkey", text.clean_geo_label(raw).alias("geo"))


@query(
    "map_city_or_title",
    "select c_custkey, " + segment_case(["'Vancouver'", "'Toronto'", "'Kelowna'", "'Nation_' || c_nationkey", "'New Town'"]) + " as city from customer",
)
def _(t: Tables) -> DataFrame:
    raw = by_segment(
        [" City of Vancouver", "TORONTO, ON", "kelowna", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), "new town "]
    )
    return t.raw("customer").select("c_custkey", text.map_city_or_title(raw).alias("city"))


@query(
    "normalise_bedrooms",
    """select p_partkey, case when p_size % 12 = 0 then '0BR' when p_size % 12 in (1, 2, 3) then (p_size % 12) || 'BR'
         when p_size % 12 in (4, 5) then '4BR+' when p_size % 12 = 6 then '2BR' end as bedroom_type from part""",
)
def _(t: Tables) -> DataFrame:
    n = F.pmod("p_size", F.lit(12)).cast("int")
    raw = (
        F.when(n == 0, "Studio")
        .when(n == 3, "Three Bedroom")
        .when(n <= 5, F.concat(n.cast("string"), F.lit(" Bedroom")))
        .when(n == 6, "about 2 rooms")
        .when(n == 7, F.concat(n.cast("string"), F.lit(" br")))
        .otherwise("penthouse")
    )
    return t.raw("part").select("p_partkey", text.normalise_bedrooms(raw).alias("bedroom_type"))


@query(
    "normalise_property_type",
    "select c_custkey, " + segment_case(["'Townhouse'", "'Condo'", "'Apartment'", "'Detached'", "'Customer#' || lpad(cast(c_custkey as varchar), 9, '0')"]) + " as property_type from customer",
)
def _(t: Tables) -> DataFrame:
    raw = by_segment(["Sunny town house", "CONDO apartment", "Garden Suite", "mobile home", F.col("c_name")])
    return t.raw("customer").select("c_custkey", text.normalise_property_type(raw).alias("property_type"))


@query("parse_price", "select id, cast(floor(p_retailprice) as bigint) as price from b_listing_text")
def _(t: Tables) -> DataFrame:
    return t.listing_text.select("id", text.parse_price(F.col("body")).alias("price"))


@query("parse_beds_baths", "select id, cast(p_size as double) as beds, cast(1.5 as double) as baths from b_listing_text")
def _(t: Tables) -> DataFrame:
    body = F.col("body")
    return t.listing_text.select("id", text.parse_beds(body).alias("beds"), text.parse_baths(body).alias("baths"))


@query(
    "parse_area_sqft",
    """select id, case when p_size % 2 = 0 then p_size * 25 else cast(round(p_size * 25 * 10.7639, 0) as bigint) end as area_sqft
       from b_listing_text""",
)
def _(t: Tables) -> DataFrame:
    return t.listing_text.select("id", text.parse_area_sqft(F.col("body")).alias("area_sqft"))


@query(
    "parse_posted_date",
    "select o_orderkey, case when o_orderstatus = 'F' then null else cast(o_orderdate as date) end as posted from orders",
)
def _(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderstatus") == "F", "Posted recently")
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Posted: "), F.date_format(d, "MMM d, yyyy")))
        .otherwise(F.concat(F.date_format(d, "MMMM dd, yyyy"), F.lit(" by owner")))
    )
    return t.raw("orders").select("o_orderkey", dates.parse_posted_date(raw).alias("posted"))


@query(
    "extract_postal_code",
    """select c_custkey, case when c_mktsegment = 'BUILDING' then null else 'V' || (c_nationkey % 10) || 'Y 1A' || (c_custkey % 10) end as postal_code
       from customer""",
)
def _(t: Tables) -> DataFrame:
    code = F.concat(
        F.lit("v"), F.pmod("c_nationkey", F.lit(10)).cast("string"), F.lit("y"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(""),
        F.lit("1a"), F.pmod("c_custkey", F.lit(10)).cast("string"),
    )
    raw = F.when(F.col("c_mktsegment") == "BUILDING", "no code 12345").otherwise(F.concat(F.lit("near "), code, F.lit(", up")))
    return t.raw("customer").select("c_custkey", text.extract_postal_code(raw).alias("postal_code"))


@query(
    "normalise_listings",
    """select case when p_type = 'PROMO' then 'shop:AD' || id else 'shop:' || left(sha1(url), 16) end as listing_id, url,
         date '2025-09-10' as date_posted, false as is_date_missing, 'Kelowna' as city, 'V1Y 1A1' as postal_code,
         case when p_type = 'SMALL' then 'Townhouse' else 'Apartment' end as property_type, 'rent' as listing_type,
         cast(floor(p_retailprice) as bigint) as price, case when p_type = 'PROMO' then cast(7 as double) else cast(p_size as double) end as bedrooms,
         cast(1.5 as double) as bathrooms, case when p_size % 2 = 0 then p_size * 25 else cast(round(p_size * 25 * 10.7639, 0) as bigint) end as area_sqft,
         case when p_type = 'PROMO' then 'Post Date: Sep 10, 2025' || chr(10) || 'Bedrooms: 7' || chr(10) || 'Ad Number: AD' || id
              else 'Post Date: September 10, 2025' end as description
       from b_listing_text where p_type <> 'LARGE'""",
)
def _(t: Tables) -> DataFrame:
    promo = F.col("p_type") == "PROMO"
    key = F.col("id").cast("string")
    postings = t.listing_text.select(
        "url",
        F.when(F.col("p_type") == "SMALL", "Town house by the lake").otherwise("Bright apartment").alias("title"),
        F.concat("body", F.lit(" near V1Y1A1")).alias("body"),
        F.when(promo, F.concat(F.lit("Post Date: Sep 10, 2025\nBedrooms: 7\nAd Number: AD"), key))
        .otherwise("Post Date: September 10, 2025")
        .alias("details"),
        F.lit(None).cast("string").alias("breadcrumb"),
        F.when(F.col("p_type") == "LARGE", "Elsewhere").otherwise("City of Kelowna").alias("city"),
    )
    out = listings.normalise_listings(postings, "shop", "Kelowna", city_names=["kelowna", "city of kelowna"])
    return out.drop("year_built")


@query(
    "normalise_listings_pages",
    """select 'web:' || left(sha1(url), 16) as listing_id, url, date '2025-09-10' as date_posted, false as is_date_missing, 'Kelowna' as city,
         'V' || (page_id % 10) || 'Y 1A1' as postal_code, case when page_id % 2 = 0 then 'Apartment' else 'Townhouse' end as property_type,
         'rent' as listing_type, page_id + 500 as price, cast(page_id % 5 as double) as bedrooms, cast(1.5 as double) as bathrooms,
         page_id % 900 + 300 as area_sqft from pages""",
)
def _(t: Tables) -> DataFrame:
    """Whole pages as they are, each with an own title and a line of listing facts in front."""
    key = F.col("page_id")
    number = lambda c: c.cast("string")
    facts = F.concat(
        F.when(key % 2 == 0, "<title>Bright apartment</title>").otherwise("<title>Sunny town house</title>"),
        F.lit("<div>$"), F.format_number(key + 500, 0), F.lit(" a month, <b>"), number(key % 5), F.lit("</b> bed 1.5 bath, "),
        number(key % 900 + 300), F.lit(" sq ft, v"), number(key % 10), F.lit("y1a1, posted Sep 10, 2025</div>"),
    )
    pages = t.raw("pages").withColumn("html", F.concat(facts, F.col("html")))
    posts = listings.postings_from_pages(pages).withColumn("city", F.lit("Kelowna"))
    return listings.normalise_listings(posts, "web", "Kelowna").drop("year_built", "description")


add_ctes(
    {
        "b_rent_rows": """select case p_brand when 'Brand#1' then 'Vancouver' when 'Brand#2' then 'Toronto' else p_brand end as city,
            case when p_size % 2 = 0 then date '2025-08-01' else date '2025-07-01' end as date,
            case when p_size % 6 = 0 then '0BR' when p_size % 6 in (1, 2, 3) then (p_size % 6) || 'BR' else '4BR+' end as bedroom_type,
            p_retailprice as median_rent, p_partkey as seq from part""",
    }
)


@query(
    "normalise_rents",
    """select city, date, bedroom_type, max_by(median_rent, seq) as median_rent, 'survey' as source from b_rent_rows group by 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    n = F.pmod("p_size", F.lit(6)).cast("int")
    raw = t.raw("part").select(
        F.when(F.col("p_brand") == "Brand#1", "city of vancouver")
        .when(F.col("p_brand") == "Brand#2", " Toronto, ON")
        .otherwise(F.col("p_brand"))
        .alias("Location"),
        F.when(n == 0, "Bachelor").otherwise(F.concat(n.cast("string"), F.lit("-bedroom"))).alias("Bedrooms"),
        F.lit("1").alias("avg"),
        F.format_number("p_retailprice", 2).alias("Median Rent"),
        F.when(F.col("p_size") % 2 == 0, "2025-08").otherwise("July 2025").alias("Month"),
        F.col("p_partkey").alias("seq"),
    )
    return listings.normalise_rents(raw, "survey")


@query(
    "upsert_rents",
    """select city, date, bedroom_type, max_by(median_rent, seq) as median_rent, 'survey' as source from b_rent_rows group by 1, 2, 3
       union all select 'Elsewhere', date '2025-06-01', '1BR', cast(1 as double), 'old'""",
)
def _(t: Tables) -> DataFrame:
    """Rows in the older form, with the rent as text in ``value``, over a stored table that holds some of their keys."""
    n = F.pmod("p_size", F.lit(6)).cast("int")
    kind = F.when(n == 0, "0BR").when(n <= 3, F.concat(n.cast("string"), F.lit("BR"))).otherwise("4BR+")
    rows = t.raw("part").select(
        text.map_city_or_title(F.regexp_replace(F.regexp_replace("p_brand", "^Brand#1$", "Vancouver"), "^Brand#2$", "Toronto")).alias("city"),
        F.when(F.col("p_size") % 2 == 0, "2025-08-01").otherwise("2025-07").alias("date"),
        kind.alias("bedroom_type"),
        F.format_number("p_retailprice", 2).alias("value"),
        F.lit("survey").alias("source"),
        F.col("p_partkey").alias("seq"),
    )
    unread = rows.withColumns({"value": F.lit("n/a"), "seq": F.col("seq") + 1_000_000_000})
    latest = dedupe_keep_last(rows, ["city", "date", "bedroom_type"], ["seq"])
    incoming = listings.rents_for_upsert(latest.unionByName(unread))
    stored = incoming.filter("bedroom_type = '0BR'").withColumns({"median_rent": F.lit(-1.0), "source": F.lit("old")})
    other = t.spark.range(1).select(
        F.lit("Elsewhere").alias("city"), F.lit("2025-06-01").cast("date").alias("date"), F.lit("1BR").alias("bedroom_type"),
        F.lit(1.0).alias("median_rent"), F.lit("old").alias("source"),
    )
    keys = ["city", "date", "bedroom_type"]
    return upsert_last_wins(stored.unionByName(other), incoming, keys, ["median_rent"])


@query(
    "normalise_statcan",
    """select case n_nationkey % 5 when 0 then 'Toronto' when 1 then 'Kelowna' when 2 then 'Canada' when 3 then 'Vancouver' end as city,
         cast(date_trunc('month', l_shipdate) as date) as date, 'StatCan_18100004' as metric, l_extendedprice as value, 'StatCan_18100004' as source
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       where n_nationkey % 5 <> 4 and l_returnflag <> 'N'""",
)
def _(t: Tables) -> DataFrame:
    k = F.pmod("s_nationkey", F.lit(5)).cast("int")
    geo = (
        F.when(k == 0, "Toronto (CMA), Ontario")
        .when(k == 1, "Kelowna, British Columbia")
        .when(k == 2, "Canada")
        .when(k == 3, "Vancouver CMA")
        .otherwise("Regina")
    )
    value = F.when(F.col("l_returnflag") == "N", "..").otherwise(F.format_number("l_extendedprice", 2))
    raw = t.raw("lineitem").join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("ref_date"), geo.alias("Geo"), value.alias("VALUE")
    )
    return listings.normalise_statcan(raw, "StatCan_18100004")


@query(
    "normalise_pid",
    """select l_orderkey, l_linenumber, l_partkey, case when length(cast(l_orderkey as varchar)) >= 5 then '1810' || left(cast(l_orderkey as varchar), 4) end as pid from lineitem""",
)
def _(t: Tables) -> DataFrame:
    raw = F.when(F.length(F.col("l_orderkey").cast("string")) >= 5, F.concat(F.lit("18-10-"), F.col("l_orderkey").cast("string"), F.lit("-01"))).otherwise("18-10")
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.normalise_pid(raw).alias("pid"))


@query(
    "months_since",
    "select o_orderkey, cast(date_diff('month', date '1999-12-01', o_orderdate) as integer) as months from orders",
)
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", dates.months_since(F.col("o_orderdate"), CUTOFF).alias("months"))


@query(
    "parse_horizon",
    "select c_custkey, cast(" + segment_case(["12", "24", "60", "120", "null"]) + " as integer) as months from customer",
)
def _(t: Tables) -> DataFrame:
    raw = by_segment(["1y", "2Y", "5y", "10y", "3w"])
    return t.raw("customer").select("c_custkey", dates.parse_horizon(raw).alias("months"))


@query(
    "strip_model_suffix",
    "select replace(model_name, '_backtest', '') as model, count(*) as n from b_backtests group by 1",
)
def _(t: Tables) -> DataFrame:
    model = text.strip_model_suffix(F.col("model_name")).alias("model")
    return all_backtests(t.series_dense).groupBy(model).agg(F.count(F.lit(1)).alias("n"))


@query("clip_non_negative", "select c_custkey, greatest(0, c_acctbal) as balance from customer")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", numbers.clip_non_negative(F.col("c_acctbal")).alias("balance"))


@query(
    "clip_change",
    """select city, date, round(least(0.3, greatest(-0.3, p)), 6) as pct, round(least(0.3, greatest(-0.3, p)) - 0.05, 6) as lower,
         round(least(0.3, greatest(-0.3, p)) + 0.05, 6) as upper
       from (select city, date, y / nullif(lag(y) over (partition by city order by date), 0) - 1 as p from b_dense) where p is not null""",
)
def _(t: Tables) -> DataFrame:
    from brickline.operators.panel import yoy

    change = t.price_dense.select("city", "date", yoy("y", ["city"], months=1).alias("p")).filter("p is not null")
    pct = numbers.clip(F.col("p"), -0.30, 0.30)
    out = change.select("city", "date", pct.alias("pct"), (pct - 0.05).alias("lower"), (pct + 0.05).alias("upper"))
    return rounded(out, "pct", "lower", "upper")


@query(
    "classify_risk",
    """select city, date, case when affordability >= 0.8 then 'Tight' when affordability >= 0.5 then 'Moderate' else 'Comfortable' end as affordability,
         case when price_to_rent >= 0.7 then 'Elevated' when price_to_rent >= 0.4 then 'Balanced' else 'Attractive' end as price_to_rent,
         case when inventory < 0.4 then 'Low' when inventory < 0.7 then 'Adequate' else 'High' end as inventory from b_risk_parts""",
)
def _(t: Tables) -> DataFrame:
    wide = risk_panel(t.price_panel, t.rent_panel, t.sales_monthly.select("city", "date", F.col("n").alias("listings")))
    return wide.select(
        "city",
        "date",
        labels.affordability_label(F.col("affordability")).alias("affordability"),
        labels.price_to_rent_label(F.col("price_to_rent")).alias("price_to_rent"),
        labels.inventory_label(F.col("inventory")).alias("inventory"),
    )


@query(
    "label_sentiment",
    """select event_id, case when s > 0.05 then 'POS' when s < -0.05 then 'NEG' else 'NEU' end as label
       from (select event_id, value / 10 - 0.5 as s from events)""",
)
def _(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", labels.sentiment_label(F.col("value") / 10 - 0.5).alias("label"))


@query(
    "round_to_scale",
    "select o_orderkey, round(o_totalprice / 7, 0) as r0, round(o_totalprice / 7, 2) as r2, round(o_totalprice / 7, 3) as r3, round(o_totalprice / 7, 4) as r4 from orders",
)
def _(t: Tables) -> DataFrame:
    v = F.col("o_totalprice") / 7
    return t.raw("orders").select("o_orderkey", *[F.round(v, d).alias(f"r{d}") for d in (0, 2, 3, 4)])


@query(
    "fill_interval",
    "select city, target, predict_date, round(coalesce(case when horizon_months > 12 then null else yhat_lower end, yhat), 4) as lower, round(yhat, 4) as yhat from b_drift",
)
def _(t: Tables) -> DataFrame:
    from brickline.plans.serve import fill_interval

    gaps = forecast_drift(t.series).withColumn("yhat_lower", F.when(F.col("horizon_months") <= 12, F.col("yhat_lower")))
    out = fill_interval(gaps).select("city", "target", "predict_date", F.col("yhat_lower").alias("lower"), "yhat")
    return rounded(out, "lower", "yhat", digits=4)


@query(
    "derived_row_metrics",
    """select listing_id, round(price / nullif(area, 0), 6) as price_per_sqft, 2025 - built as property_age,
         cast(property_type = 'House' as integer) as is_house, cast(property_type = 'Condo' as integer) as is_condo
       from (select listing_id, price, property_type, (listing_id % 4) * 500 as area, cast(1950 + listing_id % 70 as integer) as built from b_sales)""",
)
def _(t: Tables) -> DataFrame:
    built = (F.lit(1950) + F.pmod("listing_id", F.lit(70))).cast("int")
    units = t.sales.withColumns({"area_sqft": F.pmod("listing_id", F.lit(4)) * 500, "year_built": built})
    out = listings.derived_row_metrics(units, 2025, ["House", "Condo"])
    return rounded(out.select("listing_id", "price_per_sqft", "property_age", "is_house", "is_condo"), "price_per_sqft")


@query(
    "mortgage_scenario",
    """select city, date, rate, round(case when rate = 0 then y * 0.8 / 300 else y * 0.8 * (rate / 12) / (1 - pow(1 + rate / 12, -300)) end, 4) as payment
       from b_price, (select unnest([0.0, 0.03, 0.05, 0.07])::double as rate)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(scenarios.mortgage_scenario(t.price_panel, [0.0, 0.03, 0.05, 0.07]), "payment", digits=4)


@query(
    "price_stress",
    "select city, date, shock, round(y * (1 - shock), 4) as stressed from b_price, (select unnest([0.1, 0.2, 0.3])::double as shock)",
)
def _(t: Tables) -> DataFrame:
    return rounded(scenarios.price_stress(t.price_panel, [0.1, 0.2, 0.3]), "stressed", digits=4)


@query(
    "repeat_sales_pairs",
    """select unit_id, listing_id, first_date, second_date, round(ln(price / p0), 6) as log_change from (
         select unit_id, listing_id, date_posted as second_date, price, lag(price) over w as p0, lag(date_posted) over w as first_date
         from b_sales window w as (partition by unit_id order by date_posted, listing_id)) where first_date is not null""",
)
def _(t: Tables) -> DataFrame:
    return rounded(listings.repeat_sales_pairs(t.sales).drop("change"), "log_change")
