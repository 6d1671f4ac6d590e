"""Registration of a query and, where it exists, its check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Digits kept before the final rounding of a compared value.
NOISE_DIGITS = 9

# The domain tables in plain SQL, named b_*; each may use the ones it mentions.
CTES: dict[str, str] = {
    "b_cities": "select n_nationkey as city_key, n_name as city, r_name as province from nation join region on n_regionkey = r_regionkey",
    "b_sales": """select o_orderkey as listing_id, city, province, cast(o_orderdate as date) as date_posted,
        case o_orderstatus when 'F' then 'sale' else 'rent' end as listing_type,
        case c_mktsegment when 'BUILDING' then 'House' when 'FURNITURE' then 'Condo' when 'HOUSEHOLD' then 'Apartment'
             when 'MACHINERY' then 'Townhouse' else 'Other' end as property_type,
        o_totalprice as price, o_custkey as unit_id
        from orders join customer on o_custkey = c_custkey join b_cities on c_nationkey = city_key""",
    "b_price": "select city, cast(date_trunc('month', date_posted) as date) as date, median(price) as y from b_sales group by 1, 2",
    "b_price_span": "select city, min(date) as lo, max(date) as hi from b_price group by 1",
    "b_price_grid": "select city, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as date from b_price_span",
    "b_dense": "select g.city, g.date, p.y from b_price_grid g left join b_price p on g.city = p.city and g.date = p.date",
    "b_ships": """select city, cast(date_trunc('month', l_shipdate) as date) as date, count(*) as n,
        sum(l_extendedprice / l_quantity) as unit_price, sum(l_discount) as discount, sum(l_tax) as tax, sum(l_quantity) as quantity
        from lineitem join supplier on l_suppkey = s_suppkey join b_cities on s_nationkey = city_key group by 1, 2""",
    "b_rent": "select city, date, unit_price / n as y from b_ships",
    "b_metrics": """select date, city, 'mortgage_rate' as metric, discount / n * 100 as value, 'city' as source from b_ships
        union all select date, city, 'unemployment_rate', tax / n * 100, 'city' from b_ships
        union all select date, 'Canada', 'mortgage_rate', sum(discount) / sum(n) * 100, 'national' from b_ships group by date
        union all select date, 'Canada', 'overnight_rate', sum(quantity) / sum(n) / 10, 'national' from b_ships group by date""",
    "b_annual": """select city, cast(year(date_posted) as integer) as year, count(*) as population, round(avg(price), 2) as median_income,
        round(sum(case when listing_type = 'rent' then price else -price end) / 1000000, 2) as migration_rate
        from b_sales group by 1, 2""",
    "b_demo": """select make_date(year, m, 1) as date, city, population, migration_rate, median_income
        from b_annual, (select cast(unnest(generate_series(1, 12)) as integer) as m)""",
    "b_province": "select province, cast(date_trunc('month', date_posted) as date) as date, avg(price) as cpi_index from b_sales group by 1, 2",
    "b_output": "select date, sum(quantity) as gdp from b_ships group by 1",
    "b_macro": """select date, city, cast(null as double) as gdp_growth, cpi_yoy from
          (select province, date, round((cpi_index / lag(cpi_index, 12) over (partition by province order by date) - 1) * 100, 2) as cpi_yoy from b_province)
          join b_cities using (province)
        union all
        select date, 'Canada', round((gdp / lag(gdp, 12) over (order by date) - 1) * 100, 2), null from b_output""",
    "b_series": """select city, 'price' as target, date as ds, y from b_price
        union all select city, 'rent', date, y from b_rent""",
    "b_series_grid": """select city, target, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as ds from
        (select city, target, min(ds) as lo, max(ds) as hi from b_series group by 1, 2)""",
    "b_series_dense": """select g.city, g.target, g.ds, s.y from b_series_grid g
        left join b_series s on g.city = s.city and g.target = s.target and g.ds = s.ds""",
    "b_news": """select doc_id as id, cast(date '2024-01-01' + cast(doc_id % 120 as integer) as date) as date,
        'NATION_' || (doc_id % 25) as city, text as title, source as url from documents""",
    "b_listing_text": """select p_partkey as id,
        '$' || cast(cast(floor(p_retailprice) as bigint) as varchar) || ' /month ' || p_size || ' bed 1.5 bath '
        || (p_size * 25) || case when p_size % 2 = 0 then ' sq ft ' else ' m2 ' end || p_type as body,
        'http://x.example/' || p_partkey as url, p_size, p_retailprice, p_type, p_name from part""",
}


def add_ctes(extra: dict[str, str]) -> None:
    CTES.update(extra)


def exact_rounding(sql: str) -> str:
    """``round(x, n)`` on a decimal, so ties and float noise round the same in both engines."""
    out, rest = "", sql
    while (at := re.search(r"\bround\(", rest)) is not None:
        depth, comma, end = 1, None, at.end()
        while depth:
            ch = rest[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        value, digits = rest[at.end() : comma], rest[comma + 1 : end - 1]
        out += rest[: at.start()]
        out += f"cast(round(cast({exact_rounding(value)} as decimal(38, {NOISE_DIGITS})),{digits}) as double)"
        rest = rest[end:]
    return out + rest


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round after removing float noise, as the check SQL does."""
    return df.withColumns({c: F.round(F.round(c, NOISE_DIGITS), digits) for c in columns})


def with_ctes(body: str) -> str:
    """Prefix the body with the domain tables it mentions, in dependency order."""
    return exact_rounding(_with_ctes(body))


def _with_ctes(body: str) -> str:
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bb_\w+", sql):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    listed = ",\n".join(f"{name} as ({CTES[name]})" for name in ordered)
    return f"with {listed}\n{body}"


def resolve_oracles() -> None:
    """Expand the domain tables once every module has registered its own."""
    for name, sql in ORACLES.items():
        ORACLES[name] = with_ctes(sql)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the equal statement over the test tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
