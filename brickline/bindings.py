"""Domain tables bound to the star-schema test tables.

Facts are reduced by their own keys before any join where the result is an
aggregate, so a hot supplier is combined inside the map tasks. The three reduced
monthly tables are stored: every query scans a fact table once for them, however
many branches use the result.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.functions.dates import month_floor
from brickline.operators.aggregates import median_price_panel
from brickline.operators.panel import annual_to_monthly, densify_months, yoy
from brickline.session import settle

FIRST_MONTH = "1995-01-01"
LAST_MONTH = "2001-08-01"
CUTOFF = "1999-12-01"
NATIONAL = "Canada"


class Tables:
    """The tables of one directory: plans over the raw files, and stored monthly reductions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def stage(self, *names: str) -> Tables:
        """Store the named tables side by side; their jobs do not depend on each other."""
        with ThreadPoolExecutor(len(names)) as pool:
            jobs = [inheritable_thread_target(self.spark)(lambda name=name: getattr(self, name)) for name in names]
            for done in [pool.submit(job) for job in jobs]:
                done.result()
        return self

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cities(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("city_key"), F.col("n_name").alias("city"), F.col("r_name").alias("province")
        )

    @cached_property
    def sales(self) -> DataFrame:
        orders, customer = self.raw("orders"), self.raw("customer")
        status = F.when(F.col("o_orderstatus") == "F", "sale").otherwise("rent")
        kind = (
            F.when(F.col("c_mktsegment") == "BUILDING", "House")
            .when(F.col("c_mktsegment") == "FURNITURE", "Condo")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "Apartment")
            .when(F.col("c_mktsegment") == "MACHINERY", "Townhouse")
            .otherwise("Other")
        )
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(self.cities, F.col("c_nationkey") == F.col("city_key"))
            .select(
                F.col("o_orderkey").alias("listing_id"),
                "city",
                "province",
                F.col("o_orderdate").cast("date").alias("date_posted"),
                status.alias("listing_type"),
                kind.alias("property_type"),
                F.col("o_totalprice").alias("price"),
                F.col("o_custkey").alias("unit_id"),
            )
        )

    @cached_property
    def price_panel(self) -> DataFrame:
        """city, date, y: median price per month (stored)."""
        return settle(median_price_panel(self.sales), "price-panel")

    @cached_property
    def price_dense(self) -> DataFrame:
        return densify_months(self.price_panel, ["city"])

    @cached_property
    def shipments(self) -> DataFrame:
        """Line items reduced to city and month: sums and counts of the measures (stored)."""
        line, supplier = self.raw("lineitem"), self.raw("supplier")
        month = month_floor(F.col("l_shipdate"))
        part = line.groupBy("l_suppkey", month.alias("date")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.sum("l_discount").alias("discount"),
            F.sum("l_tax").alias("tax"),
            F.sum("l_quantity").alias("quantity"),
        )
        named = part.join(supplier, part.l_suppkey == supplier.s_suppkey).join(
            self.cities, F.col("s_nationkey") == F.col("city_key")
        )
        measures = [F.sum(c).alias(c) for c in ("n", "unit_price", "discount", "tax", "quantity")]
        return settle(named.groupBy("city", "date").agg(*measures), "shipments")

    @cached_property
    def rent_panel(self) -> DataFrame:
        """city, date, y: mean unit price per month."""
        return self.shipments.select("city", "date", (F.col("unit_price") / F.col("n")).alias("y"))

    @cached_property
    def metrics(self) -> DataFrame:
        """date, city, metric, value, source: city rows, and national rows of two metrics."""
        ships = self.shipments
        city = ships.select(
            "city",
            "date",
            (F.col("discount") / F.col("n") * 100).alias("mortgage_rate"),
            (F.col("tax") / F.col("n") * 100).alias("unemployment_rate"),
        ).unpivot(["city", "date"], ["mortgage_rate", "unemployment_rate"], "metric", "value")
        national = (
            ships.groupBy("date")
            .agg(
                (F.sum("discount") / F.sum("n") * 100).alias("mortgage_rate"),
                (F.sum("quantity") / F.sum("n") / 10).alias("overnight_rate"),
            )
            .withColumn("city", F.lit(NATIONAL))
            .unpivot(["city", "date"], ["mortgage_rate", "overnight_rate"], "metric", "value")
        )
        return city.withColumn("source", F.lit("city")).unionByName(
            national.withColumn("source", F.lit("national"))
        ).select("date", "city", "metric", "value", "source")

    @cached_property
    def sales_monthly(self) -> DataFrame:
        """Listings reduced to city and month: count, price sum and signed price flow (stored)."""
        flow = F.when(F.col("listing_type") == "rent", F.col("price")).otherwise(-F.col("price"))
        monthly = self.sales.groupBy("province", "city", month_floor(F.col("date_posted")).alias("date")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"), F.sum(flow).alias("flow")
        )
        return settle(monthly, "sales-monthly")

    @cached_property
    def annual(self) -> DataFrame:
        """city, year, population, median_income, migration_rate per calendar year."""
        mean, flow = F.sum("total") / F.sum("n"), F.sum("flow") / 1000000
        return self.sales_monthly.groupBy("city", F.year("date").alias("year")).agg(
            F.sum("n").alias("population"),
            F.round(F.round(mean, 9), 2).alias("median_income"),
            F.round(F.round(flow, 9), 2).alias("migration_rate"),
        )

    @cached_property
    def demographics(self) -> DataFrame:
        return annual_to_monthly(self.annual).select("date", "city", "population", "migration_rate", "median_income")

    @cached_property
    def province_index(self) -> DataFrame:
        """province, date, cpi_index: mean price per province and month."""
        return self.sales_monthly.groupBy("province", "date").agg((F.sum("total") / F.sum("n")).alias("cpi_index"))

    @cached_property
    def national_output(self) -> DataFrame:
        """date, gdp: shipped quantity of the country per month."""
        return self.shipments.groupBy("date").agg(F.sum("quantity").alias("gdp"))

    @cached_property
    def macro(self) -> DataFrame:
        """date, city, gdp_growth, cpi_yoy: province inflation on its cities, national growth as national rows."""
        cpi = self.province_index.withColumn("cpi_yoy", F.round(yoy("cpi_index", ["province"]) * 100, 2))
        city = cpi.join(self.cities, "province").select(
            "date", "city", F.lit(None).cast("double").alias("gdp_growth"), "cpi_yoy"
        )
        gdp = self.national_output.withColumn("country", F.lit(NATIONAL))
        national = gdp.select(
            "date",
            F.col("country").alias("city"),
            F.round(yoy("gdp", ["country"]) * 100, 2).alias("gdp_growth"),
            F.lit(None).cast("double").alias("cpi_yoy"),
        )
        return city.unionByName(national)

    @cached_property
    def series(self) -> DataFrame:
        """city, target, ds, y: all price and rent series."""
        price = self.price_panel.select("city", F.lit("price").alias("target"), F.col("date").alias("ds"), "y")
        rent = self.rent_panel.select("city", F.lit("rent").alias("target"), F.col("date").alias("ds"), "y")
        return price.unionByName(rent)

    @cached_property
    def series_dense(self) -> DataFrame:
        return densify_months(self.series, ["city", "target"], "ds")

    @cached_property
    def news(self) -> DataFrame:
        """id, date, city, title, url; the whole document text is the title."""
        key = F.col("doc_id")
        return self.raw("documents").select(
            key.alias("id"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(120)).cast("int")).alias("date"),
            F.concat(F.lit("NATION_"), F.pmod(key, F.lit(25)).cast("string")).alias("city"),
            F.col("text").alias("title"),
            F.col("source").alias("url"),
        )

    @cached_property
    def listing_text(self) -> DataFrame:
        """id, body, url: posting text with known fields."""
        unit = F.when(F.col("p_size") % 2 == 0, " sq ft ").otherwise(" m2 ")
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(
                F.lit("$"),
                F.floor("p_retailprice").cast("string"),
                F.lit(" /month "),
                F.col("p_size").cast("string"),
                F.lit(" bed 1.5 bath "),
                (F.col("p_size") * 25).cast("string"),
                unit,
                F.col("p_type"),
            ).alias("body"),
            F.concat(F.lit("http://x.example/"), F.col("p_partkey").cast("string")).alias("url"),
            "p_size",
            "p_retailprice",
            "p_type",
            "p_name",
        )
