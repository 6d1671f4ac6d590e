"""Scans, readers and sinks. Files are written by Spark from the test tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.catalog.registry import query, rounded
from brickline.operators.reshape import pick_best_column
from brickline.plans.baselines import all_backtests, backtest_ar1, backtest_naive, backtest_seasonal_naive
from brickline.plans import serve
from brickline.plans.anomalies import detect_zscore
from brickline.plans.risk import all_risks
from brickline.schemas import ANOMALY_KEYS, ANOMALY_TYPES, FORECAST_KEYS, FORECAST_TYPES, RISK_KEYS, RISK_TYPES
from brickline.session import new_table_path
from brickline.sources import loaders, readers, sinks


def national_rate(t: Tables) -> DataFrame:
    return t.metrics.filter("city = 'Canada' and metric = 'overnight_rate'")


@query(
    "read_metric_csv",
    """select date, city, 'policy_rate' as metric, round(round(value, 6), 6) as value, 'file' as source
       from b_metrics where city = 'Canada' and metric = 'overnight_rate'""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "metric-csv")
    rows = national_rate(t).select(
        F.date_format("date", "d MMM yyyy").alias("Date"), F.round(F.round("value", 9), 6).cast("string").alias("Value")
    )
    bad = rows.select("Date", F.lit("n/a").alias("Value"))
    rows.unionByName(bad).write.option("header", True).csv(path)
    return readers.read_metric_csv(t.spark, [path], "policy_rate", "file")


@query("read_delimited_fallback", "select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders")
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "delimited")
    t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    ).write.option("header", True).option("sep", ";").csv(path)
    raw = readers.read_delimited(t.spark, path)
    return raw.select(F.col("id").cast("bigint").alias("id"), "status", F.col("price").cast("double").alias("price"))


@query(
    "read_json_records",
    "select city, province, year, population from b_annual join b_cities using (city)",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "json-records")
    record = F.struct("city", "province", "year", "population")
    docs = t.annual.join(t.cities, "city").groupBy("city").agg(F.collect_list(record).alias("data"))
    docs.select("data").write.json(path)
    types = {"city": "string", "province": "string", "year": "int", "population": "bigint"}
    return readers.read_json_records(t.spark, path, False, types)


OBS_ALIAS = {"view": "views_index"}


@query(
    "flatten_observations",
    """select 'Canada' as city, cast(ts as date) as date,
         case event_type when 'view' then 'views_index' else 'series_' || event_type end as metric, value
       from events where event_type <> 'error'
       union all select 'Canada', cast(ts as date), 'series_k', cast(json_extract_string(props, '$.k') as double) from events""",
)
def _(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit('"n/a"')).otherwise(F.col("value").cast("string"))
    payload = F.concat(
        F.lit('{"observations":[{"d":"'),
        F.date_format("ts", "yyyy-MM-dd"),
        F.lit('","'),
        F.col("event_type"),
        F.lit('":{"v":'),
        value,
        F.lit('},"k":{"v":"'),
        F.get_json_object("props", "$.k"),
        F.lit('"},"empty":{"v":null}}]}'),
    )
    return readers.flatten_observations(t.raw("events").select(payload.alias("p")), "p", OBS_ALIAS, "series_")


@query(
    "union_sheets",
    """select city, date, round(y, 4) as benchmark from b_price""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "sheets")
    t.price_panel.select(
        F.replace("city", F.lit("NATION_"), F.lit("SHEET-")).alias("sheet"),
        "date",
        F.round(F.round("y", 9), 4).alias("benchmark"),
    ).write.option("header", True).partitionBy("sheet").csv(path)
    cities = [r["city"] for r in t.cities.select("city").distinct().collect()]
    raw = readers.union_sheets(t.spark, path, {c.replace("NATION_", "SHEET-"): c for c in cities}, "date date, benchmark double")
    return raw.select("city", F.col("date").cast("date").alias("date"), F.col("benchmark").cast("double").alias("benchmark"))


@query("scan_pruned", "select l_orderkey, l_shipdate, l_quantity from lineitem where l_shipdate >= timestamp '1998-01-01'")
def _(t: Tables) -> DataFrame:
    return (
        t.raw("lineitem")
        .select("l_orderkey", "l_shipdate", "l_quantity")
        .filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    )


@query(
    "load_timeseries",
    """select city, target, ds, round(y, 4) as y from (select * from b_series
       union all select city, metric, date, value from b_metrics
       union all select city, 'features', date, y from b_price) where y is not null""",
)
def _(t: Tables) -> DataFrame:
    index = t.price_panel.select("city", "date", F.col("y").alias("hpi_composite_sa"), F.lit("All").alias("property_type"))
    houses = index.withColumns({"hpi_composite_sa": F.col("hpi_composite_sa") * 2, "property_type": F.lit("House")})
    out = loaders.load_timeseries(t.price_panel, t.rent_panel, t.metrics, index.unionByName(houses))
    return rounded(out, "y", digits=4)


@query(
    "discover_targets",
    """select distinct 'rent_index' as target, city from b_rent union all select distinct 'price_index', city from b_sales
       union all select distinct 'metrics', city from b_metrics""",
)
def _(t: Tables) -> DataFrame:
    return loaders.discover_targets(
        {"rent_index": t.rent_panel, "price_index": t.sales, "metrics": t.metrics, "absent": None}
    )


@query("write_append", "select date, city, metric, round(value, 6) as value, source from b_metrics union all select date, city, metric, round(value, 6), source from b_metrics")
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "append")
    upper = t.metrics.toDF(*[c.upper() for c in t.metrics.columns])
    sinks.write_append(upper, path)
    sinks.write_append(upper, path)
    return rounded(t.spark.read.parquet(path), "value")


FACTS = "round(yhat, 4) as yhat, round(yhat_lower, 4) as yhat_lower, round(yhat_upper, 4) as yhat_upper, round(y_true, 4) as y_true"


@query(
    "write_facts",
    f"""select sha256(model_name || '|' || target || '|' || city || '|' || cast(predict_date as varchar)) as run_id, model_name, target, city,
        horizon_months, predict_date, {FACTS}, cast(null as varchar) as property_type from b_backtests""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "facts")
    rows = all_backtests(t.series_dense)
    runs = ((rows.withColumn("yhat", F.col("yhat") * 2), "2024-01-01"), (rows, "2024-02-01"))
    for run, day in runs:
        table = sinks.write_facts(run, path, FORECAST_TYPES, FORECAST_KEYS, ["model_name", "target"], F.lit(day).cast("timestamp"))
    back = serve.latest_run(table, FORECAST_KEYS).select(
        "run_id", "model_name", "target", "city", "horizon_months", "predict_date",
        "yhat", "yhat_lower", "yhat_upper", "y_true", "property_type",
    )
    return rounded(back, "yhat", "yhat_lower", "yhat_upper", "y_true", digits=4)


@query(
    "write_facts_risk",
    """select sha256(city || '|' || risk_type || '|' || cast(predict_date as varchar)) as run_id, city, risk_type, predict_date,
         round(risk_value, 6) as risk_value from b_risk_all""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "risk-facts")
    back = sinks.write_facts(all_risks(t), path, RISK_TYPES, RISK_KEYS, ["risk_type"]).select("run_id", "city", "risk_type", "predict_date", "risk_value")
    return rounded(back, "risk_value")


@query(
    "write_facts_anomaly",
    """select sha256(city || '|' || target || '|' || cast(detect_date as varchar) || '|' || model_name) as run_id, city, target, detect_date,
         round(value, 4) as value, is_anomaly from b_signals""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "anomaly-facts")
    back = sinks.write_facts(detect_zscore(t.series), path, ANOMALY_TYPES, ANOMALY_KEYS, ["target"]).select("run_id", "city", "target", "detect_date", "value", "is_anomaly")
    return rounded(back, "value", digits=4)


@query("write_replace", "select city, date, round(y, 4) as y from b_rent")
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "replace")
    sinks.write_replace(t.rent_panel.filter("y < 1000"), path)
    sinks.write_replace(t.rent_panel, path)
    return rounded(t.spark.read.parquet(path), "y", digits=4)


@query(
    "write_replace_slice",
    f"""select model_name, target, city, horizon_months, predict_date, {FACTS} from
        (select * from b_bt_naive union all select * from b_bt_seasonal where target = 'rent' union all select * from b_bt_ar1 where target = 'price')""".replace(
        "b_bt_naive union all", "b_bt_naive where target = 'rent' union all"
    ),
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "slice")
    first = backtest_naive(t.series_dense).unionByName(backtest_seasonal_naive(t.series_dense))
    second = backtest_ar1(t.series_dense).filter("target = 'price'")
    sinks.write_replace_slice(first, path, ["target", "city"])
    table = sinks.write_replace_slice(second, path, ["target", "city"])
    return rounded(table.select(*first.columns), "yhat", "yhat_lower", "yhat_upper", "y_true", digits=4)


@query("write_parquet", "select city, year, population, median_income, migration_rate from b_annual")
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "parquet")
    t.annual.write.parquet(path)
    return t.spark.read.parquet(path)


@query("write_json", "select city, year, population from b_annual")
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "json")
    sinks.write_json(t.annual.select("city", "year", "population"), path)
    return t.spark.read.schema("city string, year int, population bigint").json(path)


@query(
    "snapshot_raw",
    """select source, '2024-05-01' as run_date, count(*) as n_docs, cast(sum(length(text)) as bigint) as n_text from documents group by 1""",
)
def _(t: Tables) -> DataFrame:
    path = new_table_path(t.spark, "snapshot")
    docs = t.raw("documents").select("doc_id", "text", "source")
    return sinks.snapshot_raw(docs, path, "2024-05-01").groupBy("source", "run_date").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_text")
    )


@query(
    "pick_best_column",
    "select city, 'Composite_HPI_SA' as chosen, round(avg(y), 4) as mean_value from b_price group by 1",
)
def _(t: Tables) -> DataFrame:
    wide = t.price_panel.select(
        "city",
        (F.col("y") * 2).alias("Benchmark"),
        F.col("y").alias("Composite_HPI_SA"),
        (F.col("y") * 3).alias("Composite_HPI"),
    )
    best = pick_best_column(wide.columns)
    out = wide.groupBy("city").agg(F.lit(best).alias("chosen"), F.avg(best).alias("mean_value"))
    return rounded(out, "mean_value", digits=4)
