"""Landed files to frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickline.functions.dates import parse_month
from brickline.functions.numbers import parse_number
from brickline.functions.text import lookup
from brickline.operators.filters import select_valid
from brickline.operators.merge import align_columns, require_columns

# National metrics belong to this city name.
NATIONAL = "Canada"
SEPARATORS = [",", ";", "\t"]


def read_metric_csv(spark: SparkSession, paths: Sequence[str], metric: str, source: str) -> DataFrame:
    """``Date,Value`` files to tidy metric rows; unreadable dates or values are dropped."""
    raw = spark.read.option("header", True).csv(list(paths))
    require_columns(raw, ["Date", "Value"])
    columns = [
        parse_month(F.col("Date")).alias("date"),
        F.lit(NATIONAL).alias("city"),
        F.lit(metric).alias("metric"),
        parse_number(F.col("Value")).alias("value"),
        F.lit(source).alias("source"),
    ]
    return select_valid(raw, columns, ["date", "value"])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text; each file's separator is the one that cuts its header line into the most columns.

    Separators inside quotes do not count. Files with different columns are joined by name.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    heads = lines.withColumn("place", F.monotonically_increasing_id()).filter("at = 0").groupBy("file").agg(F.min_by("value", "place").alias("head"))
    bare = F.regexp_replace("head", '"[^"]*"', "")
    cuts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    best = F.coalesce(*(F.when(n == F.greatest(*cuts), F.lit(s)) for n, s in zip(cuts, SEPARATORS)))
    name = F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    files: dict[str, list[str]] = {}
    for row in heads.select(name.alias("file"), best.alias("sep")).collect():
        files.setdefault(row["sep"], []).append(row["file"])
    read = lambda sep, where: spark.read.option("header", True).option("sep", sep).csv(where)
    parts = [read(sep, sorted(files[sep])) for sep in SEPARATORS if sep in files]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else read(SEPARATORS[0], path)


def read_json_records(spark: SparkSession, path: str, multi_line: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """Records from a list of objects or from the list inside a ``data``/``rows`` shell.

    With ``types`` the result has those columns, absent ones null, and files without a record give an empty table.
    """
    raw = spark.read.option("multiLine", multi_line).json(path)
    lists = [f.name for f in raw.schema if isinstance(f.dataType, T.ArrayType)]
    shell = next((c for c in ("data", "rows") if c in raw.columns), lists[0] if lists else None)
    if shell is None and types and not set(types) & set(raw.columns):
        return spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in types.items()))
    records = raw if shell is None else raw.select(F.explode(shell).alias("r")).select("r.*")
    return align_columns(records, types) if types else records


def flatten_observations(df: DataFrame, payload: str, alias: dict[str, str], prefix: str) -> DataFrame:
    """``{"observations":[{"d":…, "<series>":{"v":…}}]}`` to one row per date and series.

    Series without a numeric ``v`` are dropped; unnamed series get ``prefix`` + id.
    """
    schema = "struct<observations: array<map<string, string>>>"
    per_day = df.select(F.explode(F.from_json(payload, schema)["observations"]).alias("o"))
    cells = per_day.select(F.try_element_at("o", F.lit("d")).alias("d"), F.explode("o").alias("sid", "cell"))
    columns = [
        F.lit(NATIONAL).alias("city"),
        F.try_to_date("d", "yyyy-MM-dd").alias("date"),
        series_name(F.col("sid"), alias, prefix).alias("metric"),
        parse_number(F.get_json_object("cell", "$.v")).alias("value"),
    ]
    return select_valid(cells.filter("sid <> 'd'"), columns, ["date", "value"])


def series_name(sid: Column, alias: dict[str, str], prefix: str) -> Column:
    named = F.concat(F.lit(prefix), sid)
    return F.coalesce(lookup(sid, alias), named) if alias else named


def union_sheets(spark: SparkSession, path: str, sheets: dict[str, str], schema: str | None = None) -> DataFrame:
    """Exported sheets below ``path`` (``sheet=<name>/``) as one table with the mapped city; an unmapped sheet keeps its name.

    With ``schema`` the columns needn't be read off the files, so a folder without a sheet is an empty table.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    raw = (reader.schema(schema) if schema else reader).csv(path)
    sheet = F.regexp_extract(F.col("_metadata.file_path"), r"sheet=([^/]+)/", 1)
    return raw.select("*", (F.coalesce(lookup(sheet, sheets), sheet) if sheets else sheet).alias("city"))
