"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.operators.merge import align_columns, require_columns


def stored(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the columns of the frame that was written there; no row written, no row read."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_append(df: DataFrame, path: str) -> None:
    """Append with lower-case column names."""
    df.toDF(*[c.lower() for c in df.columns]).write.mode("append").parquet(path)


def write_replace(df: DataFrame, path: str) -> None:
    """Truncate and reload. The frame must not read the same path."""
    df.write.mode("overwrite").parquet(path)


def write_facts(
    df: DataFrame,
    path: str,
    types: dict[str, str],
    keys: Sequence[str],
    partitions: Sequence[str] = (),
    created_at: Column | None = None,
) -> DataFrame:
    """Append facts in the table layout with the time of their run; returns the whole table.

    ``run_id`` is a hash of the key, so a re-run repeats it; ``created_at`` tells the runs apart and readers take the
    latest (``serve.latest_run``).
    """
    require_columns(df, keys)
    aligned = align_columns(df, types)
    run_id = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    stamped = aligned.withColumns({"run_id": run_id, "created_at": F.current_timestamp() if created_at is None else created_at})
    writer = stamped.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return stored(stamped, path)


def write_replace_slice(df: DataFrame, path: str, partitions: Sequence[str]) -> DataFrame:
    """Overwrite only the partitions present in the frame; returns the whole table."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )
    return stored(df, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot_raw(df: DataFrame, path: str, run_date: str, source: str = "source") -> DataFrame:
    """Keep raw payloads under ``source=…/run_date=…``; an earlier run of the same day is replaced. Returns all kept."""
    dated = df.withColumn("run_date", F.lit(run_date))
    return write_replace_slice(dated, path, [source, "run_date"])
