"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. Cluster runs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brickline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a folder of its own; a
    cluster without it is refused, because a machine-local folder would be
    invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="brickline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


# Paths of the tables that this process has written and not yet dropped.
_WRITTEN: list[str] = []


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; runs never overwrite each other."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete every intermediate table that this process has written; returns how many there were.

    Results that are still lazy read those tables, so write or collect them first.
    """
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """``with scratch(spark): ...`` drops the intermediate tables at the end of a unit of work."""
    try:
        yield
    finally:
        drop_tables(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced table once and read it back.

    Cuts the lineage, so a table used by several branches is computed once and a
    lost executor costs one re-read; and the written size is known to the planner,
    which then broadcasts the table only when it is under the session's threshold.
    Compressed hard, since many such tables lie side by side until a unit of work ends.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python functions of it run where the repository is not on the path.

    Done once a Spark application; Spark hands the archive to every executor, later ones included.
    """
    _ship(spark.sparkContext.applicationId, spark)


@functools.lru_cache(maxsize=1)
def _ship(application: str, spark: SparkSession) -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="brickline-package-"), "brickline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
