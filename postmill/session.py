"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import gc
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing, the warehouse is used, which executors share as well. The folder
    goes when the application ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{folder.rstrip('/')}/postmill-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_at_end, spark, root)
    return root


_ROOTS: set[str] = set()


def _at_end(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this application wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, outer: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes see the same rows even when executors are lost, read only the columns they need,
    and join with known sizes. Inside `dropping` the table belongs to the innermost scope, or to the one `outer` further out.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    writer = df.write
    if scopes := getattr(_OPEN, "scopes", None):
        scopes[max(0, len(scopes) - 1 - outer)].append(path)
        writer = writer.option("compression", COMPACT)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


COMPACT = "zstd"  # of what is kept or written in large amounts
_OPEN = threading.local()  # tables of the scopes that are open in this thread


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` stores inside go at the end, with the shuffles behind them.

    What is to stay must be stored elsewhere by then: a DataFrame that still reads one of them fails.
    """
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    _OPEN.scopes.append([])
    try:
        yield
    finally:
        for path in _OPEN.scopes.pop():
            remove(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark find out which shuffles nothing refers to any more, so that their files go before the next step makes new ones."""
    gc.collect()
    spark._jvm.System.gc()


BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hands Python at most BATCH_ROWS rows and about BATCH_BYTES at once, since rows here hold whole texts."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
