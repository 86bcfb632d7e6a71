"""The stored fact log, snapshots and derived tables.

Layout under one folder:

- `facts/batch=<tx>/a=<attribute>/`: the facts of each transaction, so that attribute filters prune
  partitions and writing a batch again replaces it instead of adding to it;
- `snapshot/version=<tx>/`: posts as of a transaction, never changed once written;
- `derived/<name>/version=<tx>/`: results that hold until the store changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from postmill.operators.facts import snapshot
from postmill.schema import FACT, POST

_STORED = T.StructType([f for f in FACT.fields if f.name != "a"] + [T.StructField("batch", T.LongType()), T.StructField("a", T.StringType())])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def facts(self, before: int | None = None) -> DataFrame:
        """All facts (or those before a transaction); an empty table when nothing is stored."""
        root = f"{self.path}/facts"
        if not self._exists(root):
            return self.spark.createDataFrame([], FACT)
        rows = self.spark.read.schema(_STORED).option("basePath", root).parquet(root)
        if before is not None:
            rows = rows.where(rows["batch"] < before)
        return rows.select(*FACT.fieldNames())

    def version(self) -> int:
        """The last transaction; read from folder names, without touching the data."""
        root = f"{self.path}/facts"
        if not self._exists(root):
            return 0
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(root)
        names = [s.getPath().getName() for s in target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target)]
        return max((int(n.split("=")[1]) for n in names if n.startswith("batch=")), default=0)

    def append(self, facts: DataFrame, tx: int) -> None:
        """Store the facts of one transaction. A replay of the same transaction is harmless.

        Rows are dealt by attribute in one pass; adaptive execution splits the heavy attributes and joins the light ones.
        """
        rows = facts.hint("rebalance", "a").sortWithinPartitions("a", "e")
        rows.write.mode("overwrite").partitionBy("a").parquet(f"{self.path}/facts/batch={tx}")

    def write_snapshot(self) -> int:
        """Fold the log and store the posts under the current version, which is returned."""
        version = self.version()
        target = f"{self.path}/snapshot/version={version}"
        if not self._exists(f"{target}/_SUCCESS"):
            posts = snapshot(self.facts()).repartitionByRange("id").sortWithinPartitions("id")
            posts.write.mode("overwrite").parquet(target)
        return version

    def posts(self) -> DataFrame:
        """The posts of the current version, from the stored snapshot or else folded from the log."""
        target = f"{self.path}/snapshot/version={self.version()}"
        if self._exists(f"{target}/_SUCCESS"):
            return self.spark.read.parquet(target)
        return snapshot(self.facts())

    def derived(self, name: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A result over the posts, computed once per version of the store."""
        target = f"{self.path}/derived/{name}/version={self.version()}"
        if not self._exists(f"{target}/_SUCCESS"):
            compute(self.posts()).write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)


def restore_or_create(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a stored snapshot, or an empty table of the same shape."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], POST)


def next_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a table as a new version folder and return its path; older versions stay."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path

