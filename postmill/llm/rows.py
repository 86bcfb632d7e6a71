"""Row keys and stored intermediate tables, as the operators here need them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postmill.operators.ordering import numbered
from postmill.session import bounded_batches, new_path, release, remove


class Scratch:
    """Intermediate tables in the shared folder, dropped as soon as they have served.

    Dropping also lets Spark find out that the shuffles behind the finished steps are no longer
    reachable, so that their files go before the next step makes new ones.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        bounded_batches(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = new_path(self.spark, name)
        df.write.parquet(path)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))
        self.release()

    def release(self) -> None:
        release(self.spark)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    if not least:
        yield from batches
        return
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def computed(df: DataFrame, keep: list[str], needs: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], kinds: str, least: int = 0) -> DataFrame:
    """`keep` of each row, untouched, then the columns `kinds` that a function computes from `needs`.

    `make` is called once per task and returns the function, which gets a frame and returns as many rows. It gets batches
    of `least` bytes or more at once.
    """
    new = StructType.fromDDL(kinds)
    own = df.select(*keep).schema
    n, types = len(keep), to_arrow_schema(new)
    wanted = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"n{i}") for i, c in enumerate(needs)))
    names = [f.name for f in own.fields] + [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in _gathered(batches, least):
            frame = pa.Table.from_batches([batch]).select(list(range(n, n + len(needs)))).rename_columns(needs).to_pandas()
            found = compute(frame)
            columns = [batch.column(i) for i in range(n)]
            columns += [pa.Array.from_pandas(found[f.name], type=f.type) for f in types]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wanted.mapInArrow(run, StructType([*own.fields, *new.fields]))


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of each row, and `uid`, a number that no other row has and that ascends with doc_id.

    It is doc_id itself where that is a key already. Otherwise (null or repeated ids) the rows are
    numbered by doc_id, nulls first, then by text; rows equal in both come in any order.
    """
    spare = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if spare.isEmpty():
        return docs.select(*columns, F.col("doc_id").cast("bigint").alias("uid"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    every = list(dict.fromkeys(["doc_id", "text", *columns]))
    return numbered(docs.select(*every), order, "uid").select(*columns, "uid")
