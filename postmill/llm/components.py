"""Connected components by alternating large and small stars.

Every round is two joins by key; hot keys are split by the adaptive skew join. Each round is written to
the shared folder, which cuts the lineage; whether the edges have settled is asked with a limit of one row, so
nothing that grows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.rows import Scratch


def _under_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs below one node that hangs below none."""
    through = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return through.isEmpty() and edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node that is not the smallest of its component; `edges` has a and b."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(now, f"{name}0")
    rounds = 0
    while not _settled(now):
        # large star: a node's larger neighbours move below its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _under_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: so do the node and its smaller ones
        small = _under_least(large)
        hung = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = scratch.keep(hung.select("e.u", "e.v").where("u != v").distinct(), f"{name}{rounds + 1}")
        scratch.drop(f"{name}{rounds}")
        rounds += 1
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
