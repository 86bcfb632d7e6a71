"""Assertions inside a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """The single value of each key; more than one row for a key is an error."""
    grouped = df.groupBy(key).agg(F.count("*").alias("n"), F.max(value).alias("v"))
    message = F.concat(F.lit("Expected no more than 1 element, got: "), F.col("n").cast("string"))
    checked = F.when(F.col("n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("v"))
    return grouped.select(key, checked.alias(value))
