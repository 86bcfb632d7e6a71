"""Normalising a property map held as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_maps(left: Column, right: Column) -> Column:
    """Right wins; the left side loses its shared keys first, as duplicate keys are an error."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def zip_shorter(a: Column, b: Column) -> Column:
    """Array of `struct<a, b>` of the elements side by side, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def normalise_props(events: DataFrame, drop_keys: str, defaults: dict[str, int], overrides: dict[str, int]) -> DataFrame:
    """Parse `props`, drop nulls and keys fully matching a pattern, fill defaults, apply overrides.

    Then keep the values above 10, add one to key `k` where present, test for membership, and lay
    keys and values side by side.
    """

    def literal(entries: dict[str, int]) -> Column:
        flat = [x for k, v in entries.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]
        return F.create_map(*flat).cast("map<string,bigint>")

    parsed = F.coalesce(F.from_json("props", "map<string,bigint>"), literal({}))
    present = F.map_filter(parsed, lambda _, v: v.isNotNull())
    kept = F.map_filter(present, lambda k, _: ~k.rlike(f"^(?:{drop_keys})$"))
    step1 = events.withColumn("m", merge_maps(literal(defaults), kept))
    step2 = step1.withColumn("m", merge_maps(F.col("m"), literal(overrides)))
    step3 = step2.withColumn("m", F.map_filter("m", lambda _, v: v > 10))
    step4 = step3.withColumn("m", F.transform_values("m", lambda k, v: F.when(k == "k", v + 1).otherwise(v)))
    sorted_entries = F.sort_array(F.map_entries("m"))
    keys = F.transform(sorted_entries, lambda e: e["key"])
    values = F.transform(sorted_entries, lambda e: e["value"].cast("string"))
    return step4.select(
        "event_id",
        F.map_contains_key("m", F.lit("k")).alias("has_k"),
        # true or null, never false
        F.nullif(F.array_contains(keys, "extra"), F.lit(False)).alias("has_extra"),
        F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), v)), ",").alias("pairs"),
        # keys beside all values but the first
        F.array_join(F.transform(zip_shorter(keys, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))), lambda p: F.concat(p["a"], F.lit("="), p["b"])), ",").alias("zipped"),
    )
