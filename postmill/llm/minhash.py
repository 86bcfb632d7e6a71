"""Near-duplicate groups by circulant MinHash, with exact Jaccard verification.

Shingles are hashed to the places of a fixed range. One permutation scatters the places; a second one, shifted
circularly by k, gives the k-th signature coordinate: the smallest value among a document's places. As
the shifts are consecutive, all coordinates of a shingle are one slice of the second permutation.

Coordinates are cut into bands. Within a bucket (equal band) nobody is compared with everybody:

1. documents with equal shingle sets are one class, its smallest document stands for it;
2. every member is compared with the bucket's smallest one, and linked pairs are joined to components;
3. documents in buckets that still hold several components are looked at by their shingles. Those of at most RARE documents
   are paired one by one, and counted per pair: no pair has more in common than this count and the smaller one's other
   shingles. All members are compared with the one that has the smallest share of rare shingles, the hub, which in a
   group of edited copies is close to their source;
4. what is left to compare are members of different components in one bucket. The bucket's largest component is met only by
   members outside it. Pairs that counts or one-bit sketches rule out are dropped in the join; so are those
   that fail the exact comparison, made from what each lacks of the hub's shingles and has beyond them. So nearly alike documents
   that are not linked leave the join as no rows.

A link exists only after both full shingle sets have been intersected. With 32 bands of 4 coordinates a pair at
similarity 0.8 shares no bucket with probability 5e-8; its sketch misses the bound by more than six
standard deviations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.hashing import U64, kept, mix, range_hash
from postmill.llm.rows import Scratch, computed, keyed

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
RANGE = 1 << 20
RARE = 4  # shingles of at most so many documents are compared one by one
# fixed values: ASCII space, tab, line feed, vertical tab, form feed, carriage return
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of all words if there are fewer."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, U64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64)
    hasher = range_hash(11)
    word = mix(hasher.ranges(hasher.prefix(data), start, end) ^ (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    n = min(words, len(word))
    run = np.full(len(word) - n + 1, n, U64)
    for i in range(n):
        run = mix(run * U64(0xD6E8FEB86659FD93) + word[i : len(word) - n + 1 + i])
    return np.unique(run)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    first, second = rng.permutation(RANGE).astype(np.int32), rng.permutation(RANGE).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:COORDINATES]]), COORDINATES)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The coordinates: for each shift the smallest value of the second permutation at the shingles' places."""
    first, shifted = kept("circulant", _permutations)
    place = first[(hashes >> U64(44)).astype(np.int64)]
    low = np.full(COORDINATES, RANGE, np.int32)
    for i in range(0, len(place), 4096):
        np.minimum(low, shifted[place[i : i + 4096]].min(axis=0), out=low)
    return low


def _signed(words: int):
    def of(text) -> tuple:
        found = shingles(text, words)
        if not len(found):
            return 0, 0, 0, 0, 0, None
        low = signature(found)
        grid = mix(low.reshape(BANDS, ROWS).astype(U64))
        band = np.arange(BANDS, dtype=U64)
        for i in range(ROWS):
            band = mix(band * U64(0xD6E8FEB86659FD93) + grid[:, i])
        sketch = np.packbits((mix(low.astype(U64) + U64(1 << 40)) & U64(1)).astype(np.uint8)).view(np.int64)
        digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
        return len(found), int(digest[0]), int(digest[1]), int(sketch[0]), int(sketch[1]), band.view(np.int64)

    names = ["n", "set1", "set2", "s1", "s2", "bands"]
    return lambda: lambda frame: pd.DataFrame([of(t) for t in frame["text"]], columns=names)


def _sets(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"uid": frame["uid"], "members": [shingles(t, words).tobytes() for t in frame["text"]]})

    return run


def _exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets = [np.frombuffer(raw, np.int64) for raw in frame["members"]]
        uid = np.repeat(frame["uid"].to_numpy(), [len(x) for x in sets])
        yield pd.DataFrame({"uid": uid, "shingle": np.concatenate([np.zeros(0, np.int64), *sets])})


def _overlaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for x, y in zip(frame["x"], frame["y"], strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            rows.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        out = pd.DataFrame(rows, columns=["n", "m", "common"])
        yield pd.concat([frame[["a", "b"]].reset_index(drop=True), out], axis=1)


def _differences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each document lacks of its hub's shingles, and has beyond them."""
    for frame in frames:
        rows = []
        for x, y in zip(frame["x"], frame["y"], strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            missing = np.setdiff1d(x, y, assume_unique=True).view(np.int64)
            rows.append((len(y), len(x), missing, np.setdiff1d(y, x, assume_unique=True).view(np.int64)))
        out = pd.DataFrame(rows, columns=["n", "hub_n", "missing", "foreign"])
        yield pd.concat([frame[["rep", "hub"]].reset_index(drop=True), out], axis=1)


TRAITS = ("n", "shared", "s1", "s2")


def may_link(one: str, other: str, common: Column, threshold: int) -> Column:
    """False only where the shingles in common cannot suffice, or sketches differ in far more bits than at the threshold.

    `one` and `other` are the prefixes of the two documents' TRAITS columns; `shared` counts the shingles that are not
    rare, and `common` the rare ones in common.
    """
    (n, a, s1, s2), (m, b, t1, t2) = ([F.col(p + x) for x in TRAITS] for p in (one, other))
    differ = F.bit_count(s1.bitwiseXOR(t1)) + F.bit_count(s2.bitwiseXOR(t2))
    p = (1 - threshold / 100) / 2
    most = COORDINATES * p + 6.5 * (COORDINATES * p * (1 - p)) ** 0.5
    # x / (n + m - x) >= threshold / 100 for x shingles in common
    return (differ <= most) & ((F.least(a, b) + common) * (100 + threshold) >= (n + m) * threshold)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's `columns`, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least threshold / 100. Null,
    empty and blank texts have no shingles and no links. Rows that share a doc_id, or have none, are
    separate documents; of a group the first by doc_id (nulls first), then by text, is kept.
    """
    scratch = Scratch(docs.sparkSession)
    names = list(dict.fromkeys([*columns, "doc_id", "text"]))
    texts = keyed(docs, names)
    long_id = texts.select("uid", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kinds = "n long, set1 long, set2 long, s1 long, s2 long, bands array<bigint>"
    signed = scratch.keep(computed(long_id, ["uid", "doc_id"], ["text"], _signed(words), kinds), "signed")
    filled = signed.where("n > 0")
    classes = filled.groupBy("set1", "set2").agg(F.min("uid").alias("rep"))
    first = filled.join(classes, ["set1", "set2"]).where("uid = rep").select("rep", "n", "s1", "s2", "bands")
    first = scratch.keep(first, "first")
    banded = first.select("rep", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").select("bucket", "hub")
    members = scratch.keep(banded.join(hubs, "bucket"), "members")
    # a merge join whatever the number of ids is, for it grows with the input
    wanted = members.select(F.col("rep").alias("uid")).distinct().hint("merge")
    held = texts.select("uid", "text").join(wanted, "uid", "left_semi").mapInPandas(_sets(words), "uid long, members binary")
    sets = scratch.keep(held, "sets")

    def paired(pairs: DataFrame, traits: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes, shared shingles and sketches leave open."""
        for side in ("a", "b"):
            own = (F.col("rep").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in TRAITS))
            pairs = pairs.join(traits.select(*own), side)
        return pairs.where(may_link("a_", "b_", F.col("common"), threshold)).select("a", "b")

    def overlaps(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, n, m, common) from the full sets of the stored pairs: both sizes, and what they have in common."""
        both = pairs.join(sets.select(F.col("uid").alias("b"), F.col("members").alias("y")), "b")
        both = both.join(sets.select(F.col("uid").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
        return scratch.keep(both.mapInPandas(_overlaps, "a long, b long, n long, m long, common long"), f"overlaps_{name}")

    def linked(found: DataFrame) -> DataFrame:
        return found.where(F.expr(f"100 * common >= {threshold} * (n + m - common)")).select("a", "b")

    def joined(group: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components after further links."""
        if links.isEmpty():
            return group
        known = group.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return components(known.unionByName(links), scratch, name)

    def mixed(rows: DataFrame, group: DataFrame, name: str) -> DataFrame:
        """Members of buckets that hold several components: their component, and the bucket's largest one (main)."""
        placed = rows.join(group.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left")
        placed = scratch.keep(placed.withColumn("component", F.coalesce("c", "rep")).drop("c"), f"placed_{name}")
        sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        several = sizes.groupBy("bucket").agg(F.max_by("component", "k").alias("main"), F.count("*").alias("k")).where("k > 1")
        out = scratch.keep(placed.join(several.select("bucket", "main"), "bucket"), f"open_{name}")
        scratch.drop(f"placed_{name}")
        return out

    # everyone against the bucket's smallest member
    pairs = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("common")).distinct()
    tried = scratch.keep(paired(pairs, first.withColumn("shared", F.col("n"))), "to_hub")
    links = linked(overlaps(tried, "hub"))
    group = components(links, scratch, "groups_hub")
    open_ = mixed(members.select("bucket", "rep"), group, "hub")
    # a pair has at most so much in common: its rare shingles in common, and the smaller one's shingles that are not rare
    ids = open_.select(F.col("rep").alias("uid")).distinct()
    each = scratch.keep(sets.join(ids, "uid").mapInPandas(_exploded, "uid long, shingle long"), "each")
    few = each.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") <= RARE)
    rare = scratch.keep(each.join(few, "shingle"), "rare")
    scratch.drop("each")
    own = rare.groupBy(F.col("uid").alias("rep")).agg(F.count("*").alias("r"))
    traits = first.drop("bands").join(ids.withColumnRenamed("uid", "rep"), "rep").join(own, "rep", "left")
    traits = scratch.keep(traits.withColumn("shared", F.col("n") - F.coalesce("r", F.lit(0))).select("rep", *TRAITS), "traits")
    # pairs with a rare shingle in common: at most RARE documents have each of them
    pair = rare.where("k > 1").select("shingle", F.col("uid").alias("a"))
    pair = pair.join(pair.withColumnRenamed("a", "b"), "shingle").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    rarely = paired(pair, traits)
    # all others
    traits = traits.where(F.col("shared") * 100 >= F.col("n") * threshold)
    # everyone left against the member that has the least of its own
    able = scratch.keep(open_.select("bucket", "rep").join(traits, "rep"), "able")
    central = able.groupBy("bucket").agg(F.min(F.struct((F.lit(0) - F.col("shared") / F.col("n")).alias("x"), "rep")).alias("hub"))
    able = able.join(central.select("bucket", F.col("hub.rep").alias("hub")), "bucket")
    own = [F.col("uid").alias("hub"), F.col("members").alias("x")]
    both = able.where("rep != hub").select("rep", "hub").distinct().join(sets.select(F.col("uid").alias("rep"), F.col("members").alias("y")), "rep")
    both = both.join(sets.select(*own), "hub").select("rep", "hub", "x", "y")
    kinds = "rep long, hub long, n long, hub_n long, missing array<bigint>, foreign array<bigint>"
    apart = scratch.keep(both.mapInPandas(_differences, kinds), "apart")
    near = apart.where(F.expr(f"100 * (n - size(foreign)) >= {threshold} * (hub_n + size(foreign))")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    more = scratch.keep(rarely.join(tried, ["a", "b"], "left_anti"), "rarely")
    fresh = near.unionByName(linked(overlaps(more, "rarely"))).join(links, ["a", "b"], "left_anti")
    group = joined(group, scratch.keep(fresh, "fresh"), "groups_central")
    # and what is in one bucket, but not in one component, by what it lacks of the hub and has beyond it
    able = able.join(apart.drop("n"), ["rep", "hub"], "left").withColumn("hub_n", F.coalesce("hub_n", "n"))
    none = F.array().cast("array<bigint>")
    able = able.withColumns({x: F.coalesce(x, none) for x in ("missing", "foreign")})
    rest = mixed(able.select("bucket", "rep", *TRAITS, "hub_n", "missing", "foreign"), group, "central")
    names = ("rep", "component", "hub_n", "missing", "foreign", *TRAITS)
    left = rest.where("component != main").select("bucket", *(F.col(x).alias(f"l_{x}") for x in names))
    right = rest.select("bucket", *(F.col(x).alias(f"r_{x}") for x in names))

    def enough(common: Column) -> Column:
        return common * (100 + threshold) >= (F.col("l_n") + F.col("r_n")) * threshold

    at_most = F.expr("l_hub_n - greatest(size(l_missing), size(r_missing)) + least(size(l_foreign), size(r_foreign))")
    exact = F.expr(
        "l_hub_n - size(l_missing) - size(r_missing) + size(array_intersect(l_missing, r_missing))"
        " + size(array_intersect(l_foreign, r_foreign))"
    )
    on = (left["bucket"] == right["bucket"]) & (F.col("l_component") != F.col("r_component"))
    on = on & may_link("l_", "r_", F.lit(0), threshold) & enough(at_most) & enough(exact)
    found = left.join(right, on).select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b")).distinct()
    found = scratch.keep(found, "found")
    group = joined(group, found, "final")
    place = classes.join(group.withColumnRenamed("id", "rep"), "rep", "left")
    place = place.select("set1", "set2", F.coalesce("component", "rep").alias("root"))
    # rows without shingles stand alone
    rooted = filled.select("uid", "n", "set1", "set2").join(place, ["set1", "set2"]).select("uid", "n", "root")
    rooted = rooted.unionByName(signed.where("n = 0").select("uid", "n", F.col("uid").alias("root")))
    root_ids = signed.select(F.col("uid").alias("root"), F.col("doc_id").alias("component_id"))
    result = rooted.join(root_ids, "root").select(
        "uid", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("root")).alias("kept")
    )
    if set(columns) == {"doc_id"}:
        return signed.select("uid", "doc_id").join(result, "uid").drop("uid")
    return texts.select("uid", *columns).join(result, "uid").drop("uid")
