"""SpotSigs fingerprints with built-in functions only.

A *spot* is a place behind a common word (an anchor). Its signature is the chain of the next CHAIN content words, that is
words that are no anchors. The start of a text is a spot too, so every text with a content word has a signature. Short texts,
tables and code have hardly any anchors, so content words whose hash is divisible by 4 are followed by a spot as well. The rule
is the same at every length: whether a place is a spot depends on the word before it only, so near copies share their spots.

The fingerprint is the number of distinct signatures and a digest of them in
order. Likeness is the Jaccard similarity of the signature sets; it is skipped where the set
sizes alone keep it below a bound.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from postmill.llm.rows import Scratch, keyed

CHAIN = 2
# fixed values: frequent function words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "al con del el es los las no para por se su una y"
).split()
_ANCHOR = "|".join(dict.fromkeys(ANCHORS))
_MARK = "\u0001"


def words(text: Column) -> Column:
    """Lower-case letters and digits in runs, one space before each and one at the end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def _chained(text: Column) -> Column:
    """Content words in order, behind a first element of marks only; a mark ends each that an anchor follows."""
    # anchors become marks: " cats of the sea " is kept as "* cats** sea", where * is the mark
    marked = F.regexp_replace(words(text), f" (?:{_ANCHOR})(?= )", _MARK)
    return F.split(F.rtrim(F.concat(F.lit(_MARK), marked)), " ")


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the sorted distinct signatures of a text; none for null, wordless and anchors-only ones."""
    held = df.withColumn("_w", _chained(F.coalesce(text, F.lit(""))))
    last = F.size("_w") - 1  # number of content words

    def word(i: Column) -> Column:
        return F.translate(F.coalesce(F.get("_w", i), F.lit("")), _MARK, "")

    spots = F.filter(
        F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | F.get("_w", i).endswith(_MARK) | (F.pmod(F.xxhash64(word(i)), F.lit(4)) == 0)
    )
    chains = F.transform(spots, lambda i: F.xxhash64(*(word(i + 1 + k) for k in range(CHAIN))))
    none = F.array().cast("array<bigint>")
    return held.withColumn(name, F.when(last > 0, F.sort_array(F.array_distinct(chains))).otherwise(none)).drop("_w")


def fingerprint(signatures: Column) -> Column:
    """Number of signatures and digest of them all."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(F.array_join(signatures.cast("array<string>"), ","), 256))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 0 where their sizes keep it below `at_least`. Two empty sets: 1."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    exact = F.when(n + m == 0, F.lit(1.0)).otherwise(common / (n + m - common))
    if not at_least:
        return exact
    return F.when(F.least(n, m) < F.lit(at_least) * F.greatest(n, m), F.lit(0.0)).otherwise(exact)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, signatures and fingerprint, row by row, without a shuffle."""
    signed = with_signatures(docs.select("doc_id", "text"), F.col("text"), "signatures")
    return signed.select("doc_id", "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def similar(docs: DataFrame, at_least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates: (fingerprint, doc_id) membership, and links (a, b, likeness) between fingerprints.

    Documents with equal signatures form one class; classes without signatures have no links. Class pairs are
    sought only between length ranges that can be similar enough, by the rarest signatures of each: two sets with the
    wanted Jaccard similarity share one of their first n - ceil(at_least * n) + 1 signatures in order of rarity.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(fingerprints(docs), "signed")
    classes = scratch.keep(signed.where(F.size("signatures") > 0).groupBy("fingerprint").agg(F.first("signatures").alias("signatures")), "classes")
    each = classes.select("fingerprint", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "s").withColumn(
        "r", F.row_number().over(Window.partitionBy("fingerprint").orderBy("df", "s"))
    )
    # length ranges grow by 1 / at_least, so partners are in the same or in a neighbouring one
    held = ranked.where(F.col("df") > 1).where(F.col("r") <= F.col("n") - F.ceil(F.lit(at_least) * F.col("n")) + 1)
    held = held.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(at_least))).cast("int"))
    held = scratch.keep(held.select("fingerprint", "s", "range", "n"), "rare")
    other = held.select(F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("range"), "s", F.col("fingerprint").alias("b"), F.col("n").alias("m"))
    pairs = held.join(other, ["range", "s"]).where("fingerprint != b").where(F.least("n", "m") >= F.lit(at_least) * F.greatest("n", "m"))
    pairs = pairs.select(F.least("fingerprint", "b").alias("a"), F.greatest("fingerprint", "b").alias("b")).distinct()
    full = classes.select(F.col("fingerprint").alias("a"), F.col("signatures").alias("x"))
    both = pairs.join(full, "a").join(full.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    links = both.select("a", "b", likeness(F.col("x"), F.col("y"), at_least).alias("likeness")).where(F.col("likeness") >= at_least)
    return signed.select("fingerprint", "doc_id"), links


SHARD_BYTES, MOST_SHARDS = 4 << 20, 10_000


def in_order(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """`docs` (with uid and text) dealt out so that `lead` over the window sees the row with the next uid.

    After the last row comes the first. Rows that only serve as the next one of a shard's last row have _late
    set, and are to be dropped afterwards. Rows are dealt out by ranges of uid of about SHARD_BYTES of text, at most MOST_SHARDS of them; the first row of
    each range is also given to the range before it.
    """
    sizes = docs.select("uid", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES)))
    cuts = docs.agg(F.percentile_approx("uid", [i / shards for i in range(1, shards)] or [0.5], 10 * shards)).first()[0] or []
    splits = [-math.inf, *sorted({float(c) for c in cuts} or {0.0}), math.inf]
    keys = docs.select("uid", F.col("uid").cast("double").alias("_at"))
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="shard")
    whole = F.col("shard").cast("int")  # a window would deal rows out anew by a floating-point number
    first = cut.transform(keys).withColumn("shard", whole).groupBy("shard").agg(F.min("uid").alias("uid"))
    # one row per shard, so this window and the broadcast are bounded by MOST_SHARDS
    order = Window.orderBy("shard")
    before = first.select("uid", F.lag("shard").over(order).alias("before"), F.max("shard").over(Window.partitionBy()).alias("last"))
    before = F.broadcast(before.select("uid", F.coalesce("before", "last").alias("shard")))
    placed = cut.transform(docs.withColumn("_at", F.col("uid").cast("double"))).drop("_at").withColumn("shard", whole)
    placed = placed.withColumn("_late", F.lit(False))
    extra = docs.join(before, "uid").withColumn("_late", F.lit(True)).select(placed.columns)
    dealt = placed.unionByName(extra).repartition("shard")
    row = Window.partitionBy("shard").orderBy("_late", "uid")
    return dealt, row


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter taken from the next document."""
    rows = keyed(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    dealt, row = in_order(rows)
    signed = with_signatures(dealt, F.col("text"), "signatures")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    moved = signed.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "_late",
        "signatures",
        F.lead("signatures").over(row).alias("_next"),
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.lead("text").over(row), F.lit(1), quarter)).alias("_edited"),
    ).where("NOT _late")
    both = with_signatures(moved, F.col("_edited"), "_signatures")
    return both.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("_next")).alias("near_next"),
    )
