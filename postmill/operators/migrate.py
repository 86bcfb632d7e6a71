"""Migrations of legacy posts, version by version, as DataFrame transformations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.media import legacy_path
from postmill.operators import facts as FX
from postmill.operators.ordering import numbered
from postmill.sources.commits import Commits

TELEGRAM = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("photo", T.StringType())])
PICTURE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("dimensions", T.ArrayType(T.LongType())),
        T.StructField("telegram", TELEGRAM),
    ]
)
REPOST = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "channel", "message_id", "photo")])
# fixed values: names of a version-1 file and what they become, repost types and what they become
FIRST_VERSION = r"(\d+)(_1)(_full)?\.([a-z0-9]+)"
UNVERSIONED = "$1$3.$4"
CROSSPOST_TYPES = {"telegram/photo": "tg/media", "telegram/text": "tg/text"}


def split_failures(df: DataFrame, error: Column, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Apply a step to the rows without an error; the others are returned unchanged with it.

    `error` is a message or null; it should use the `try_` functions, so that a bad row cannot end
    the job.
    """
    checked = df.withColumn("error", error)
    good = step(checked.where(F.col("error").isNull()).drop("error"))
    return good, checked.where(F.col("error").isNotNull())


def to_2(posts: DataFrame) -> DataFrame:
    """The first of `pictures` becomes `picture`."""
    first = F.get("pictures", F.lit(0))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in PICTURE.fields[1:]]
    picture = F.when(first.isNotNull(), F.struct(first.alias("url"), *none))
    if "picture" in posts.columns:
        picture = F.coalesce(picture, F.col("picture"))
    return posts.withColumn("picture", picture).drop("pictures")


def to_3(posts: DataFrame, channel: str) -> DataFrame:
    """Telegram ids move into `reposts`: text, then original, then picture, after existing ones."""

    def photo(picture: str) -> Column:
        t = F.col(picture)["telegram"]
        present = t["message_id"].isNotNull() | t["photo"].isNotNull()
        return F.when(present, _repost("telegram/photo", channel, t["message_id"], t["photo"]))

    text_id = F.col("telegram_message_id")
    text = F.when(text_id.isNotNull(), _repost("telegram/text", channel, text_id, F.lit(None).cast("string")))
    added = F.array_compact(F.array(text, photo("picture_original"), photo("picture")))
    old = F.coalesce("reposts", F.array().cast(T.ArrayType(REPOST)))
    out = posts.withColumn("reposts", F.concat(old, added))
    for name in ("picture", "picture_original"):
        out = out.withColumn(name, F.col(name).dropFields("telegram"))
    return out.drop("telegram_message_id")


def _repost(kind: str, channel: str, message_id: Column, photo: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(channel).alias("channel"), message_id.alias("message_id"), photo.alias("photo"))


def _media(picture: str, full: bool) -> Column:
    p = F.col(picture)
    year = F.year("created").cast("string")
    return F.when(
        p.isNotNull(),
        F.struct(
            legacy_path(year, F.col("post_id").cast("string"), full, p["url"]).alias("url"),
            p["url"].alias("old_url"),
            p["content_type"].alias("content_type"),
            F.get(p["dimensions"], 0).alias("width"),
            F.get(p["dimensions"], 1).alias("height"),
            F.lit(1).cast("bigint").alias("version"),
        ),
    )


def to_4(posts: DataFrame) -> DataFrame:
    """New ids 1..n in creation order (ties by old id) and the current shape of a post.

    A repost of unknown type is an error.
    """
    none = F.lit(None)
    crosspost = F.transform(
        "reposts",
        lambda r: F.struct(
            _map_type(r["type"]).alias("type"), r["channel"].alias("channel"), r["message_id"].alias("message_id"),
            none.cast("string").alias("media_id"), none.cast("array<string>").alias("ids"),
        ),
    )
    return numbered(posts, ["created", "id"], "post_id").select(
        F.col("post_id").alias("id"),
        F.col("id").alias("old_id"),
        "author",
        "body",
        "created",
        "updated",
        F.lit(None).cast("boolean").alias("deleted"),
        _media("picture", False).alias("media"),
        _media("picture_original", True).alias("media_full"),
        crosspost.alias("crosspost"),
    )


def _map_type(kind: Column) -> Column:
    mapped = None
    for old, new in CROSSPOST_TYPES.items():
        mapped = F.when(kind == old, new) if mapped is None else mapped.when(kind == old, new)
    unknown = F.concat(F.lit("unknown type of repost: "), F.coalesce(kind, F.lit("null")))
    return mapped.otherwise(F.raise_error(unknown).cast("string"))


def copy_manifest(posts: DataFrame) -> DataFrame:
    """Files to copy after `to_4`: `from, to` for every media of every post."""
    each = posts.select("old_id", F.explode(F.array("media", "media_full")).alias("m")).where(F.col("m").isNotNull())
    return each.select(F.concat("old_id", F.lit("/"), F.col("m.old_url")).alias("from"), F.col("m.url").alias("to"))


def to_5(facts: DataFrame, tx: int) -> tuple[DataFrame, DataFrame]:
    """Drops `_1` from the names of version-1 media: change rows, and the files to move."""
    now = FX.current(facts.where(F.col("a").isin("media/url", "media/version")))
    urls = now.where(F.col("a") == "media/url").select("e", F.col("v_str").alias("from"))
    first = now.where((F.col("a") == "media/version") & (F.col("v_long") == 1)).select("e")
    renamed = urls.join(first, "e").withColumn("to", F.regexp_replace("from", FIRST_VERSION, UNVERSIONED))
    return FX.fact_rows(renamed, "e", {"media/url": F.col("to")}, tx), renamed.select("from", "to")


def migrate(posts: DataFrame, version: int, steps: list[tuple[int, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, int]:
    """Apply each step above the current version in order; the new version is returned too."""
    for target, step in steps:
        if version < target:
            posts, version = step(posts), target
    return posts, version


def schema_version(meta: DataFrame) -> DataFrame:
    """One row `version` from a table that may be empty; the first version is 1."""
    return meta.agg(F.coalesce(F.max("version"), F.lit(1)).cast("bigint").alias("version"))


def stored_facts(posts: DataFrame, tx: int) -> DataFrame:
    """The first facts of posts in the current shape. A post is the entity of its id; media and crossposts are numbered after the posts."""
    top = posts.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    most = posts.agg(F.coalesce(F.max(F.size("crosspost")), F.lit(0))).scalar()
    owned = posts.withColumn("first", top + 1 + (F.col("id") - 1) * (most + 2)).withColumn("e", F.col("id"))
    held = owned.withColumns(
        {
            "media_ref": F.when(F.col("media").isNotNull(), F.col("first")),
            "full_ref": F.when(F.col("media_full").isNotNull(), F.col("first") + 1),
            "crosspost_refs": F.transform("crosspost", lambda _, i: F.col("first") + 2 + i),
        }
    )
    return FX.facts_of_posts(held, tx)


class Journal:
    """A chain of migrations over stored tables, with the version reached.

    A step gets the table that the step before left and returns the next one, of any shape. It is written to a folder of its own and becomes current by
    one published file that also has the new version; a step that fails leaves the version before it as it is, and the next
    run goes on there. A run with nothing left to do reads nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/versions")

    def version(self) -> int:
        return (self.commits.latest() or {"version": 0})["version"]

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.commits.latest()['table']}")

    def keep(self, table: DataFrame, version: int) -> bool:
        """Makes a table the given version; False if that version is there already."""
        name = f"table-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        return self.commits.publish(version, {"version": version, "table": name})

    def run(self, steps: list[tuple[int, Callable[[DataFrame], DataFrame]]]) -> list[int]:
        """Applies each step above the stored version, in order. Returns the versions it reached."""
        reached = []
        for target, step in steps:
            if self.version() < target:
                self.keep(step(self.table()), target)
                reached.append(target)
        return reached
