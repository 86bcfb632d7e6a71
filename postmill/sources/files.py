"""File sources and sinks: legacy posts, listings, feed and sitemap text, request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.migrate import PICTURE, REPOST

LEGACY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("pictures", T.ArrayType(T.StringType())),
        T.StructField("picture", PICTURE),
        T.StructField("picture_original", PICTURE),
        T.StructField("telegram_message_id", T.StringType()),
        T.StructField("reposts", T.ArrayType(REPOST)),
    ]
)
_MEDIA = T.StructType(
    [
        T.StructField("media/url", T.StringType()),
        T.StructField("media/content-type", T.StringType()),
        T.StructField("media/width", T.LongType()),
        T.StructField("media/height", T.LongType()),
    ]
)
EDIT = T.StructType(
    [
        T.StructField("post/body", T.StringType()),
        T.StructField("post/author", T.StringType()),
        T.StructField("post/media", _MEDIA),
        T.StructField("post/media-full", _MEDIA),
        T.StructField("_bad", T.StringType()),
    ]
)


def legacy_posts(spark: SparkSession, root: str, name: str = "post.json") -> DataFrame:
    """Legacy posts of a folder tree, one JSON file per post (or lines of JSON), with fixed schema."""
    reader = spark.read.schema(LEGACY).option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return reader.json(root)


def file_listing(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """`path, name, length` of files, names matching a whole regular expression; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.where(F.col("name").rlike(f"^(?:{name})$")) if name else files


def file_texts(spark: SparkSession, root: str) -> DataFrame:
    """`name, content` of small text files. An empty file has no row."""
    # the reader's own column: input_file_name() may already tell the next file of a task
    return spark.read.text(root, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def parse_edits(requests: DataFrame, column: str = "json") -> DataFrame:
    """Edit requests from JSON text, flat, next to the other columns: `body`, `author`, and url, content type, width and
    height of `media` and `full`. `bad` holds the text of a request that is no such JSON (or null) and must
    not be applied; `good_edits` drops these."""
    others = [c for c in requests.columns if c != column]
    parsed = requests.withColumn("_r", F.from_json(column, EDIT, {"columnNameOfCorruptRecord": "_bad"}))
    r = F.col("_r")
    media = [
        r[field][f"media/{attr}"].alias(f"{role}_{name}")
        for role, field in (("media", "post/media"), ("full", "post/media-full"))
        for name, attr in (("url", "url"), ("content_type", "content-type"), ("width", "width"), ("height", "height"))
    ]
    bad = F.when(F.col(column).isNull() | r.isNull(), F.coalesce(column, F.lit(""))).otherwise(r["_bad"])
    return parsed.select(*others, r["post/body"].alias("body"), r["post/author"].alias("author"), *media, bad.alias("bad"))


def good_edits(parsed: DataFrame) -> DataFrame:
    return parsed.where("bad IS NULL").drop("bad")


def write_lines(lines: DataFrame, order: list[str | Column], path: str) -> None:
    """Write a column `value` as text in order: part files in name order hold the whole document."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def write_document(document: DataFrame, column: str, path: str) -> None:
    """Write the single row of a rendered document (a feed) as one text file."""
    document.select(column).coalesce(1).write.mode("errorifexists").text(path)


def append_requests(requests: DataFrame, path: str) -> None:
    """Append to the request log, a folder per day."""
    by_day = requests.withColumn("day", F.to_date("ts"))
    by_day.write.mode("append").partitionBy("day").parquet(path)
