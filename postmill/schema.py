"""Entity schemas, the attribute catalogue of the fact log, and site settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MEDIA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("old_url", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)

CROSSPOST = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("media_id", T.StringType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
    ]
)

POST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("old_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("media", MEDIA),
        T.StructField("media_full", MEDIA),
        T.StructField("crosspost", T.ArrayType(CROSSPOST)),
    ]
)

# One row of the fact log. Exactly one v_ column is set, as the attribute's type says; `ord` orders
# the facts of one transaction.
FACT = T.StructType(
    [
        T.StructField("e", T.LongType()),
        T.StructField("a", T.StringType()),
        T.StructField("v_str", T.StringType()),
        T.StructField("v_long", T.LongType()),
        T.StructField("v_ts", T.TimestampType()),
        T.StructField("v_bool", T.BooleanType()),
        T.StructField("v_arr", T.ArrayType(T.StringType())),
        T.StructField("tx", T.LongType()),
        T.StructField("ord", T.LongType()),
        T.StructField("op", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Attr:
    name: str
    column: str  # the v_ column that holds its value
    unique: bool = False
    many: bool = False
    component: bool = False  # a reference to an owned child entity
    bulky: bool = False  # values too large to be folded with the others


# fixed values: attribute names and flags of the data model
ATTRS = [
    Attr("post/id", "v_long", unique=True),
    Attr("post/old-id", "v_str", unique=True),
    Attr("post/body", "v_str", bulky=True),
    Attr("post/author", "v_str"),
    Attr("post/created", "v_ts"),
    Attr("post/updated", "v_ts"),
    Attr("post/deleted?", "v_bool"),
    Attr("post/media", "v_long", component=True),
    Attr("post/media-full", "v_long", component=True),
    Attr("media/url", "v_str", unique=True),
    Attr("media/old-url", "v_str", unique=True),
    Attr("media/content-type", "v_str"),
    Attr("media/width", "v_long"),
    Attr("media/height", "v_long"),
    Attr("media/version", "v_long"),
    Attr("post/crosspost", "v_long", many=True, component=True),
    Attr("crosspost/type", "v_str"),
    Attr("crosspost.tg/channel", "v_str"),
    Attr("crosspost.tg/message-id", "v_str"),
    Attr("crosspost.mstd/media-id", "v_str"),
    Attr("crosspost.mstd/ids", "v_arr"),
]
ATTR = {a.name: a for a in ATTRS}
VALUE_COLUMNS = ["v_str", "v_long", "v_ts", "v_bool", "v_arr"]


@dataclass(frozen=True)
class Site:
    """What a deployment configures: address, wording and sizes."""

    hostname: str = "https://site.example"
    title: str = "Site"
    subtitle: str = ""
    lang: str = "en"
    entry_suffix: str = " posted"
    icon: str = "/static/icon.png"
    page_size: int = 10
    feed_size: int = 10
