"""Post views, the Atom feed and the asset manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import media as M
from postmill.functions import text as X
from postmill.functions import times as TM
from postmill.functions import xml
from postmill.functions.mime import media_class, mime_type
from postmill.operators.listing import newest_first, with_avatar
from postmill.schema import Site

# fixed value: style of media shown without known size
FREE_SIZE = "max-width:550px;height:auto;max-height:500px"


def _attr(name: str, value: Column) -> Column:
    """An HTML attribute, absent when its value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), xml.escape(value), F.lit('"')), F.lit(""))


def _media_html(media: Column, full_url: Column, media_url: Column) -> Column:
    kind = media_class(media["content_type"], media["url"])
    box = M.fit(media["width"], media["height"])
    video = F.concat(
        F.lit(
            '<p><video autoplay="autoplay" loop="loop" muted="muted" playsinline="playsinline" controls="controls" '
            f'style="{FREE_SIZE}"><source'
        ),
        _attr("type", media["content_type"]),
        _attr("src", media_url),
        F.lit("/></video></p>"),
    )
    w, h = box["w"].cast("string"), box["h"].cast("string")
    sized = F.concat(F.lit(' style="width:'), w, F.lit("px;height:"), h, F.lit('px" width="'), w, F.lit('" height="'), h, F.lit('"'))
    image = F.concat(
        F.lit("<img"), _attr("src", media_url), F.coalesce(sized, F.lit(f' style="{FREE_SIZE}"')), F.lit("/>")
    )
    linked = F.when(full_url.isNotNull(), F.concat(F.lit("<a"), _attr("href", full_url), F.lit(">"), image, F.lit("</a>")))
    picture = F.concat(F.lit("<p>"), F.coalesce(linked, image), F.lit("</p>"))
    # media of another kind gets an empty paragraph; the entry itself is kept
    return F.when(media.isNull(), "").when(kind == "video", video).when(kind == "image", picture).otherwise("<p></p>")


def feed_rows(posts: DataFrame, site: Site) -> DataFrame:
    """The newest visible posts with their feed fields: url, media url and HTML content."""
    # the ids first, from narrow columns; then the bodies of so many posts
    top = newest_first(posts).select("id").limit(site.feed_size)
    newest = posts.join(F.broadcast(top), "id", "left_semi")
    host = F.lit(site.hostname)
    url = F.concat(
        host,
        F.when(F.col("old_id").isNotNull(), F.concat(F.lit("/post/"), F.col("old_id"))).otherwise(
            F.concat(F.lit("/"), F.col("id").cast("string"))
        ),
    )

    def location(media: str) -> Column:
        m = F.col(media)
        old = F.concat(F.col("url"), F.lit("/"), m["old_url"])
        return F.coalesce(old, F.concat(host, F.lit("/media/"), m["url"]))

    strong = F.concat(F.lit("<strong>"), xml.escape(F.col("author")), F.lit(": </strong>"))
    rows = newest.withColumn("url", url).withColumn("media_url", location("media")).withColumn("full_url", location("media_full"))
    return rows.select(
        "id",
        "author",
        "created",
        "updated",
        "url",
        "media_url",
        F.col("media.content_type").alias("media_type"),
        F.col("media").isNotNull().alias("has_media"),
        F.concat(
            _media_html(F.col("media"), F.col("full_url"), F.col("media_url")), X.format_text(F.concat(strong, F.col("body")))
        ).alias("content"),
    )


def feed_entries(rows: DataFrame, site: Site) -> DataFrame:
    """`id, updated, entry` with each entry as XML text."""
    enclosure = F.when(
        F.col("has_media"), xml.leaf("link", {"rel": "enclosure", "type": F.col("media_type"), "href": F.col("media_url")}, None, 2)
    )
    entry = xml.branch(
        "entry",
        {},
        [
            xml.leaf("title", {}, F.concat(F.col("author"), F.lit(site.entry_suffix)), 2),
            xml.leaf("link", {"rel": "alternate", "type": "text/html", "href": F.col("url")}, None, 2),
            enclosure,
            xml.leaf("id", {}, F.col("url"), 2),
            xml.leaf("published", {}, F.date_format("created", TM.ISO), 2),
            xml.leaf("updated", {}, F.date_format("updated", TM.ISO), 2),
            xml.branch("author", {}, [xml.leaf("name", {}, F.col("author"), 3)], 2),
            xml.leaf("content", {"type": "html"}, F.col("content"), 2),
        ],
        1,
    )
    return rows.select("id", "updated", entry.alias("entry"))


def feed(posts: DataFrame, authors: DataFrame, site: Site, now: Column) -> DataFrame:
    """The whole feed as one row `xml`; it holds `site.feed_size` entries, newest first."""
    entries = feed_entries(feed_rows(posts, site), site)
    ordered = F.sort_array(F.collect_list(F.struct("id", "entry")), asc=False)
    body = entries.agg(
        F.array_join(F.transform(ordered, lambda x: x["entry"]), "").alias("entries"),
        F.coalesce(F.max("updated"), now).alias("updated"),
    )
    named = F.sort_array(F.collect_list(F.struct("ord", "user_name")))
    author_xml = F.array_join(
        F.transform(named, lambda a: xml.branch("author", {}, [xml.leaf("name", {}, a["user_name"], 2)], 1)), ""
    )
    host = site.hostname
    document = xml.branch(
        "feed",
        {"xmlns": "http://www.w3.org/2005/Atom", "xml:lang": site.lang, "xml:base": host + "/"},
        [
            xml.leaf("title", {}, site.title, 1),
            xml.leaf("subtitle", {}, site.subtitle, 1),
            xml.leaf("icon", {}, host + site.icon, 1),
            xml.leaf("link", {"type": "application/atom+xml", "href": host + "/feed.xml", "rel": "self"}, None, 1),
            xml.leaf("link", {"type": "text/html", "href": host + "/", "rel": "alternate"}, None, 1),
            xml.leaf("id", {}, host + "/", 1),
            xml.leaf("updated", {}, F.date_format("updated", TM.ISO), 1),
            authors.agg(author_xml.alias("authors")).scalar(),
            F.col("entries"),
        ],
        0,
    )
    return body.select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), document).alias("xml"))


def sitemap_lines(rows: DataFrame) -> DataFrame:
    """Sitemap rows as ordered XML lines, head and foot included."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    url = F.concat(F.lit("  <url>\n"), xml.leaf("loc", {}, F.col("loc"), 2), F.lit("  </url>"))
    lines = rows.select("section", "ord", url.alias("value"))
    ends = rows.sparkSession.createDataFrame([(-1, 0, head), (9, 0, "</urlset>")], lines.schema)
    return lines.unionByName(ends)


def post_view(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """What a page shows of a post: avatar, media block, body and date line."""
    m = F.col("media")
    src = F.concat(F.lit("/media/"), m["url"])
    kind = media_class(m["content_type"], m["url"])
    box = F.when(kind == "image", M.fit(m["width"], m["height"]))
    text = F.concat(F.lit('<span class="post_author">'), F.col("author"), F.lit(": </span>"), F.col("body"))
    return with_avatar(posts, authors).withColumn("text", text).select(
        "id",
        "avatar_url",
        src.alias("src"),
        F.when(m.isNotNull(), F.coalesce(F.concat(F.lit("/media/"), F.col("media_full.url")), src)).alias("href"),
        kind.alias("media_class"),
        F.when(kind == "video", mime_type(m["url"])).alias("source_type"),
        box["w"].alias("box_w"),
        F.when(kind == "image", M.aspect_percent(m["width"], m["height"])).alias("aspect"),
        X.format_text(F.col("text")).alias("body_html"),
        F.date_format("created", TM.DATE).alias("date_text"),
    )


def post_json(posts: DataFrame) -> DataFrame:
    """`id, json` with the attribute names of the API."""
    fields = F.struct(
        F.col("id").alias("post/id"),
        F.col("author").alias("post/author"),
        F.col("body").alias("post/body"),
        F.date_format("created", TM.ISO).alias("post/created"),
        F.when(
            F.col("media").isNotNull(),
            F.struct(F.col("media.url").alias("media/url"), F.col("media.version").alias("media/version")),
        ).alias("post/media"),
    )
    return posts.select("id", F.to_json(fields).alias("json"))


def asset_manifest(files: DataFrame) -> DataFrame:
    """`name?checksum=sha1` of each file's trimmed content, from rows `name, content`; null content
    (an unreadable file) gives a null link."""
    trimmed = F.regexp_replace("content", r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    return files.select("name", F.concat(F.col("name"), F.lit("?checksum="), F.sha1(trimmed)).alias("link"))
