"""Listings: visible posts, pages, page windows, sitemap, redirects, contributors, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import first_mention
from postmill.schema import Site

# fixed values: page links shown in the archive and in search results
ARCHIVE_WINDOW = 8
SEARCH_WINDOW = 12


def visible(posts: DataFrame) -> DataFrame:
    """Posts shown in listings: those on which `deleted` was never set, whatever its value."""
    return posts.where(F.col("deleted").isNull())


def newest_first(posts: DataFrame) -> DataFrame:
    return visible(posts).orderBy(F.desc("id"))


def pages_for(count: Column, size: int) -> Column:
    """Number of pages for `count` consecutive ids or hits; none when there is nothing."""
    return F.when(count > 0, F.call_function("div", count - 1, F.lit(size)) + 1).otherwise(
        F.lit(0).cast("bigint")
    )


def total_pages(posts: DataFrame, size: int) -> DataFrame:
    """One row `max_id, total_pages, next_id`; deleted posts count."""
    top = posts.agg(F.max("id").alias("max_id"))
    return top.select(
        "max_id",
        pages_for(F.col("max_id"), size).alias("total_pages"),
        (F.coalesce("max_id", F.lit(0)) + 1).alias("next_id"),
    )


def page_of(post_id: Column, size: int) -> Column:
    """Pages are ranges of ids, so a page number is arithmetic, with no ranking."""
    return F.call_function("div", post_id - 1, F.lit(size)) + 1


def page_manifest(posts: DataFrame, size: int, drop_deleted: bool = False) -> DataFrame:
    """`page, ids` with the newest id first. A group holds at most `size` ids."""
    source = visible(posts) if drop_deleted else posts
    return source.groupBy(page_of(F.col("id"), size).alias("page")).agg(
        F.reverse(F.sort_array(F.collect_list("id"))).alias("ids")
    )


def page_posts(posts: DataFrame, page: int, size: int) -> DataFrame:
    """Posts of one numbered page; nothing outside `1 .. total`. The id range reaches the scan."""
    if page < 1:
        return posts.limit(0)
    return posts.where(F.col("id").between(size * (page - 1) + 1, size * page)).orderBy(F.desc("id"))


def index_page(posts: DataFrame, size: int) -> DataFrame:
    """The front page: visible posts of the last two id ranges, newest first."""
    total = total_pages(posts, size).select("total_pages").scalar()
    in_range = F.col("id").between((total - 2) * size + 1, total * size)
    return newest_first(posts.where(in_range))


def archive_window(page: Column, total: Column) -> Column:
    """Page links around `page`, newest page first: `struct<page, pages, gap_before, gap_after>`.

    The front page shows the last two pages, hence one page less than `total`. A negative page
    counts from the newest.
    """
    half = ARCHIVE_WINDOW // 2
    top = total - 1
    here = F.when(page < 0, top - (page + 1)).otherwise(page)
    empty = F.array().cast("array<bigint>")

    def down(first: Column, last: Column) -> Column:
        return F.when(first >= last, F.sequence(first, F.least(first, last), F.lit(-1).cast("bigint"))).otherwise(empty)

    one = F.lit(1).cast("bigint")
    pages = (
        F.when(top - here < 2 + half, down(top, F.greatest(one, top - (ARCHIVE_WINDOW + 1))))
        .when(here - 1 < half, down(F.least(F.lit(ARCHIVE_WINDOW).cast("bigint"), top), one))
        .otherwise(down(here + half - 1, here + half - ARCHIVE_WINDOW))
    )
    return F.transform(
        F.array(pages),
        lambda p: F.struct(
            here.alias("page"),
            p.alias("pages"),
            F.coalesce(F.get(p, F.lit(0)) < top, F.lit(False)).alias("gap_before"),
            F.coalesce(F.get(p, F.size(p) - 1) > 1, F.lit(False)).alias("gap_after"),
        ),
    )[0]


def search_window(page: Column, hits: Column, size: int) -> Column:
    """Page links of a search result, ascending: `struct<page, pages, gap_before, gap_after>`."""
    half = SEARCH_WINDOW // 2
    last = pages_for(hits, size)
    one = F.lit(1).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def up(first: Column, final: Column) -> Column:
        return F.when(first <= final, F.sequence(first, F.greatest(first, final), one)).otherwise(empty)

    pages = (
        F.when(page - 1 < 2 + half, up(one, F.least(F.lit(SEARCH_WINDOW + 2).cast("bigint"), last)))
        .when(last - page < half, up(F.greatest(one, last - SEARCH_WINDOW), last))
        .otherwise(up(page - half + 1, page - half + SEARCH_WINDOW))
    )
    return F.transform(
        F.array(pages),
        lambda p: F.struct(
            page.alias("page"),
            p.alias("pages"),
            F.coalesce(F.get(p, F.lit(0)) > 1, F.lit(False)).alias("gap_before"),
            F.coalesce(F.get(p, F.size(p) - 1) < last, F.lit(False)).alias("gap_after"),
        ),
    )[0]


def sitemap(posts: DataFrame, site: Site, block: int = 100_000) -> DataFrame:
    """Rows `section, ord, loc`: fixed pages, visible posts newest first, pages `total-1 .. 1`."""
    host = site.hostname
    total = total_pages(posts, site.page_size)
    fixed = total.select(
        F.lit(0).alias("section"),
        F.posexplode(F.array(*[F.lit(host + path) for path in ("", "/subscribe", "/suggest", "/about")])).alias("ord", "loc"),
    ).select("section", F.col("ord").cast("bigint").alias("ord"), "loc")
    entries = visible(posts).select(
        F.lit(1).alias("section"), (-F.col("id")).alias("ord"), F.concat(F.lit(host + "/"), F.col("id").cast("string")).alias("loc")
    )
    # page numbers are spread in blocks, so that no single row unfolds into all of them
    last = F.col("total_pages") - 1
    blocks = total.where(last >= 1).select(
        last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", last - 1, F.lit(block)))).alias("blk")
    )
    pages = (
        blocks.repartition("blk")
        .select(F.explode(F.sequence(F.col("blk") * block + 1, F.least((F.col("blk") + 1) * block, F.col("last")))).alias("page"))
        .select(F.lit(2).alias("section"), (-F.col("page")).alias("ord"), F.concat(F.lit(host + "/page/"), F.col("page").cast("string")).alias("loc"))
    )
    return fixed.unionByName(entries).unionByName(pages)


def contributors(posts: DataFrame, exclude: list[str]) -> DataFrame:
    """People mentioned first in some body: one row per name ignoring case, the spelling of the
    last post wins, names in `exclude` (lower case) left out."""
    # Bodies without a mention are dropped after the aggregation, as its null group: a filter on the
    # mention itself would be pushed to the scan and repeat the pattern search there. The substring
    # test spares most bodies the search.
    mention = posts.where(F.col("body").contains("@")).select("id", first_mention(F.col("body")).alias("who"))
    names = mention.groupBy(F.lower("who").alias("handle")).agg(F.max_by("who", "id").alias("who"))
    names = names.where(F.col("who").isNotNull())
    return names.where(~F.col("handle").isin(exclude)) if exclude else names


def resolve(lookups: DataFrame, posts: DataFrame) -> DataFrame:
    """HTTP status of each requested `post_id`: found, missing or deleted (here by truth)."""
    found = posts.select(F.col("id").alias("post_id"), "deleted", F.lit(True).alias("found"))
    missing = F.col("found").isNull()
    gone = F.coalesce("deleted", F.lit(False))
    return lookups.join(found, "post_id", "left").select(
        "post_id",
        F.when(missing | gone, 404).otherwise(200).alias("status"),
        F.when(missing, "Not found").when(gone, "Deleted").otherwise("OK").alias("message"),
    )


def post_redirects(lookups: DataFrame, posts: DataFrame) -> DataFrame:
    """New location for each old post id, null when unknown."""
    known = posts.where(F.col("old_id").isNotNull()).select("old_id", F.concat(F.lit("/"), F.col("id").cast("string")).alias("location"))
    return lookups.select("old_id").join(known, "old_id", "left")


def media_redirects(lookups: DataFrame, media: DataFrame) -> DataFrame:
    """New location for each old media url, null when unknown."""
    known = media.where(F.col("old_url").isNotNull()).select("old_url", F.concat(F.lit("/media/"), F.col("url")).alias("location"))
    return lookups.select("old_url").join(known, "old_url", "left")


def author_by(authors: DataFrame, attr: str) -> DataFrame:
    """The author dimension keyed by one attribute, the first author (by `ord`) on equal values."""
    others = [c for c in authors.columns if c != attr]
    first = F.min_by(F.struct(*others), "ord")
    return authors.where(F.col(attr).isNotNull()).groupBy(attr).agg(first.alias("author")).select(attr, "author.*")


def with_avatar(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds `avatar_url`: the author's picture, or the guest's for names not among the authors.

    The join carries no broadcast hint: the optimizer broadcasts the dimension while it is small.
    """
    known = author_by(authors, "user_name").select(F.col("user_name").alias("author"), F.lit(True).alias("known"))
    picture = F.when(F.col("known"), F.concat(F.lit("/static/"), F.col("author"), F.lit(".jpg"))).otherwise("/static/guest.jpg")
    return posts.join(known, "author", "left").withColumn("avatar_url", picture).drop("known")
