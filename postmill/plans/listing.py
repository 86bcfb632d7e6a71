"""Listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import mime
from postmill.operators import listing as L
from postmill.plans import fixtures as fx
from postmill.plans.registry import query
from postmill.schema import Site

SITE = Site()
SIZE = SITE.page_size
EXCLUDED = ["src3", "src15", "mention"]


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


@query("s2_ids_in_order", "SELECT id FROM fx_posts ORDER BY id")
def s2(spark, sf):
    return fx.fx_posts(spark, sf).select("id").orderBy("id")


@query("p4_id_range", "SELECT id, author FROM fx_posts WHERE id BETWEEN 101 AND 450")
def p4(spark, sf):
    return fx.fx_posts(spark, sf).where(F.col("id").between(101, 450)).select("id", "author")


@query("p5_visible_posts", "SELECT id, author, updated FROM fx_posts WHERE deleted IS NULL")
def p5(spark, sf):
    return L.visible(fx.fx_posts(spark, sf)).select("id", "author", F.col("updated").cast("timestamp_ntz").alias("updated"))


@query(
    "p6_unique_lookup",
    """SELECT p.id, p.old_id, m.url, m.old_url FROM fx_posts p JOIN fx_media m ON m.post_id = p.id
       WHERE p.old_id = 'old24' AND m.old_url = 'pic25.gif'
       UNION ALL SELECT id, old_id, media_url, NULL FROM fx_posts WHERE id = 7""",
)
def p6(spark, sf):
    posts = fx.posts(spark, sf)
    old = posts.where((F.col("old_id") == "old24") & (F.col("media.old_url") == "pic25.gif"))
    old = old.select("id", "old_id", "media.url", "media.old_url")
    new = posts.where(F.col("id") == 7).select("id", "old_id", "media.url", F.lit(None).cast("string").alias("old_url"))
    return old.unionByName(new)


@query(
    "p7_resolve_status",
    """SELECT l.post_id, CASE WHEN p.id IS NULL OR coalesce(p.deleted, false) THEN 404 ELSE 200 END AS status,
         CASE WHEN p.id IS NULL THEN 'Not found' WHEN coalesce(p.deleted, false) THEN 'Deleted' ELSE 'OK' END AS message
       FROM fx_lookups l LEFT JOIN fx_posts p ON p.id = l.post_id""",
)
def p7(spark, sf):
    return L.resolve(fx.fx_lookups(spark, sf), fx.fx_posts(spark, sf))


@query(
    "p8_page_bounds",
    """SELECT DISTINCT post_id AS page FROM fx_lookups
       WHERE post_id BETWEEN 1 AND (SELECT (max(id) - 1) // 10 + 1 FROM fx_posts)""",
)
def p8(spark, sf):
    total = L.total_pages(fx.fx_posts(spark, sf), SIZE).select("total_pages").scalar()
    asked = fx.fx_lookups(spark, sf).select(F.col("post_id").alias("page")).distinct()
    return asked.where(F.col("page").between(F.lit(1), total))


@query(
    "jn5_restrict_to_ids",
    "SELECT id, author, old_id FROM fx_posts WHERE id IN (SELECT post_id FROM fx_lookups)",
)
def jn5(spark, sf):
    ids = fx.fx_lookups(spark, sf).select(F.col("post_id").alias("id"))
    return fx.fx_posts(spark, sf).select("id", "author", "old_id").join(ids, "id", "left_semi")


@query(
    "jn6_without_attribute",
    """SELECT DISTINCT f.e FROM fx_facts f WHERE f.a = 'post/body'
       AND NOT EXISTS (SELECT 1 FROM fx_facts g WHERE g.e = f.e AND g.a = 'post/author' AND g.op = 'retract')""",
)
def jn6(spark, sf):
    facts = fx.fx_facts(spark, sf)
    having = facts.where((F.col("a") == "post/author") & (F.col("op") == "retract")).select("e")
    return facts.where(F.col("a") == "post/body").select("e").join(having, "e", "left_anti").distinct()


@query(
    "jn10_post_redirects",
    """SELECT l.old_id, '/' || p.id::varchar AS location FROM fx_lookups l LEFT JOIN fx_posts p ON p.old_id = l.old_id""",
)
def jn10(spark, sf):
    return L.post_redirects(fx.fx_lookups(spark, sf), fx.fx_posts(spark, sf))


@query(
    "jn10_media_redirects",
    """SELECT l.old_url, '/media/' || m.url AS location
       FROM (SELECT concat('pic', post_id::varchar, '.mp4') AS old_url FROM fx_lookups) l
       LEFT JOIN fx_media m ON m.old_url = l.old_url""",
)
def jn10b(spark, sf):
    asked = fx.fx_lookups(spark, sf).select(F.concat(F.lit("pic"), F.col("post_id").cast("string"), F.lit(".mp4")).alias("old_url"))
    return L.media_redirects(asked, fx.fx_media(spark, sf))


@query(
    "jn12_exclude_names",
    "SELECT id, author FROM fx_posts WHERE author NOT IN ('src3', 'src15', 'mention')",
)
def jn12(spark, sf):
    return fx.fx_posts(spark, sf).where(~F.col("author").isin(EXCLUDED)).select("id", "author")


@query(
    "a1_a3_max_id_pages_next_id",
    "SELECT max(id) AS max_id, (max(id) - 1) // 10 + 1 AS total_pages, coalesce(max(id), 0) + 1 AS next_id FROM fx_posts",
)
def a1(spark, sf):
    return L.total_pages(fx.fx_posts(spark, sf), SIZE)


@query(
    "a4_latest_update",
    "SELECT author, max(updated) AS updated FROM fx_posts GROUP BY author",
)
def a4(spark, sf):
    return fx.fx_posts(spark, sf).groupBy("author").agg(F.max("updated").cast("timestamp_ntz").alias("updated"))


@query(
    "a5_contributors",
    """SELECT lower(who) AS handle, max_by(who, id) AS who FROM (
         SELECT id, nullif(regexp_extract(body, '(?:^|[> ])@([A-Za-z0-9_]+)', 1), '') AS who FROM fx_posts)
       WHERE who IS NOT NULL AND lower(who) NOT IN ('src3', 'src15', 'mention') GROUP BY 1 ORDER BY 1""",
)
def a5(spark, sf):
    return L.contributors(fx.fx_posts(spark, sf), EXCLUDED).orderBy("handle")


@query("a11_indexed_posts", "SELECT count(*) AS posts FROM fx_posts")
def a11(spark, sf):
    return fx.fx_posts(spark, sf).agg(F.count("*").alias("posts"))


@query("o1_newest_first", "SELECT id FROM fx_posts WHERE deleted IS NULL ORDER BY id DESC")
def o1(spark, sf):
    return L.newest_first(fx.fx_posts(spark, sf)).select("id")


@query("o2_first_ten", "SELECT id FROM fx_posts WHERE deleted IS NULL ORDER BY id DESC LIMIT 10")
def o2(spark, sf):
    return L.newest_first(fx.fx_posts(spark, sf)).select("id").limit(SITE.feed_size)


@query("o5_case_insensitive_order", "SELECT DISTINCT lower(author) AS author FROM fx_posts ORDER BY 1")
def o5(spark, sf):
    return fx.fx_posts(spark, sf).select(F.lower("author").alias("author")).distinct().orderBy("author")


@query("o6_by_created", "SELECT id, created FROM fx_legacy ORDER BY created, id")
def o6(spark, sf):
    return fx.fx_legacy(spark, sf).select("id", F.col("created").cast("timestamp_ntz").alias("created")).orderBy("created", "id")


@query(
    "v1_page_manifest",
    "SELECT (id - 1) // 10 + 1 AS page, string_agg(id::varchar, ',' ORDER BY id DESC) AS ids FROM fx_posts GROUP BY 1",
)
def v1(spark, sf):
    return L.page_manifest(fx.fx_posts(spark, sf), SIZE).select("page", joined(F.col("ids")).alias("ids"))


@query(
    "v1_page_manifest_visible",
    """SELECT (id - 1) // 10 + 1 AS page, string_agg(id::varchar, ',' ORDER BY id DESC) AS ids
       FROM fx_posts WHERE deleted IS NULL GROUP BY 1""",
)
def v1b(spark, sf):
    return L.page_manifest(fx.fx_posts(spark, sf), SIZE, drop_deleted=True).select("page", joined(F.col("ids")).alias("ids"))


@query(
    "v1_page_posts",
    "SELECT id, author, body FROM fx_posts WHERE id BETWEEN 31 AND 40 ORDER BY id DESC",
)
def v1c(spark, sf):
    return L.page_posts(fx.fx_posts(spark, sf), 4, SIZE).select("id", "author", "body")


@query(
    "v2_index_page",
    """WITH t AS (SELECT (max(id) - 1) // 10 + 1 AS total FROM fx_posts)
       SELECT id, author, body FROM fx_posts, t WHERE id BETWEEN 10 * (total - 2) + 1 AND 10 * total
       AND deleted IS NULL ORDER BY id DESC""",
)
def v2(spark, sf):
    return L.index_page(fx.fx_posts(spark, sf), SIZE).select("id", "author", "body")


_WINDOW_COLUMNS = """array_to_string(pages, ',') AS pages, coalesce(pages[1] {before}, false) AS gap_before,
  coalesce(pages[len(pages)] {after}, false) AS gap_after"""


@query(
    "v3a_archive_window",
    f"""WITH t AS (SELECT (max(id) - 1) // 10 + 1 - 1 AS top FROM fx_posts),
        p AS (SELECT DISTINCT (id - 1) // 10 + 1 AS asked FROM fx_posts UNION ALL SELECT -1),
        q AS (SELECT asked, CASE WHEN asked < 0 THEN top - (asked + 1) ELSE asked END AS page, top FROM p, t),
        w AS (SELECT asked, page, top, CASE
            WHEN top - page < 6 THEN list_slice(list_reverse(range(1, top + 1)), 1, 10)
            WHEN page - 1 < 4 THEN list_reverse(range(1, least(8, top) + 1))
            ELSE list_reverse(range(page + 3 - 7, page + 3 + 1)) END AS pages FROM q)
        SELECT asked, page, {_WINDOW_COLUMNS.format(before="< top", after="> 1")} FROM w""",
)
def v3a(spark, sf):
    posts = fx.fx_posts(spark, sf)
    total = L.total_pages(posts, SIZE)
    newest = total.select(F.lit(-1).cast("bigint").alias("asked"))
    asked = posts.select(L.page_of(F.col("id"), SIZE).alias("asked")).distinct().unionByName(newest)
    top = total.select("total_pages").scalar()
    w = asked.withColumn("total", top).withColumn("w", L.archive_window(F.col("asked"), F.col("total")))
    return w.select("asked", "w.page", joined(F.col("w.pages")).alias("pages"), "w.gap_before", "w.gap_after")


@query(
    "v3b_search_window",
    f"""WITH h AS (SELECT author, count(*) * 3 AS hits FROM fx_posts GROUP BY author),
        p AS (SELECT author, (hits - 1) // 10 + 1 AS last, unnest(range(1, (hits - 1) // 10 + 2)) AS page FROM h),
        w AS (SELECT *, CASE
            WHEN page - 1 < 8 THEN list_slice(range(1, last + 1), 1, 14)
            WHEN last - page < 6 THEN range(greatest(1, last - 12), last + 1)
            ELSE range(page - 5, page + 7) END AS pages FROM p)
        SELECT author, page, {_WINDOW_COLUMNS.format(before="> 1", after="< last")} FROM w""",
)
def v3b(spark, sf):
    hits = fx.fx_posts(spark, sf).groupBy("author").agg((F.count("*") * 3).alias("hits"))
    pages = hits.withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), L.pages_for(F.col("hits"), SIZE))))
    w = pages.withColumn("w", L.search_window(F.col("page"), F.col("hits"), SIZE))
    return w.select("author", "page", joined(F.col("w.pages")).alias("pages"), "w.gap_before", "w.gap_after")


_SITEMAP_SQL = """
SELECT 0 AS section, ord, 'https://site.example' || path AS loc
FROM (VALUES (0, ''), (1, '/subscribe'), (2, '/suggest'), (3, '/about')) f(ord, path)
UNION ALL SELECT 1, -id, 'https://site.example/' || id::varchar FROM fx_posts WHERE deleted IS NULL
UNION ALL SELECT 2, -p, 'https://site.example/page/' || p::varchar
FROM (SELECT unnest(range(1, (max(id) - 1) // 10 + 1)) AS p FROM fx_posts)"""


@query("v5_sitemap", _SITEMAP_SQL)
def v5(spark, sf):
    return L.sitemap(fx.fx_posts(spark, sf), SITE)


@query("x1_ordered_concatenation", f"SELECT loc FROM ({_SITEMAP_SQL}) ORDER BY section, ord")
def x1(spark, sf):
    return L.sitemap(fx.fx_posts(spark, sf), SITE).orderBy("section", "ord").select("loc")


@query(
    "x3_set_operations",
    """(SELECT id FROM fx_posts INTERSECT SELECT post_id FROM fx_lookups)
       UNION ALL (SELECT id FROM fx_posts EXCEPT ALL SELECT post_id FROM fx_lookups)""",
)
def x3(spark, sf):
    ids = fx.fx_posts(spark, sf).select("id")
    asked = fx.fx_lookups(spark, sf).select(F.col("post_id").alias("id"))
    return ids.intersect(asked).union(ids.exceptAll(asked))


_FIRST_AUTHOR = "(SELECT {0}, min_by(user_name, ord) AS user_name, min_by(name, ord) AS name FROM fx_authors WHERE {0} IS NOT NULL GROUP BY {0})"


@query(
    "jn7_author_by_user",
    f"""SELECT p.id, p.author, a.name FROM fx_posts p
        LEFT JOIN {_FIRST_AUTHOR.format("user_name").replace("min_by(user_name, ord) AS user_name, ", "")} a ON a.user_name = p.author""",
)
def jn7(spark, sf):
    authors = L.author_by(fx.fx_authors(spark, sf), "user_name").select(F.col("user_name").alias("author"), "name")
    return fx.fx_posts(spark, sf).join(authors, "author", "left").select("id", "author", "name")


@query(
    "jn7_author_by_chat",
    f"""SELECT x.chat, a.user_name, a.name FROM (SELECT DISTINCT 'chat' || (id % 9)::varchar AS chat FROM fx_posts) x
        LEFT JOIN {_FIRST_AUTHOR.format("telegram_chat")} a ON a.telegram_chat = x.chat""",
)
def jn7b(spark, sf):
    authors = L.author_by(fx.fx_authors(spark, sf), "telegram_chat").select(F.col("telegram_chat").alias("chat"), "user_name", "name")
    chats = fx.fx_posts(spark, sf).select(F.concat(F.lit("chat"), (F.col("id") % 9).cast("string")).alias("chat")).distinct()
    return chats.join(authors, "chat", "left")


@query(
    "v7_avatar_url",
    """SELECT p.id, CASE WHEN a.user_name IS NOT NULL THEN '/static/' || p.author || '.jpg' ELSE '/static/guest.jpg' END AS avatar_url
       FROM fx_posts p LEFT JOIN fx_authors a ON a.user_name = p.author""",
)
def v7(spark, sf):
    return L.with_avatar(fx.fx_posts(spark, sf), fx.fx_authors(spark, sf)).select("id", "avatar_url")


@query(
    "jn8_mime_lookup",
    """SELECT p.page_id, coalesce(m.mime_type, 'application/octet-stream') AS mime FROM pages p
       LEFT JOIN fx_mime m ON m.ext = nullif(lower(regexp_extract(p.url, '^.*\\.([^./\\\\]+)$', 1)), '')""",
)
def jn8(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", mime.mime_type(F.col("url")).alias("mime"))
