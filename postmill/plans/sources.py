"""Source and sink queries: each writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import listing as L
from postmill.operators import feed as FD
from postmill.operators import search as S
from postmill.plans import fixtures as fx
from postmill.plans import feed as _feed  # noqa: F401  registers the document whose file is compared here
from postmill.plans.listing import SITE, _SITEMAP_SQL
from postmill.plans.migrate import legacy
from postmill.plans.registry import ORACLE, query
from postmill.plans.search import _INDEX, _words_sql
from postmill.session import dropping, new_path
from postmill.sources import files as SF
from postmill.sources.store import Store, next_snapshot, restore_or_create
from postmill.streaming.requests import daily_requests


@query("s4_s5_snapshot_round_trip", "SELECT id, old_id, author, body, media_url FROM fx_posts")
def s5(spark, sf):
    root = new_path(spark, "posts")
    path = next_snapshot(fx.posts(spark, sf), root, 1)
    return restore_or_create(spark, path).select("id", "old_id", "author", "body", F.col("media.url").alias("media_url"))


@query(
    "s6_append_transaction",
    """SELECT e, max_by(v, tx) FILTER (WHERE a = 'post/body') AS body, CASE WHEN max_by(op, tx) FILTER (WHERE a = 'post/author') = 'add'
         THEN max_by(v, tx) FILTER (WHERE a = 'post/author') END AS author FROM fx_facts GROUP BY e""",
)
def s6(spark, sf):
    from postmill.operators import facts as FX
    from postmill.plans.facts import simple_facts

    store = Store(spark, new_path(spark, "store"))
    facts = simple_facts(spark, sf)
    for tx in (1, 2, 3, 3):  # the last one is a replay
        store.append(facts.where(F.col("tx") == tx), tx)
    return FX.pull(store.facts(), {"body": "post/body", "author": "post/author"})


@query("s7_legacy_scan", "SELECT id, author, pic1, created FROM fx_legacy ORDER BY created, id")
def s7(spark, sf):
    root = new_path(spark, "legacy")
    rows = legacy(spark, sf)
    rows.withColumn("dir", F.col("author")).write.partitionBy("dir").json(root)
    back = SF.legacy_posts(spark, root, "*.json").orderBy("created", "id")
    return back.select("id", "author", F.col("picture.url").alias("pic1"), F.col("created").cast("timestamp_ntz").alias("created"))


@query("s10_feed_file", f"SELECT unnest(string_split(xml, chr(10))) AS value FROM ({ORACLE['v4_a12_s10_feed_document']})")
def s10(spark, sf):
    """Every line of the written file."""
    path = new_path(spark, "feed")
    feed = FD.feed(fx.posts(spark, sf), fx.fx_authors(spark, sf), SITE, F.timestamp_seconds(F.lit(1704067200)))
    SF.write_document(feed, "xml", path)
    return spark.read.text(path)


@query(
    "s11_sitemap_file",
    f"""SELECT unnest(['  <url>', '    <loc>' || loc || '</loc>', '  </url>']) AS value FROM ({_SITEMAP_SQL})
        UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', '</urlset>'])""",
)
def s11(spark, sf):
    """Every line of the written files."""
    path = new_path(spark, "sitemap")
    lines = FD.sitemap_lines(L.sitemap(fx.fx_posts(spark, sf), SITE))
    SF.write_lines(lines, ["section", "ord"], path)
    return spark.read.text(path)


@query(
    "s13_edit_requests",
    """SELECT post_id, seq, body, media_url, media_content_type, media_width, media_height, full_url, full_content_type, full_width, full_height
       FROM fx_edits WHERE post_id % 11 <> 0""",
)
def s13(spark, sf):
    """Every eleventh post's requests are cut off in the middle, and so are left out."""
    edits = fx.fx_edits(spark, sf)

    def media(role: str):
        names = {"url": "url", "content-type": "content_type", "width": "width", "height": "height"}
        return F.when(F.col(f"{role}_url").isNotNull(), F.struct(*[F.col(f"{role}_{c}").alias(f"media/{a}") for a, c in names.items()]))

    json = F.to_json(F.struct(F.col("body").alias("post/body"), media("media").alias("post/media"), media("full").alias("post/media-full")))
    cut = F.when(F.col("post_id") % 11 == 0, F.expr("left(json, length(json) div 2)")).otherwise(F.col("json"))
    sent = edits.select("post_id", "seq", json.alias("json")).withColumn("json", cut)
    return SF.good_edits(SF.parse_edits(sent)).drop("author")


@query(
    "s14_request_log",
    "SELECT date_trunc('day', ts)::date::varchar AS day, count(*) AS requests, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def s14(spark, sf):
    path = new_path(spark, "requests")
    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    SF.append_requests(events.select("ts", "user_id", "event_type"), path)
    return daily_requests(spark.read.parquet(path)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "s9_stored_index_search",
    f"WITH {_INDEX}, {_words_sql(['der', 'und'])} SELECT id, round(score, 6) AS score FROM scored WHERE found = 2",
)
def s9(spark, sf):
    path = new_path(spark, "index")
    with dropping(spark):
        S.write_index(S.build_index_once(fx.fx_posts(spark, sf)), path)
    found = S.matches(S.read_index(spark, path), must=S.words_clause("der und"))
    return found.withColumn("score", F.round("score", 6))


@query(
    "v8_derived_until_changed",
    """SELECT lower(who) AS handle, max_by(who, id) AS who FROM (
         SELECT id, nullif(regexp_extract(body, '(?:^|[> ])@([A-Za-z0-9_]+)', 1), '') AS who FROM fx_posts) WHERE who IS NOT NULL GROUP BY 1""",
)
def v8(spark, sf):
    from postmill.operators.facts import facts_from_tables

    store = Store(spark, new_path(spark, "store"))
    store.append(facts_from_tables(fx.fx_posts(spark, sf), fx.fx_media(spark, sf), fx.fx_crossposts(spark, sf), tx=1), tx=1)
    store.write_snapshot()
    for _ in range(2):  # the second call reads what the first one stored
        out = store.derived("contributors", lambda posts: L.contributors(posts, []))
    return out
