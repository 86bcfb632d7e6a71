"""Feed, view and syndication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import feed as FD
from postmill.operators import outbox as OB
from postmill.plans import fixtures as fx
from postmill.plans.listing import SITE
from postmill.plans.media import _CLASS, _FIT, _LOOKUP
from postmill.plans.registry import query
from postmill.plans.sqltext import format_text_sql
from postmill.plans.text import _ESCAPE, _THREADS

CHANNELS = OB.Channels(telegram_channel="news")
_HOST = SITE.hostname

_NESTED = f"""n AS (SELECT p.*, m.url AS m_url, m.old_url AS m_old, m.content_type AS m_type, m.width AS m_w, m.height AS m_h, m.version AS m_v,
    f.url AS f_url, f.old_url AS f_old,
    CASE WHEN m.e IS NULL THEN NULL ELSE {_CLASS.format(f"coalesce(m.content_type, {_LOOKUP.format('m.url')})")} END AS class
  FROM fx_posts p LEFT JOIN fx_media m ON m.post_id = p.id AND m.role = 'media'
  LEFT JOIN fx_media f ON f.post_id = p.id AND f.role = 'media_full')"""

_FEED = f"""{_NESTED},
 u AS (SELECT *, '{_HOST}' || CASE WHEN old_id IS NOT NULL THEN '/post/' || old_id ELSE '/' || id::varchar END AS url,
    {_FIT.format(w='m_w', h='m_h', W=550, H=500, s=1, a='b')}
   FROM n WHERE deleted IS NULL ORDER BY id DESC LIMIT 10),
 v AS (SELECT * EXCLUDE (media_url, full_url, media_type), coalesce(url || '/' || m_old, '{_HOST}/media/' || m_url) AS media_url,
    coalesce(url || '/' || f_old, '{_HOST}/media/' || f_url) AS full_url FROM u),
 i AS (SELECT *, '<img src="' || media_url || '" style="width:' || bw::varchar || 'px;height:' || bh::varchar || 'px" width="' || bw::varchar
    || '" height="' || bh::varchar || '"/>' AS img,
    '<strong>' || author || ': </strong>' || body AS txt FROM v),
 feed AS (SELECT id, author, created, updated, url, media_url, m_type AS media_type, m_url IS NOT NULL AS has_media,
   CASE WHEN m_url IS NULL THEN '' WHEN class = 'video' THEN '<p><video autoplay="autoplay" loop="loop" muted="muted" playsinline="playsinline" controls="controls" style="{FD.FREE_SIZE}"><source'
      || coalesce(' type="' || m_type || '"', '') || ' src="' || media_url || '"/></video></p>'
    WHEN class = 'image' THEN '<p>' || CASE WHEN full_url IS NOT NULL THEN '<a href="' || full_url || '">' || img || '</a>' ELSE img END || '</p>'
    ELSE '<p></p>' END || {format_text_sql('txt')} AS content FROM i)"""

_ENTRY = f"""'  <entry>' || chr(10) || '    <title>' || author || ' posted</title>' || chr(10)
  || '    <link rel="alternate" type="text/html" href="' || url || '"></link>' || chr(10)
  || CASE WHEN has_media THEN '    <link rel="enclosure" type="' || coalesce(media_type, '') || '" href="' || media_url || '"></link>' || chr(10) ELSE '' END
  || '    <id>' || url || '</id>' || chr(10)
  || '    <published>' || strftime(created, '%Y-%m-%dT%H:%M:%SZ') || '</published>' || chr(10)
  || '    <updated>' || strftime(updated, '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || chr(10)
  || '    <author>' || chr(10) || '      <name>' || author || '</name>' || chr(10) || '    </author>' || chr(10)
  || '    <content type="html">' || {_ESCAPE.format('content')} || '</content>' || chr(10) || '  </entry>' || chr(10)"""


def nested(spark, sf):
    return fx.posts_with_crossposts(spark, sf)


@query(
    "v4_feed_rows",
    f"WITH {_FEED} SELECT id, author, url, media_url, media_type, has_media, content FROM feed",
)
def v4(spark, sf):
    return FD.feed_rows(fx.posts(spark, sf), SITE).drop("created", "updated")


@query(
    "v4_a12_s10_feed_document",
    f"""WITH {_FEED} SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10)
      || '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en" xml:base="{_HOST}/">' || chr(10)
      || '  <title>Site</title>' || chr(10) || '  <subtitle></subtitle>' || chr(10) || '  <icon>{_HOST}/static/icon.png</icon>' || chr(10)
      || '  <link type="application/atom+xml" href="{_HOST}/feed.xml" rel="self"></link>' || chr(10)
      || '  <link type="text/html" href="{_HOST}/" rel="alternate"></link>' || chr(10) || '  <id>{_HOST}/</id>' || chr(10)
      || '  <updated>' || (SELECT strftime(max(updated), '%Y-%m-%dT%H:%M:%SZ') FROM feed) || '</updated>' || chr(10)
      || (SELECT string_agg('  <author>' || chr(10) || '    <name>' || user_name || '</name>' || chr(10) || '  </author>' || chr(10), '' ORDER BY ord) FROM fx_authors)
      || (SELECT string_agg({_ENTRY}, '' ORDER BY id DESC) FROM feed) || '</feed>' || chr(10) AS xml""",
)
def v4b(spark, sf):
    now = F.timestamp_seconds(F.lit(1704067200))
    return FD.feed(fx.posts(spark, sf), fx.fx_authors(spark, sf), SITE, now)


@query(
    "v6_post_view",
    f"""WITH {_NESTED}, b AS (SELECT *, {_FIT.format(w='m_w', h='m_h', W=550, H=500, s=1, a='b')},
          '<span class="post_author">' || author || ': </span>' || body AS txt FROM n)
        SELECT b.id, CASE WHEN a.user_name IS NOT NULL THEN '/static/' || author || '.jpg' ELSE '/static/guest.jpg' END AS avatar_url,
          '/media/' || m_url AS src, CASE WHEN m_url IS NOT NULL THEN coalesce('/media/' || f_url, '/media/' || m_url) END AS href,
          class AS media_class, CASE WHEN class = 'video' THEN 'video/mp4' END AS source_type,
          CASE WHEN class = 'image' THEN bw END AS box_w, CASE WHEN class = 'image' THEN round(m_h::double / m_w * 100, 6) END AS aspect,
          {format_text_sql('txt')} AS body_html, strftime(created, '%B %-d, %Y') AS date_text
        FROM b LEFT JOIN fx_authors a ON a.user_name = b.author""",
)
def v6(spark, sf):
    return FD.post_view(fx.posts(spark, sf), fx.fx_authors(spark, sf)).withColumn("aspect", F.round("aspect", 6))


@query(
    "s12_post_json",
    f"""WITH {_NESTED} SELECT id, '{{"post/id":' || id::varchar || ',"post/author":"' || author || '","post/body":' || to_json(body)::varchar
          || ',"post/created":"' || strftime(created, '%Y-%m-%dT%H:%M:%SZ') || '"'
          || CASE WHEN m_url IS NOT NULL THEN ',"post/media":{{"media/url":"' || m_url || '","media/version":' || m_v::varchar || '}}' ELSE '' END || '}}' AS json FROM n""",
)
def s12(spark, sf):
    return FD.post_json(fx.posts(spark, sf))


@query(
    "v9_asset_manifest",
    "SELECT url AS name, url || '?checksum=' || sha1(regexp_replace(html, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS link FROM pages",
)
def v9(spark, sf):
    files = fx.table(spark, sf, "pages").select(F.col("url").alias("name"), F.col("html").alias("content"))
    return FD.asset_manifest(files)


@query(
    "y1_media_to_send",
    f"WITH {_NESTED} SELECT id, CASE WHEN class IS NOT DISTINCT FROM 'video' THEN m_url ELSE coalesce(f_url, m_url) END AS url FROM n",
)
def y1(spark, sf):
    return nested(spark, sf).select("id", OB.media_to_send(F.col("media"), F.col("media_full"))["url"].alias("url"))


@query(
    "y2_handle",
    "SELECT p.id, '@' || coalesce(a.telegram_user, p.author) AS handle FROM fx_posts p LEFT JOIN fx_authors a ON a.user_name = p.author",
)
def y2(spark, sf):
    return OB.with_handle(nested(spark, sf), fx.fx_authors(spark, sf)).select("id", "handle")


_OUT = f"""{_NESTED}, o AS (SELECT n.*, '@' || coalesce(a.telegram_user, n.author) AS handle, class IS NOT DISTINCT FROM 'video' AS video,
    CASE WHEN class IS NOT DISTINCT FROM 'video' THEN m_url ELSE coalesce(f_url, m_url) END AS sent
  FROM n LEFT JOIN fx_authors a ON a.user_name = n.author)"""
_QUOTED = "to_json({0})::varchar"


@query(
    "y3_y5_y7_outbox_new",
    f"""WITH RECURSIVE {_THREADS}, {_OUT}, t AS (
          SELECT id, 0::bigint AS i, body AS txt FROM fx_posts WHERE length(body) < 500
          UNION ALL SELECT id, k - 1, (CASE WHEN k > 1 THEN '... ' ELSE '' END) || piece || (CASE WHEN k < n THEN ' ...' ELSE '' END)
            || ' ' || k::varchar || '/' || n::varchar FROM parts)
        SELECT id AS post_id, 'telegram' AS channel, 1 AS step, CASE WHEN video THEN 'sendVideo' ELSE 'sendPhoto' END AS kind, '@news' AS target,
          CASE WHEN video THEN '{{"video":"' ELSE '{{"photo":"' END || '{_HOST}/media/' || sent || '"}}' AS payload FROM o WHERE sent IS NOT NULL
        UNION ALL SELECT id, 'telegram', 2, 'sendMessage', '@news', '{{"text":' || {_QUOTED.format("handle || ': ' || body")} || ',"disable_web_page_preview":"true"}}' FROM o
        UNION ALL SELECT id, 'mastodon', 1, 'media', NULL, '{{"file":"' || sent || '"}}' FROM o WHERE sent IS NOT NULL
        UNION ALL SELECT t.id, 'mastodon', t.i + 2, 'status', NULL, '{{"status":' || {_QUOTED.format('t.txt')} || ',"visibility":"public","language":"en"'
          || CASE WHEN t.i > 0 THEN ',"in_reply_to_part":' || (t.i - 1)::varchar
                  ELSE ',"media_ids":[' || CASE WHEN t.id % 5 = 2 THEN '"m' || t.id::varchar || '"' ELSE '' END || ']' END || '}}' FROM t""",
)
def y3(spark, sf):
    return OB.outbox_new(nested(spark, sf), fx.fx_authors(spark, sf), CHANNELS)


@query(
    "y4_p9_outbox_edit",
    f"""WITH {_OUT} SELECT c.post_id, 'telegram' AS channel, CASE c.type WHEN 'tg/media' THEN 1 ELSE 2 END AS step,
          CASE c.type WHEN 'tg/media' THEN 'editMessageMedia' ELSE 'editMessageText' END AS kind, '@' || c.channel AS target,
          '{{"message_id":"' || c.message_id || '",' || CASE c.type
            WHEN 'tg/media' THEN '"media":{{"type":"' || CASE WHEN video THEN 'video' ELSE 'photo' END || '","media":"{_HOST}/media/' || sent || '"}}}}'
            ELSE '"text":' || {_QUOTED.format("handle || ': ' || body")} || ',"disable_web_page_preview":"true"}}' END AS payload
        FROM fx_crossposts c JOIN o ON o.id = c.post_id WHERE c.type IN ('tg/media', 'tg/text')""",
)
def y4(spark, sf):
    return OB.outbox_edit(nested(spark, sf), fx.fx_authors(spark, sf), CHANNELS)


@query(
    "a9_first_crosspost",
    "SELECT p.id, c.media_id FROM fx_posts p LEFT JOIN fx_crossposts c ON c.post_id = p.id AND c.type = 'mstd'",
)
def a9(spark, sf):
    return nested(spark, sf).select("id", OB.first_crosspost(F.col("crosspost"), "mstd")["media_id"].alias("media_id"))


@query(
    "u6_merge_mastodon",
    """SELECT p.id, count(c.e) + max(CASE WHEN p.id % 5 = 2 THEN 0 ELSE 1 END) AS records,
         max(CASE WHEN p.id % 2 = 0 THEN 'new' || p.id::varchar WHEN p.id % 5 = 2 THEN 'm' || p.id::varchar END) AS media_id,
         'a,b' AS ids FROM fx_posts p LEFT JOIN fx_crossposts c ON c.post_id = p.id GROUP BY p.id""",
)
def u6(spark, sf):
    media_id = F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("id").cast("string")))
    merged = nested(spark, sf).withColumn("crosspost", OB.merge_mastodon(F.col("crosspost"), media_id, F.array(F.lit("a"), F.lit("b"))))
    first = OB.first_crosspost(F.col("crosspost"), "mstd")
    return merged.select("id", F.size("crosspost").cast("bigint").alias("records"), first["media_id"].alias("media_id"), F.array_join(first["ids"], ",").alias("ids"))


@query(
    "y8_replies_to_crossposts",
    f"""WITH RECURSIVE {_THREADS}, {_OUT}, t AS (SELECT id, 1 AS n FROM fx_posts WHERE length(body) < 500 UNION ALL SELECT id, max(k) FROM parts GROUP BY id)
        SELECT id AS post_id, 'tg/media' AS type, 'news' AS tg_channel, 't' || id::varchar || '_1' AS message_id, NULL AS media_id, NULL AS ids FROM o WHERE sent IS NOT NULL
        UNION ALL SELECT id, 'tg/text', 'news', 't' || id::varchar || '_2', NULL, NULL FROM o
        UNION ALL SELECT o.id, 'mstd', NULL, NULL, CASE WHEN sent IS NOT NULL THEN 'm' || o.id::varchar || '_1' END,
          array_to_string(list_transform(range(2, n + 2), lambda s: 'm' || o.id::varchar || '_' || s::varchar), ',') FROM o JOIN t ON t.id = o.id""",
)
def y8(spark, sf):
    outbox = OB.outbox_new(nested(spark, sf), fx.fx_authors(spark, sf), CHANNELS)
    reply = F.concat(F.substring("channel", 1, 1), F.col("post_id").cast("string"), F.lit("_"), F.col("step").cast("string"))
    replies = outbox.select("post_id", "channel", "step", reply.alias("reply_id"))
    return OB.crossposts_from_replies(outbox, replies).withColumn("ids", F.array_join("ids", ","))


@query(
    "t4_delivery_status",
    """WITH r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY post_id, step ORDER BY seq) AS fails,
           sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY post_id, step ORDER BY seq) AS oks FROM fx_attempts),
         k AS (SELECT * FROM r WHERE (NOT ok AND fails <= 5 AND oks = 0) OR (ok AND oks = 1 AND fails < 5)),
         s AS (SELECT post_id, step, CASE WHEN bool_or(ok) THEN 'done' WHEN max(fails) = 5 THEN 'gave_up' ELSE 'retry' END AS own, count(*) AS attempts
           FROM k GROUP BY post_id, step)
       SELECT a.post_id, a.step, CASE WHEN a.step > 1 AND b.own IS DISTINCT FROM 'done' THEN 'blocked' ELSE a.own END AS status,
         CASE WHEN a.step > 1 AND b.own IS DISTINCT FROM 'done' THEN 0 ELSE a.attempts END AS attempts
       FROM s a LEFT JOIN s b ON b.post_id = a.post_id AND b.step = a.step - 1""",
)
def t4(spark, sf):
    return OB.delivery_status(fx.fx_attempts(spark, sf))


@query(
    "t7_poll_outcome",
    """WITH s AS (SELECT *, min(ts_ms) OVER (PARTITION BY media_id) AS t0 FROM fx_status),
         x AS (SELECT *, CASE WHEN code = 200 THEN 'done' WHEN code = 206 AND ts_ms - t0 < 30000 THEN NULL WHEN code = 206 THEN 'timed_out' ELSE 'failed' END AS ending FROM s)
       SELECT media_id, coalesce(arg_min(ending, (ts_ms, seq)) FILTER (WHERE ending IS NOT NULL), 'waiting') AS outcome,
         min(ts_ms) FILTER (WHERE ending IS NOT NULL) AS ended_ms FROM x GROUP BY media_id""",
)
def t7(spark, sf):
    return OB.poll_outcome(fx.fx_status(spark, sf))


@query(
    "t6_requests_per_day",
    "SELECT date_trunc('day', ts)::date::varchar AS day, count(*) AS requests, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def t6(spark, sf):
    from postmill.streaming.requests import daily_requests

    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_requests(events).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
