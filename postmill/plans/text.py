"""Text, date and map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.functions import times as TM
from postmill.functions import xml
from postmill.operators import props
from postmill.operators import threads as TH
from postmill.operators.checks import at_most_one
from postmill.plans import fixtures as fx
from postmill.plans.registry import query
from postmill.plans.sqltext import format_text_sql, strip_tags_sql

_AUTHORED = """'<span class="post_author">' || author || ': </span>' || body"""


def posts(spark, sf):
    return fx.fx_posts(spark, sf)


@query("f1_format_text", f"SELECT id, {format_text_sql(_AUTHORED)} AS html FROM fx_posts")
def f1(spark, sf):
    text = F.concat(F.lit('<span class="post_author">'), F.col("author"), F.lit(": </span>"), F.col("body"))
    return posts(spark, sf).withColumn("text", text).select("id", X.format_text(F.col("text")).alias("html"))


@query("f2_strip_tags", f"SELECT page_id, {strip_tags_sql('html')} AS plain FROM pages")
def f2(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


# DuckDB encodes the star and writes spaces as %20; the rule keeps the star
_ENCODE = """replace(replace(replace(replace(replace(replace(url_encode({0}), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~')"""
_ENCODE_FIX = f"replace({_ENCODE}, '~', '~')"


@query("f3_encode_uri_component", f"SELECT id, {_ENCODE.format('body')} AS encoded FROM fx_posts")
def f3(spark, sf):
    return posts(spark, sf).select("id", X.encode_uri_component(F.col("body")).alias("encoded"))


@query(
    "f4_build_url",
    f"SELECT page_id, '/search?q=' || {_ENCODE.format('url')} || '&page=' || {_ENCODE.format('page_id::varchar')} AS link FROM pages",
)
def f4(spark, sf):
    link = X.build_url("/search", {"q": F.col("url"), "page": F.col("page_id").cast("string")})
    return fx.table(spark, sf, "pages").select("page_id", link.alias("link"))


_ESCAPE = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;')"""


@query("f5_xml_escape", f"SELECT page_id, {_ESCAPE.format('html')} AS escaped FROM pages")
def f5(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", xml.escape(F.col("html")).alias("escaped"))


@query(
    "f6_xml_element",
    f"""SELECT page_id, '<page id="' || page_id::varchar || '">' || chr(10) || '  <url kind="link">' || {_ESCAPE.format('url')} || '</url>' || chr(10)
        || '  <none></none>' || chr(10) || '</page>' || chr(10) AS xml FROM pages""",
)
def f6(spark, sf):
    children = [xml.leaf("url", {"kind": "link"}, F.col("url"), 1), xml.leaf("none", {}, None, 1)]
    return fx.table(spark, sf, "pages").select(
        "page_id", xml.branch("page", {"id": F.col("page_id").cast("string")}, children, 0).alias("xml")
    )


_ALPHABET = f"'{X.ALPHABET}'"
_CODE = " || ".join(f"substr({_ALPHABET}, ((event_id * 7919 // {64**i}) % 64 + 1)::int, 1)" for i in (4, 3, 2, 1, 0))


@query("f7_encode_number", f"SELECT event_id, {_CODE} AS code FROM events")
def f7(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", X.encode_number(F.col("event_id") * 7919, 5).alias("code"))


@query(
    "f8_first_mention",
    "SELECT id, nullif(regexp_extract(body, '(?:^|[> ])@([A-Za-z0-9_]+)', 1), '') AS who FROM fx_posts",
)
def f8(spark, sf):
    return posts(spark, sf).select("id", X.first_mention(F.col("body")).alias("who"))


@query(
    "f9_file_extension",
    "SELECT page_id, nullif(regexp_extract(url, '(?s)^.*\\.([^.]+)$', 1), '') AS ext FROM pages",
)
def f9(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.file_extension(F.col("url")).alias("ext"))


@query("f10_p14_clean_query", "SELECT page_id, regexp_replace(url, '[!*?]', '', 'g') AS q FROM pages WHERE trim(regexp_replace(url, '[!*?]', '', 'g')) <> ''")
def f10(spark, sf):
    q = X.clean_query(F.col("url"))
    return fx.table(spark, sf, "pages").select("page_id", q.alias("q")).where(F.trim("q") != "")


@query("f11_clean_handle", "SELECT conv_id, turn, lower(trim(text, ' ')) AS handle FROM conversations")
def f11(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", X.clean_handle(F.col("text")).alias("handle"))


@query("f13_sha1", "SELECT id, sha1(body) AS digest FROM fx_posts")
def f13(spark, sf):
    return posts(spark, sf).select("id", F.sha1(F.col("body")).alias("digest"))


@query(
    "p12_publishable",
    "SELECT conv_id, turn, NOT regexp_full_match(body, '[\\s\\x0B\\x{A0}\\x{3000}]*') AS publishable FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN chr(160) || chr(10) || ' ' ELSE text END AS body FROM conversations)",
)
def p12(spark, sf):
    body = F.when(F.col("turn") % 3 == 0, " \n ").otherwise(F.col("text"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", X.is_publishable(body).alias("publishable"))


@query(
    "d1_d10_dates",
    """SELECT event_id, strftime(t, '%B %-d, %Y') AS d1_date, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS d2_iso,
         strftime(t, '%Y-%m-%dT%H:%M:%S.%g-00:00') AS d3_reader, strftime(t, '%Y-%m-%d %H:%M:%S.%g') AS d3_log,
         strftime(t, '%y%m%d%H%M%S%g') AS d4_stamp, strftime(t, '%H:%M') AS d5_pattern,
         date_trunc('second', t) AS d6_parsed, date_trunc('millisecond', t) AS d7_millis,
         epoch_us(date_trunc('millisecond', t)) // 1000 - 1704067200000 AS d8_since_ms, year(t) AS d9_year,
         epoch_us(t) // 1000000 AS d10_seconds, epoch_us(t) // 1000 AS d10_millis,
         make_timestamp((epoch_us(t) // 1000) * 1000) AS d10_back
       FROM (SELECT event_id, ts AS t FROM events)""",
)
def dates(spark, sf):
    t = F.col("ts").cast("timestamp")
    start = F.timestamp_seconds(F.lit(1704067200))
    ntz = "timestamp_ntz"
    return fx.table(spark, sf, "events").select(
        "event_id",
        F.date_format(t, TM.DATE).alias("d1_date"),
        F.date_format(t, TM.ISO).alias("d2_iso"),
        F.date_format(t, TM.READER).alias("d3_reader"),
        F.date_format(t, TM.LOG).alias("d3_log"),
        F.date_format(t, TM.STAMP).alias("d4_stamp"),
        F.date_format(t, "HH:mm").alias("d5_pattern"),
        F.to_timestamp(F.date_format(t, TM.ISO)).cast(ntz).alias("d6_parsed"),
        TM.millis(t).cast(ntz).alias("d7_millis"),
        TM.since_ms(start, TM.millis(t)).alias("d8_since_ms"),
        F.year(t).alias("d9_year"),
        F.unix_seconds(t).alias("d10_seconds"),
        F.unix_millis(t).alias("d10_millis"),
        F.timestamp_millis(F.unix_millis(t)).cast(ntz).alias("d10_back"),
    )


@query(
    "c1_c11_normalise_props",
    """WITH p AS (SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events),
       m AS (SELECT event_id, CASE WHEN k > 10 THEN 'k=' || (k + 1)::varchar END AS a, 'extra=20' AS b, 'fixed=77' AS c FROM p)
       SELECT event_id, a IS NOT NULL AS has_k, true AS has_extra,
         concat_ws(',', b, c, a) AS pairs, concat_ws(',', 'extra=77', replace(a, 'k=', 'fixed=')) AS zipped FROM m""",
)
def c1(spark, sf):
    events = fx.table(spark, sf, "events")
    return props.normalise_props(events, drop_keys="x.*", defaults={"extra": 20, "low": 1}, overrides={"fixed": 77})


@query(
    "a13_at_most_one",
    "SELECT id, max(author) AS author FROM fx_posts GROUP BY id HAVING count(*) = 1",
)
def a13(spark, sf):
    return at_most_one(posts(spark, sf), "id", "author")


# the same cutting rule, one step per recursion
_THREADS = """
steps AS (
  SELECT id, 0 AS k, '' AS piece, body AS rest, false AS last FROM fx_posts WHERE length(body) >= 500
  UNION ALL
  SELECT id, k + 1,
    CASE WHEN fin THEN rest WHEN cut > 0 THEN left(rest, cut::int) ELSE left(rest, pos::int) END,
    CASE WHEN fin THEN '' WHEN cut > 0 THEN regexp_replace(substr(rest, cut + 1), '^[\\s\\x0B]+', '') ELSE substr(rest, pos + 1) END,
    fin
  FROM (
    SELECT *, greatest(
        CASE WHEN contains(h, ' ') THEN length(h) - instr(reverse(h), ' ') ELSE -1 END,
        CASE WHEN contains(h, chr(10)) THEN length(h) - instr(reverse(h), chr(10)) ELSE -1 END) AS cut
    FROM (
      SELECT *, left(rest, (pos + 1)::int) AS h FROM (
        SELECT *, length(rest) < 480 AS fin, CASE WHEN length(rest) < 960 THEN length(rest) // 2 ELSE 480 END AS pos
        FROM steps WHERE NOT last) x) y) z
),
parts AS (SELECT id, k, piece, max(k) OVER (PARTITION BY id) AS n FROM steps WHERE k > 0)
"""


@query(
    "y6_w3_thread_split",
    f"""WITH RECURSIVE {_THREADS}
        SELECT id, 0::bigint AS part, body AS text FROM fx_posts WHERE length(body) < 500
        UNION ALL
        SELECT id, k - 1, (CASE WHEN k > 1 THEN '... ' ELSE '' END) || piece || (CASE WHEN k < n THEN ' ...' ELSE '' END)
          || ' ' || k::varchar || '/' || n::varchar FROM parts""",
)
def y6(spark, sf):
    return TH.thread_rows(posts(spark, sf))


@query(
    "w2_reply_chain",
    """SELECT conv_id, turn, conv_id * 1000 + turn AS reply_id,
         lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS in_reply_to FROM conversations""",
)
def w2(spark, sf):
    replies = fx.table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"))
    return TH.reply_chain(replies, "conv_id", "turn", "reply_id")
