"""Post-shaped views over the given tables, in Spark and (for the cross-checks) in DuckDB SQL.

The texts differ only where the dialects do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.mime import MIME_TYPES
from postmill.schema import CROSSPOST

_POSTS = """
SELECT p.id, p.old_id, p.author, p.body, p.created, p.updated, p.deleted,
  CASE WHEN p.has_media THEN concat(cast(year(p.created) AS string), '/', cast(p.id AS string), '.', p.ext) END AS media_url,
  CASE WHEN p.has_media AND p.k <> 4 THEN p.mt END AS media_type,
  CASE WHEN p.has_media THEN 200 + (p.doc_id * 37) % 2000 END AS media_w,
  CASE WHEN p.has_media THEN 150 + (p.doc_id * 53) % 1800 END AS media_h,
  CASE WHEN p.has_media THEN 1 + p.doc_id % 3 END AS media_version,
  CASE WHEN p.doc_id % 6 = 0 THEN concat(cast(year(p.created) AS string), '/', cast(p.id AS string), '_full.', p.ext) END AS full_url
FROM (
  SELECT d.doc_id, d.doc_id + 1 AS id,
    CASE WHEN d.doc_id % 4 = 0 THEN concat('old', cast(d.doc_id AS string)) END AS old_id,
    d.source AS author,
    concat(d.text,
      CASE WHEN d.doc_id % 3 = 0 THEN concat(' @', CASE WHEN d.doc_id % 2 = 0 THEN upper(d.source) ELSE d.source END) ELSE '' END,
      CASE WHEN d.doc_id % 5 = 0 THEN concat(' #', d.lang) ELSE '' END,
      CASE WHEN d.doc_id % 7 = 0 THEN concat(' https://www.example.org/', d.source, '/', cast(d.doc_id AS string), '/#top') ELSE '' END) AS body,
    {created} AS created,
    {updated} AS updated,
    CASE WHEN l.toxic = 1 THEN true END AS deleted,
    d.doc_id % 2 = 0 AS has_media,
    {half} % 5 AS k,
    CASE {half} % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' ELSE 'mp4' END AS ext,
    CASE {half} % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' ELSE 'video/mp4' END AS mt
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
) p
"""
_SECONDS = "1483228800 + 21600 * d.doc_id"
_LATER = f"{_SECONDS} + 86400 * (d.doc_id % 5)"

_FACTS = """
SELECT id AS e, 'post/body' AS a, body AS v, 1 AS tx, 'add' AS op FROM {fx_posts}
UNION ALL SELECT id, 'post/author', author, 1, 'add' FROM {fx_posts}
UNION ALL SELECT id, 'post/body', concat(body, ' (edited)'), 2, 'add' FROM {fx_posts} WHERE id % 10 = 0
UNION ALL SELECT id, 'post/author', author, 3, 'retract' FROM {fx_posts} WHERE id % 15 = 0
"""

_TOKENS = """
SELECT event_id AS seq, concat('u', cast(user_id AS string)) AS handle,
  {seconds} AS ts_s,
  CASE WHEN event_type IN ('signup', 'view') THEN 'issue' ELSE 'redeem' END AS kind
FROM {events}
"""

_ATTEMPTS = """
SELECT event_id AS seq, user_id AS post_id,
  CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 2 END AS step, value >= 100 AS ok
FROM {events}
"""

_LOOKUPS = """
SELECT doc_id * 3 AS post_id, concat('old', cast(doc_id * 2 AS string)) AS old_id FROM {documents}
"""

# media entities: e numbers them after the posts
_MEDIA = """
SELECT 1000000000 + 2 * id AS e, id AS post_id, 'media' AS role, media_url AS url,
  CASE WHEN old_id IS NOT NULL THEN concat('pic', cast(id AS string), '.', split_part(media_url, '.', -1)) END AS old_url,
  media_type AS content_type, media_w AS width, media_h AS height, media_version AS version
FROM {fx_posts} WHERE media_url IS NOT NULL
UNION ALL
SELECT 1000000001 + 2 * id, id, 'media_full', full_url,
  CASE WHEN old_id IS NOT NULL THEN concat('orig', cast(id AS string), '.', split_part(full_url, '.', -1)) END,
  media_type, 2 * media_w, 2 * media_h, media_version
FROM {fx_posts} WHERE full_url IS NOT NULL
"""

_CROSSPOSTS = """
SELECT 2000000000 + 3 * id AS e, id AS post_id, 'tg/media' AS type, concat('chan', cast(id % 2 AS string)) AS channel,
  cast(id * 2 AS string) AS message_id, cast(NULL AS string) AS media_id
FROM {fx_posts} WHERE id % 3 = 1 AND media_url IS NOT NULL
UNION ALL
SELECT 2000000001 + 3 * id, id, 'tg/text', concat('chan', cast(id % 2 AS string)), cast(id * 2 + 1 AS string), cast(NULL AS string)
FROM {fx_posts} WHERE id % 3 = 1
UNION ALL
SELECT 2000000002 + 3 * id, id, 'mstd', cast(NULL AS string), cast(NULL AS string), concat('m', cast(id AS string))
FROM {fx_posts} WHERE id % 5 = 2
"""

# authors: every source but those ending in 7 and 17, some with other names and shared chats
_AUTHORS = """
SELECT {number} AS ord, author AS user_name,
  CASE WHEN {number} % 3 <> 0 THEN concat('tg_', author) END AS telegram_user,
  CASE WHEN {number} % 4 <> 0 THEN concat('chat', cast({number} % 7 AS string)) END AS telegram_chat,
  concat('Author ', author) AS name,
  CASE WHEN {number} % 5 <> 0 THEN concat('https://example.org/', author) END AS url
FROM (SELECT DISTINCT author FROM {fx_posts}) a WHERE {number} % 10 <> 7
"""
_NUMBER = "cast(regexp_replace(author, '[^0-9]', '{all}) AS bigint)"

_EDITS = """
SELECT *, CASE WHEN media_url LIKE 'uploads/%' THEN 'image/png' END AS media_content_type,
  CASE WHEN media_url LIKE 'uploads/%' THEN 300 + (post_id * 7 + seq) % 900 END AS media_width,
  CASE WHEN media_url LIKE 'uploads/%' THEN 200 + (post_id * 11 + seq) % 700 END AS media_height,
  CASE WHEN full_url LIKE 'uploads/%' THEN 'image/png' END AS full_content_type,
  CASE WHEN full_url LIKE 'uploads/%' THEN 1300 + (post_id * 7 + seq) % 900 END AS full_width,
  CASE WHEN full_url LIKE 'uploads/%' THEN 1200 + (post_id * 11 + seq) % 700 END AS full_height
FROM (
  SELECT p.id AS post_id, n.k AS seq, concat(p.body, ' v', cast(n.k AS string)) AS body,
    CASE WHEN p.id % 8 = 7 AND n.k = 2 OR p.id % 8 <> 7 AND (p.id + n.k) % 4 = 0 THEN NULL
         WHEN p.id % 8 <> 7 AND (p.id + n.k) % 4 = 1 THEN p.media_url
         ELSE concat('uploads/', cast(p.id AS string), '_', cast(n.k AS string), '.png') END AS media_url,
    CASE WHEN (p.id + n.k) % 4 = 2 THEN concat('uploads/', cast(p.id AS string), '_', cast(n.k AS string), '_full.png')
         WHEN (p.id + n.k) % 4 = 1 THEN p.full_url END AS full_url
  FROM {fx_posts} p JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n ON n.k <= p.id % 4
) e
"""

_STATUS = """
SELECT event_id AS seq, concat('m', cast({span} AS string)) AS media_id,
  event_id % 97 AS tick, {ms} AS ts_ms,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 206
       WHEN event_type = 'error' AND value > 30 THEN 500 ELSE 200 END AS code
FROM {events}
"""

_LEGACY = """
SELECT concat('leg', cast(doc_id AS string)) AS id, text AS body, source AS author,
  {created} AS created,
  {updated} AS updated,
  CASE WHEN doc_id % 3 >= 1 THEN concat('pic', cast(doc_id AS string), '.png') END AS pic1,
  CASE WHEN doc_id % 3 = 2 THEN concat('pic', cast(doc_id AS string), '_b.png') END AS pic2,
  CASE WHEN doc_id % 4 = 1 THEN concat('orig', cast(doc_id AS string), '.jpeg') END AS orig_url,
  CASE WHEN doc_id % 5 = 1 THEN cast(doc_id * 10 AS string) END AS tg_id,
  CASE WHEN doc_id % 3 >= 1 AND doc_id % 5 < 2 THEN cast(doc_id * 10 + 1 AS string) END AS pic_message,
  CASE WHEN doc_id % 4 = 1 AND doc_id % 5 < 3 THEN concat('ph', cast(doc_id AS string)) END AS orig_photo,
  CASE WHEN doc_id % 7 = 0 THEN cast(doc_id * 10 + 2 AS string) END AS old_repost
FROM {documents} d
"""

# the full fact log of posts, media and crossposts, values as text (times in epoch millis)
_FULL = """
SELECT id AS e, 'post/id' AS a, id::varchar AS v FROM fx_posts
UNION ALL SELECT id, 'post/old-id', old_id FROM fx_posts WHERE old_id IS NOT NULL
UNION ALL SELECT id, 'post/body', body FROM fx_posts
UNION ALL SELECT id, 'post/author', author FROM fx_posts
UNION ALL SELECT id, 'post/created', (epoch_us(created) // 1000)::varchar FROM fx_posts
UNION ALL SELECT id, 'post/updated', (epoch_us(updated) // 1000)::varchar FROM fx_posts
UNION ALL SELECT id, 'post/deleted?', 'true' FROM fx_posts WHERE deleted
UNION ALL SELECT post_id, CASE role WHEN 'media' THEN 'post/media' ELSE 'post/media-full' END, e::varchar FROM fx_media
UNION ALL SELECT e, 'media/url', url FROM fx_media
UNION ALL SELECT e, 'media/old-url', old_url FROM fx_media WHERE old_url IS NOT NULL
UNION ALL SELECT e, 'media/content-type', content_type FROM fx_media WHERE content_type IS NOT NULL
UNION ALL SELECT e, 'media/width', width::varchar FROM fx_media
UNION ALL SELECT e, 'media/height', height::varchar FROM fx_media
UNION ALL SELECT e, 'media/version', version::varchar FROM fx_media
UNION ALL SELECT post_id, 'post/crosspost', e::varchar FROM fx_crossposts
UNION ALL SELECT e, 'crosspost/type', type FROM fx_crossposts
UNION ALL SELECT e, 'crosspost.tg/channel', channel FROM fx_crossposts WHERE channel IS NOT NULL
UNION ALL SELECT e, 'crosspost.tg/message-id', message_id FROM fx_crossposts WHERE message_id IS NOT NULL
UNION ALL SELECT e, 'crosspost.mstd/media-id', media_id FROM fx_crossposts WHERE media_id IS NOT NULL
"""

_DUCK_SECONDS = "make_timestamp(({}) * 1000000)"
_names = {n: n for n in ("fx_posts", "documents", "labels", "events")}
_DUCK_NUMBER = _NUMBER.replace("{all}", "', 'g'")
# equal creation times in threes, so that ties are broken by id
_LEGACY_SECONDS = "1483228800 + 86400 * ((d.doc_id * 7919) % 1000 - ((d.doc_id * 7919) % 1000) % 3)"

ORACLE_VIEWS: dict[str, str] = {
    "fx_posts": _POSTS.format(
        created=_DUCK_SECONDS.format(_SECONDS), updated=_DUCK_SECONDS.format(_LATER), half="(d.doc_id // 2)", **_names
    ),
    "fx_facts": _FACTS.format(**_names),
    "fx_tokens": _TOKENS.format(seconds="1704067200 + (epoch_us(ts) // 1000000 - 1704067200) // 50", **_names),
    "fx_attempts": _ATTEMPTS.format(**_names),
    "fx_lookups": _LOOKUPS.format(**_names),
    "fx_media": _MEDIA.format(**_names),
    "fx_crossposts": _CROSSPOSTS.format(**_names),
    "fx_authors": _AUTHORS.format(number=_DUCK_NUMBER, **_names),
    "fx_edits": _EDITS.format(**_names),
    "fx_status": _STATUS.format(span="event_id // 7", ms="epoch_us(ts) // 1000", **_names),
    "fx_legacy": _LEGACY.format(
        created=_DUCK_SECONDS.format(_LEGACY_SECONDS), updated=_DUCK_SECONDS.format(_LEGACY_SECONDS + " + 3600"), **_names
    ),
    "fx_full": _FULL,
    "fx_mime": "SELECT * FROM (VALUES {}) t(ext, mime_type)".format(
        ", ".join(f"('{ext}', '{mime}')" for ext, mime in MIME_TYPES.items())
    ),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fx_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Flat posts."""
    documents = table(spark, sf, "documents")
    sql = _POSTS.format(
        created=f"timestamp_seconds({_SECONDS})",
        updated=f"timestamp_seconds({_LATER})",
        half="(d.doc_id div 2)",
        documents="{documents}",
        labels="{labels}",
    )
    return spark.sql(sql, documents=documents, labels=table(spark, sf, "labels"))


def fx_facts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_FACTS, fx_posts=fx_posts(spark, sf))


def fx_tokens(spark: SparkSession, sf: str) -> DataFrame:
    seconds = "1704067200 + (unix_seconds(cast(ts AS timestamp)) - 1704067200) div 50"
    return spark.sql(_TOKENS.format(seconds=seconds, events="{events}"), events=table(spark, sf, "events"))


def fx_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_ATTEMPTS, events=table(spark, sf, "events"))


def fx_lookups(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_LOOKUPS, documents=table(spark, sf, "documents"))


def fx_media(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MEDIA, fx_posts=fx_posts(spark, sf))


def fx_crossposts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_CROSSPOSTS, fx_posts=fx_posts(spark, sf))


def fx_authors(spark: SparkSession, sf: str) -> DataFrame:
    number = _NUMBER.replace("{all}", "'")
    return spark.sql(_AUTHORS.format(number=number, fx_posts="{fx_posts}"), fx_posts=fx_posts(spark, sf))


def fx_edits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_EDITS, fx_posts=fx_posts(spark, sf))


def fx_status(spark: SparkSession, sf: str) -> DataFrame:
    sql = _STATUS.format(span="event_id div 7", ms="unix_millis(cast(ts AS timestamp))", events="{events}")
    return spark.sql(sql, events=table(spark, sf, "events"))


def fx_legacy(spark: SparkSession, sf: str) -> DataFrame:
    sql = _LEGACY.format(
        created=f"timestamp_seconds({_LEGACY_SECONDS})",
        updated=f"timestamp_seconds({_LEGACY_SECONDS} + 3600)",
        documents="{documents}",
    )
    return spark.sql(sql, documents=table(spark, sf, "documents"))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """`fx_posts` with the media as nested structs (no crossposts)."""
    flat = fx_posts(spark, sf)

    def media(url: str, prefix: str, factor: int):
        c = F.col(url)
        return F.when(
            c.isNotNull(),
            F.struct(
                c.alias("url"),
                F.when(
                    F.col("old_id").isNotNull(),
                    F.concat(F.lit(prefix), F.col("id").cast("string"), F.lit("."), F.split_part(c, F.lit("."), F.lit(-1))),
                ).alias("old_url"),
                F.col("media_type").alias("content_type"),
                (F.col("media_w") * factor).alias("width"),
                (F.col("media_h") * factor).alias("height"),
                F.col("media_version").alias("version"),
            ),
        )

    return flat.select(
        "id", "old_id", "author", "body", "created", "updated", "deleted",
        media("media_url", "pic", 1).alias("media"),
        media("full_url", "orig", 2).alias("media_full"),
    )


def posts_with_crossposts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with their crossposts as an array, computed row by row like `fx_crossposts`."""
    p = posts(spark, sf)
    i = F.col("id")
    channel = F.concat(F.lit("chan"), (i % 2).cast("string"))
    none = F.lit(None).cast("string")
    ids = F.lit(None).cast("array<string>")
    fields = CROSSPOST.fieldNames()

    def cp(*values):
        return F.struct(*[v.alias(n) for v, n in zip(values, fields)])

    items = F.array(
        F.when((i % 3 == 1) & F.col("media").isNotNull(), cp(F.lit("tg/media"), channel, (i * 2).cast("string"), none, ids)),
        F.when(i % 3 == 1, cp(F.lit("tg/text"), channel, (i * 2 + 1).cast("string"), none, ids)),
        F.when(i % 5 == 2, cp(F.lit("mstd"), none, none, F.concat(F.lit("m"), i.cast("string")), ids)),
    )
    return p.withColumn("crosspost", F.array_compact(items))


def full_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The fact log of all posts, media and crossposts as one stored transaction.

    It is written once per query and read back, because folds, identity lookups and retractions
    each read a few attributes of it, and the stored layout prunes to those.
    """
    from postmill.operators.facts import facts_from_tables
    from postmill.session import new_path
    from postmill.sources.store import Store

    store = Store(spark, new_path(spark, "facts"))
    store.append(facts_from_tables(fx_posts(spark, sf), fx_media(spark, sf), fx_crossposts(spark, sf), tx=1), tx=1)
    return store.facts()
