"""Media planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import media as M
from postmill.functions import mime
from postmill.plans import fixtures as fx
from postmill.plans.registry import query


def media(spark, sf):
    return fx.fx_media(spark, sf)


_LOOKUP = "coalesce((SELECT mime_type FROM fx_mime WHERE ext = lower(regexp_extract({0}, '^.*\\.([^./\\\\]+)$', 1))), 'application/octet-stream')"
_CLASS = """CASE WHEN {0} LIKE 'video/%' THEN 'video' WHEN {0} LIKE 'image/%' THEN 'image' END"""
_FIT = """CASE WHEN {w} > {W} AND {h} * {W} > {H} * {w} THEN ({H} * {w}) // ({h} * {s}) * {s}
  WHEN {w} > {W} THEN {W} WHEN {h} > {H} THEN ({w} * {H}) // ({h} * {s}) * {s} ELSE {w} // {s} * {s} END AS {a}w,
  CASE WHEN {w} > {W} AND {h} * {W} > {H} * {w} THEN {H} WHEN {w} > {W} THEN ({h} * {W}) // ({w} * {s}) * {s}
  WHEN {h} > {H} THEN {H} ELSE {h} // {s} * {s} END AS {a}h"""


@query(
    "m1_extension_for_type",
    f"""WITH t AS (SELECT content_type AS mime_type FROM fx_media WHERE content_type IS NOT NULL UNION SELECT 'image/' || lang FROM documents
         UNION SELECT {_LOOKUP.format('url')} FROM pages)
       SELECT mime_type, coalesce((SELECT ext FROM fx_mime m WHERE m.ext = split_part(t.mime_type, '/', 2)),
         (SELECT min(ext) FROM fx_mime m WHERE m.mime_type = t.mime_type), split_part(t.mime_type, '/', 2)) AS ext FROM t""",
)
def m1(spark, sf):
    declared = media(spark, sf).where(F.col("content_type").isNotNull()).select(F.col("content_type").alias("mime_type"))
    invented = fx.table(spark, sf, "documents").select(F.concat(F.lit("image/"), F.col("lang")).alias("mime_type"))
    guessed = fx.table(spark, sf, "pages").select(mime.mime_type(F.col("url")).alias("mime_type"))
    types = declared.unionByName(invented).unionByName(guessed).distinct()
    return types.select("mime_type", mime.extension_for(F.col("mime_type")).alias("ext"))


@query("m2_type_of_name", f"SELECT e, url, {_LOOKUP.format('url')} AS mime FROM fx_media")
def m2(spark, sf):
    return media(spark, sf).select("e", "url", mime.mime_type(F.col("url")).alias("mime"))


@query(
    "m3_p11_media_class",
    f"SELECT e, {_CLASS.format('mt')} AS class FROM (SELECT e, coalesce(content_type, {_LOOKUP.format('url')}) AS mt FROM fx_media)",
)
def m3(spark, sf):
    return media(spark, sf).select("e", mime.media_class(F.col("content_type"), F.col("url")).alias("class"))


@query("m4_fit_shown_box", f"SELECT e, {_FIT.format(w='width', h='height', W=550, H=500, s=1, a='')} FROM fx_media")
def m4(spark, sf):
    return media(spark, sf).withColumn("box", M.fit(F.col("width"), F.col("height"))).select("e", "box.w", "box.h")


@query("m5_video_size", f"SELECT e, {_FIT.format(w='width', h='height', W=1100, H=1000, s=2, a='')} FROM fx_media")
def m5(spark, sf):
    return media(spark, sf).withColumn("box", M.video_size(F.col("width"), F.col("height"))).select("e", "box.w", "box.h")


_UPLOADS = """(SELECT e, width AS w, height AS h, coalesce(content_type, 'video/mp4') AS mime,
   e::varchar || '_full.' || split_part(url, '.', -1) AS name, (width > 1100 OR height > 1000) AS large FROM fx_media)"""


@query(
    "m6_conversion_plan",
    f"""SELECT e, CASE WHEN v THEN 'transcode' WHEN keep THEN 'keep' WHEN large THEN 'resize' ELSE 'convert' END AS action,
          CASE WHEN v THEN replace(name, '_full.mp4', '.mp4') WHEN keep THEN replace(name, '_full.', '.')
               ELSE e::varchar || '.jpeg' END AS target_name,
          CASE WHEN v THEN 'video/mp4' WHEN keep THEN mime ELSE 'image/jpeg' END AS target_type,
          CASE WHEN v THEN vw WHEN keep THEN w ELSE fw END AS w, CASE WHEN v THEN vh WHEN keep THEN h ELSE fh END AS h,
          NOT keep OR v AS has_full
        FROM (SELECT *, mime LIKE 'video/%' AS v, mime = 'image/gif' OR (mime = 'image/jpeg' AND NOT large) AS keep,
          {_FIT.format(w='w', h='h', W=1100, H=1000, s=2, a='v')}, {_FIT.format(w='w', h='h', W=1100, H=1000, s=1, a='f')}
          FROM {_UPLOADS})""",
)
def m6(spark, sf):
    name = F.concat(F.col("e").cast("string"), F.lit("_full."), F.split_part("url", F.lit("."), F.lit(-1)))
    kind = F.coalesce("content_type", F.lit("video/mp4"))
    plan = M.conversion_plan(name, kind, F.col("width"), F.col("height"))
    return media(spark, sf).select("e", plan.alias("plan")).select("e", "plan.*")


@query(
    "m7_published_path",
    """SELECT e, '2024/' || post_id::varchar || CASE WHEN version > 1 THEN 'v' || version::varchar ELSE '' END
         || CASE WHEN role = 'media_full' THEN '_full.' ELSE '.' END || split_part(url, '.', -1) AS path FROM fx_media""",
)
def m7(spark, sf):
    ext = F.split_part("url", F.lit("."), F.lit(-1))
    args = (F.lit(2024), F.col("post_id"), F.col("version"))
    path = F.when(F.col("role") == "media_full", M.published_path(*args, True, ext)).otherwise(M.published_path(*args, False, ext))
    return media(spark, sf).select("e", path.alias("path"))


@query(
    "m8_upload_name",
    """SELECT id, (id + 1)::varchar || '_' || strftime(updated, '%y%m%d%H%M%S%g') || '_full.' || CASE media_type
         WHEN 'image/jpeg' THEN 'jpeg' WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' ELSE 'mp4' END AS name
       FROM fx_posts WHERE media_type IS NOT NULL""",
)
def m8(spark, sf):
    posts = fx.fx_posts(spark, sf).where(F.col("media_type").isNotNull())
    return posts.select("id", M.upload_name(F.col("id") + 1, F.col("updated"), F.col("media_type")).alias("name"))


@query(
    "m9_legacy_path",
    """SELECT e, '2019/' || post_id::varchar || '_1' || CASE WHEN role = 'media_full' THEN '_full' ELSE '' END || '.' || split_part(url, '.', -1) AS path FROM fx_media""",
)
def m9(spark, sf):
    year = F.lit("2019")
    i = F.col("post_id").cast("string")
    path = F.when(F.col("role") == "media_full", M.legacy_path(year, i, True, F.col("url"))).otherwise(M.legacy_path(year, i, False, F.col("url")))
    return media(spark, sf).select("e", path.alias("path"))


@query("m10_aspect_percent", "SELECT e, round(height::double / width * 100, 6) AS aspect FROM fx_media")
def m10(spark, sf):
    return media(spark, sf).select("e", F.round(M.aspect_percent(F.col("width"), F.col("height")), 6).alias("aspect"))


@query(
    "m11_parse_probe",
    "SELECT e, width, height, CASE WHEN e % 3 = 0 THEN NULL ELSE version END AS frames FROM fx_media",
)
def m11(spark, sf):
    frames = F.when(F.col("e") % 3 == 0, "N/A").otherwise(F.col("version").cast("string"))
    out = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"), frames)
    return media(spark, sf).select("e", M.parse_probe(out).alias("probe")).select("e", "probe.*")


@query(
    "p10_fresh_uploads",
    "SELECT post_id, seq, media_url FROM fx_edits WHERE media_url LIKE 'uploads/%'",
)
def p10(spark, sf):
    return fx.fx_edits(spark, sf).where(M.is_upload(F.col("media_url"))).select("post_id", "seq", "media_url")


@query("p13_first_versions", "SELECT e, url FROM fx_media WHERE version = 1")
def p13(spark, sf):
    return media(spark, sf).where(F.col("version") == 1).select("e", "url")


@query(
    "w4_next_version",
    "SELECT id, coalesce(media_version, 0) + 1 AS version FROM fx_posts",
)
def w4(spark, sf):
    return fx.fx_posts(spark, sf).select("id", (F.coalesce("media_version", F.lit(0)) + 1).alias("version"))
