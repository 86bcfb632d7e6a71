"""Migration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import facts as FX
from postmill.operators import migrate as MG
from postmill.operators.ordering import numbered
from postmill.plans import fixtures as fx
from postmill.plans.registry import query
from postmill.session import new_path

CHANNEL = "news"


def legacy(spark, sf):
    """Legacy posts as nested rows, as they stand before the first migration."""
    f = fx.fx_legacy(spark, sf)
    none = F.lit(None)

    def picture(url, message, photo):
        return F.when(
            url.isNotNull(),
            F.struct(
                url.alias("url"), none.cast("string").alias("content_type"),
                F.array(F.length(url).cast("bigint"), F.lit(7).cast("bigint")).alias("dimensions"),
                F.when(message.isNotNull() | photo.isNotNull(), F.struct(message.alias("message_id"), photo.alias("photo"))).alias("telegram"),
            ),
        )

    c = F.col
    text = none.cast("string")
    old = F.struct(F.lit("telegram/text").alias("type"), F.lit("old").alias("channel"), c("old_repost").alias("message_id"), text.alias("photo"))
    return f.select(
        "id", "body", "author", "created", "updated",
        F.array_compact(F.array("pic1", "pic2")).alias("pictures"),
        picture(c("pic1"), c("pic_message"), text).alias("picture"),
        picture(c("orig_url"), text, c("orig_photo")).alias("picture_original"),
        c("tg_id").alias("telegram_message_id"),
        F.when(c("old_repost").isNotNull(), F.array(old)).alias("reposts"),
    )


@query(
    "g1_first_picture",
    "SELECT id, coalesce(pic1, pic2) AS url FROM fx_legacy",
)
def g1(spark, sf):
    v1 = legacy(spark, sf).drop("picture", "picture_original", "telegram_message_id", "reposts")
    return MG.to_2(v1).select("id", F.col("picture.url").alias("url"))


@query(
    "g2_bad_rows_kept",
    """SELECT id, CASE WHEN length(id) % 2 = 0 THEN pic1 END AS url, CASE WHEN length(id) % 2 = 1 THEN 'bad pictures' END AS error FROM fx_legacy""",
)
def g2(spark, sf):
    v1 = legacy(spark, sf).select("id", F.to_json("pictures").alias("raw"))
    broken = v1.withColumn("raw", F.when(F.length("id") % 2 == 1, "[not json").otherwise(F.col("raw")))
    parsed = broken.withColumn("pictures", F.from_json("raw", "array<string>"))
    good, bad = MG.split_failures(parsed, F.when(F.col("pictures").isNull(), "bad pictures"), MG.to_2)
    none = F.lit(None).cast("string")
    return good.select("id", F.col("picture.url").alias("url"), none.alias("error")).unionByName(bad.select("id", none.alias("url"), "error"))


_REPOSTS = """concat_ws(';', CASE WHEN old_repost IS NOT NULL THEN 'telegram/text:old:' || old_repost END,
   CASE WHEN tg_id IS NOT NULL THEN 'telegram/text:news:' || tg_id END,
   CASE WHEN orig_photo IS NOT NULL THEN 'telegram/photo:news:' || orig_photo END,
   CASE WHEN pic_message IS NOT NULL THEN 'telegram/photo:news:' || pic_message END)"""


@query("g3_reposts", f"SELECT id, {_REPOSTS} AS reposts FROM fx_legacy")
def g3(spark, sf):
    v3 = MG.to_3(legacy(spark, sf), CHANNEL)
    text = F.transform("reposts", lambda r: F.concat_ws(":", r["type"], r["channel"], r["message_id"], r["photo"]))
    return v3.select("id", F.array_join(text, ";").alias("reposts"))


_G4 = f"""SELECT row_number() OVER (ORDER BY created, id) AS id, id AS old_id, author, body, created, updated,
   year(created)::varchar AS y, pic1, orig_url, replace(replace(replace({_REPOSTS}, 'telegram/photo', 'tg/media'), 'telegram/text', 'tg/text'), ':ph', ':') AS reposts,
   length(pic1) AS w FROM fx_legacy"""


@query(
    "g4_current_shape",
    f"""SELECT id, old_id, author, body, created, updated, CASE WHEN pic1 IS NOT NULL THEN y || '/' || id::varchar || '_1.png' END AS media_url, pic1 AS media_old,
          CASE WHEN orig_url IS NOT NULL THEN y || '/' || id::varchar || '_1_full.jpeg' END AS full_url, orig_url AS full_old, w AS media_w,
          len(string_split(nullif(reposts, ''), ';')) AS crossposts FROM ({_G4})""",
)
def g4(spark, sf):
    v4 = MG.to_4(MG.to_3(legacy(spark, sf).drop("pictures"), CHANNEL))
    return v4.select(
        "id", "old_id", "author", "body", F.col("created").cast("timestamp_ntz").alias("created"), F.col("updated").cast("timestamp_ntz").alias("updated"),
        F.col("media.url").alias("media_url"), F.col("media.old_url").alias("media_old"), F.col("media_full.url").alias("full_url"),
        F.col("media_full.old_url").alias("full_old"), F.col("media.width").alias("media_w"),
        F.nullif(F.size("crosspost"), F.lit(0)).cast("bigint").alias("crossposts"),
    )


# a photo known by its own id has no message id, so nothing stands behind its channel
_CROSSPOSTS = """concat_ws(';', CASE WHEN old_repost IS NOT NULL THEN 'tg/text:old:' || old_repost END,
   CASE WHEN tg_id IS NOT NULL THEN 'tg/text:news:' || tg_id END, CASE WHEN orig_photo IS NOT NULL THEN 'tg/media:news' END,
   CASE WHEN pic_message IS NOT NULL THEN 'tg/media:news:' || pic_message END)"""


@query(
    "g4_crosspost_types",
    f"SELECT old_id, unnest(string_split(reposts, ';')) AS crosspost FROM (SELECT id AS old_id, {_CROSSPOSTS} AS reposts FROM fx_legacy) WHERE reposts <> ''",
)
def g4b(spark, sf):
    each = MG.to_4(MG.to_3(legacy(spark, sf), CHANNEL)).select("old_id", F.explode_outer("crosspost").alias("c")).where(F.col("c").isNotNull())
    return each.select("old_id", F.concat_ws(":", "c.type", "c.channel", "c.message_id").alias("crosspost"))


@query("w1_ids_in_created_order", "SELECT row_number() OVER (ORDER BY created, id) AS post_id, id FROM fx_legacy")
def w1(spark, sf):
    return numbered(fx.fx_legacy(spark, sf).select("created", "id"), ["created", "id"], "post_id").select("post_id", "id")


@query(
    "s15_copy_manifest",
    f"""WITH p AS ({_G4}) SELECT old_id || '/' || pic1 AS "from", y || '/' || id::varchar || '_1.png' AS "to" FROM p WHERE pic1 IS NOT NULL
        UNION ALL SELECT old_id || '/' || orig_url, y || '/' || id::varchar || '_1_full.jpeg' FROM p WHERE orig_url IS NOT NULL""",
)
def s15(spark, sf):
    return MG.copy_manifest(MG.to_4(MG.to_3(legacy(spark, sf).drop("pictures"), CHANNEL)))


_MEDIA_4 = """SELECT page_id AS e, '20' || (10 + page_id % 10)::varchar || '/' || page_id::varchar || '_1' || CASE WHEN page_id % 4 = 0 THEN '_full' ELSE '' END || '.png' AS url,
   1 + page_id % 2 AS version FROM pages"""


def media_4(spark, sf):
    i = F.col("page_id")
    url = F.concat(
        F.lit("20"), (10 + i % 10).cast("string"), F.lit("/"), i.cast("string"), F.lit("_1"), F.when(i % 4 == 0, "_full").otherwise(""), F.lit(".png")
    )
    rows = fx.table(spark, sf, "pages").select(i.alias("e"), url.alias("url"), (1 + i % 2).alias("version"))
    return FX.fact_rows(rows, "e", {"media/url": F.col("url"), "media/version": F.col("version")}, 1)


@query(
    "g5_unversioned_names",
    f"SELECT e, CASE WHEN version = 1 THEN replace(url, '_1', '') ELSE url END AS url FROM ({_MEDIA_4})",
)
def g5(spark, sf):
    facts = media_4(spark, sf)
    changes, _ = MG.to_5(facts, tx=2)
    return FX.pull(facts.unionByName(changes), {"url": "media/url"})


@query("g5_move_manifest", f"""SELECT url AS "from", replace(url, '_1', '') AS "to" FROM ({_MEDIA_4}) WHERE version = 1""")
def g5b(spark, sf):
    return MG.to_5(media_4(spark, sf), tx=2)[1]


@query(
    "g6_p15_gated_chain",
    f"""SELECT id, {_REPOSTS} AS reposts, 3::bigint AS version FROM fx_legacy""",
)
def g6(spark, sf):
    # the table is at version 2 already, so the first step is skipped
    meta = spark.range(1).select(F.lit(2).cast("bigint").alias("version"))
    version = MG.schema_version(meta).first()["version"]
    v2 = legacy(spark, sf).drop("pictures")
    steps = [(2, lambda df: df.withColumn("body", F.raise_error(F.lit("ran twice")))), (3, lambda df: MG.to_3(df, CHANNEL))]
    out, version = MG.migrate(v2, version, steps)
    text = F.transform("reposts", lambda r: F.concat_ws(":", r["type"], r["channel"], r["message_id"], r["photo"]))
    return out.select("id", F.array_join(text, ";").alias("reposts"), F.lit(version).cast("bigint").alias("version"))


def chain():
    """All steps from the first version to the last: legacy posts, then posts in the current shape as facts, then renamed media."""

    def to_5(facts):
        changes, _ = MG.to_5(facts, tx=2)
        return facts.unionByName(changes)

    return [(2, MG.to_2), (3, lambda posts: MG.to_3(posts, CHANNEL)), (4, lambda posts: MG.stored_facts(MG.to_4(posts), tx=1)), (5, to_5)]


@query(
    "g6_full_chain",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY created, id) AS id, id AS old_id, body, year(created)::varchar AS y, pic1, orig_url,
          concat_ws(';', CASE WHEN old_repost IS NOT NULL THEN 'tg/text:' || old_repost END, CASE WHEN tg_id IS NOT NULL THEN 'tg/text:' || tg_id END,
            CASE WHEN orig_photo IS NOT NULL THEN 'tg/media' END) AS crossposts FROM fx_legacy)
        SELECT id, old_id, body, CASE WHEN pic1 IS NOT NULL THEN y || '/' || id::varchar || '.png' END AS media_url, pic1 AS media_old,
          CASE WHEN orig_url IS NOT NULL THEN y || '/' || id::varchar || '_full.jpeg' END AS full_url, crossposts, 5::bigint AS version, 0::bigint AS again FROM p""",
)
def g6b(spark, sf):
    """Versions 1 to 5 as a stored chain; the second run has nothing to do."""
    journal = MG.Journal(spark, new_path(spark, "migrations"))
    journal.keep(legacy(spark, sf), 1)
    journal.run(chain())
    again = len(journal.run([(v, None) for v, _ in chain()]))
    text = F.transform("crosspost", lambda c: F.concat_ws(":", c["type"], c["message_id"]))
    return FX.snapshot(journal.table()).select(
        "id", "old_id", "body", F.col("media.url").alias("media_url"), F.col("media.old_url").alias("media_old"), F.col("media_full.url").alias("full_url"),
        F.coalesce(F.array_join(text, ";"), F.lit("")).alias("crossposts"), F.lit(journal.version()).cast("bigint").alias("version"), F.lit(again).cast("bigint").alias("again"),
    )
