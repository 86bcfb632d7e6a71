"""Fact log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import facts as FX
from postmill.operators import publish as PB
from postmill.plans import fixtures as fx
from postmill.plans.registry import query
from postmill.schema import FACT
from postmill.session import durable

NOW = "2024-01-01T00:00:00Z"


def now():
    return F.timestamp_seconds(F.lit(1704067200))


def simple_facts(spark, sf):
    """`fx_facts` in the typed columns of the fact log."""
    f = fx.fx_facts(spark, sf).withColumnRenamed("v", "v_str")
    for name, kind in [(x.name, x.dataType) for x in FACT.fields]:
        if name not in f.columns:
            f = f.withColumn(name, (F.lit(0) if name == "ord" else F.lit(None)).cast(kind))
    return f.select("e", "a", *[F.col(c.name).cast(c.dataType).alias(c.name) for c in FACT.fields if c.name not in ("e", "a")])


def texts(df):
    return df.select("e", "a", FX.value_text().alias("v"))


_FOLD = "SELECT e, a, max_by(v, tx) AS v FROM fx_facts GROUP BY e, a HAVING max_by(op, tx) = 'add'"


@query("s1_attribute_scan", "SELECT e, v FROM fx_full WHERE a = 'post/author'")
def s1(spark, sf):
    return texts(fx.full_facts(spark, sf).where(F.col("a") == "post/author")).select("e", "v")


@query("s3_entity_scan", "SELECT e, a, v FROM fx_full ORDER BY e, a")
def s3(spark, sf):
    return texts(fx.full_facts(spark, sf).orderBy("e", "a"))


@query("a8_current_values", _FOLD)
def a8(spark, sf):
    return texts(FX.current(simple_facts(spark, sf)))


@query(
    "p1_wide_projection",
    """SELECT e, max(CASE WHEN a = 'post/body' THEN v END) AS body, max(CASE WHEN a = 'post/author' THEN v END) AS author
       FROM (""" + _FOLD + ") GROUP BY e",
)
def p1(spark, sf):
    return FX.pull(simple_facts(spark, sf), {"body": "post/body", "author": "post/author"})


@query(
    "p2_u9_snapshot",
    """SELECT p.id, p.old_id, p.author, p.body, p.created, p.updated, p.deleted, m.url AS media_url, m.version AS media_version,
         m.content_type, f.url AS full_url, f.width AS full_w, c.types
       FROM fx_posts p LEFT JOIN fx_media m ON m.post_id = p.id AND m.role = 'media'
       LEFT JOIN fx_media f ON f.post_id = p.id AND f.role = 'media_full'
       LEFT JOIN (SELECT post_id, string_agg(type, ',' ORDER BY e) AS types FROM fx_crossposts GROUP BY post_id) c ON c.post_id = p.id""",
)
def p2(spark, sf):
    s = FX.snapshot(fx.full_facts(spark, sf))
    return s.select(
        "id", "old_id", "author", "body", F.col("created").cast("timestamp_ntz").alias("created"),
        F.col("updated").cast("timestamp_ntz").alias("updated"), "deleted",
        F.col("media.url").alias("media_url"), F.col("media.version").alias("media_version"), "media.content_type",
        F.col("media_full.url").alias("full_url"), F.col("media_full.width").alias("full_w"),
        F.array_join(F.transform("crosspost", lambda c: c["type"]), ",").alias("types"),
    )


@query(
    "p3_pull_many",
    "SELECT id AS e, id, body, author FROM fx_posts WHERE id IN (SELECT post_id FROM fx_lookups)",
)
def p3(spark, sf):
    ids = fx.fx_lookups(spark, sf).select(F.col("post_id").alias("e"))
    return FX.pull_many(fx.full_facts(spark, sf), ids, {"id": "post/id", "body": "post/body", "author": "post/author"})


@query("jn1_url_of_first_versions", "SELECT e, url FROM fx_media WHERE version = 1")
def jn1(spark, sf):
    facts = FX.current(fx.full_facts(spark, sf))
    urls = facts.where(F.col("a") == "media/url").select("e", F.col("v_str").alias("url"))
    first = facts.where((F.col("a") == "media/version") & (F.col("v_long") == 1)).select("e")
    return urls.join(first, "e", "inner")


@query(
    "jn2_media_of_posts",
    """SELECT p.id, m.url AS media, f.url AS media_full FROM fx_posts p LEFT JOIN fx_media m ON m.post_id = p.id AND m.role = 'media'
       LEFT JOIN fx_media f ON f.post_id = p.id AND f.role = 'media_full'""",
)
def jn2(spark, sf):
    return FX.snapshot(fx.full_facts(spark, sf)).select("id", F.col("media.url").alias("media"), F.col("media_full.url").alias("media_full"))


@query(
    "jn3_crossposts_of_posts",
    """SELECT p.id, string_agg(c.type || ':' || coalesce(c.message_id, c.media_id), ',' ORDER BY c.e) AS crossposts
       FROM fx_posts p LEFT JOIN fx_crossposts c ON c.post_id = p.id GROUP BY p.id""",
)
def jn3(spark, sf):
    text = F.transform("crosspost", lambda c: F.concat(c["type"], F.lit(":"), F.coalesce(c["message_id"], c["media_id"])))
    return FX.snapshot(fx.full_facts(spark, sf)).select("id", F.array_join(text, ",").alias("crossposts"))


@query("jn4_posts_of_media", "SELECT e, url, post_id AS post FROM fx_media")
def jn4(spark, sf):
    return FX.media_posts(fx.full_facts(spark, sf))


_EDIT_VERDICT = """CASE WHEN x.{n} IS NOT DISTINCT FROM {o} THEN CASE WHEN {o} IS NULL THEN 'none' ELSE 'keep' END
  WHEN {o} IS NULL THEN CASE WHEN x.{n} LIKE 'uploads/%' THEN 'add' ELSE 'none' END WHEN x.{n} LIKE 'uploads/%' THEN 'replace' ELSE 'remove' END"""


@query(
    "jn11_media_changes",
    f"""SELECT x.post_id, x.seq, {_EDIT_VERDICT.format(n='media_url', o='p.media_url')} AS media_action,
          {_EDIT_VERDICT.format(n='full_url', o='p.full_url')} AS full_action FROM fx_edits x LEFT JOIN fx_posts p ON p.id = x.post_id""",
)
def jn11(spark, sf):
    return PB.media_changes(fx.fx_edits(spark, sf), fx.posts(spark, sf))


_UPSERT_ROWS = "SELECT old_id, 'imported ' || old_id AS body, post_id AS ord FROM fx_lookups UNION ALL SELECT old_id, 'again ' || old_id, post_id + 1 FROM fx_lookups WHERE post_id % 2 = 0"


@query(
    "u1_a10_identity_upsert",
    f"""WITH r AS ({_UPSERT_ROWS}), k AS (SELECT old_id, max_by(body, ord) AS body FROM r GROUP BY old_id),
          n AS (SELECT old_id, row_number() OVER (ORDER BY old_id) AS i FROM k WHERE old_id NOT IN (SELECT v FROM fx_full WHERE a = 'post/old-id'))
        SELECT k.old_id, coalesce(p.id, (SELECT max(e) FROM fx_full) + n.i) AS e, k.body FROM k
        LEFT JOIN fx_posts p ON p.old_id = k.old_id LEFT JOIN n ON n.old_id = k.old_id""",
)
def u1(spark, sf):
    look = fx.fx_lookups(spark, sf)
    first = look.select("old_id", F.concat(F.lit("imported "), "old_id").alias("body"), F.col("post_id").alias("ord"))
    again = look.where(F.col("post_id") % 2 == 0).select("old_id", F.concat(F.lit("again "), "old_id").alias("body"), (F.col("post_id") + 1).alias("ord"))
    facts = fx.full_facts(spark, sf)
    new = FX.upsert(facts, first.unionByName(again), "post/old-id", {"post/body": F.col("body")}, tx=2)
    changed = new.select("e").distinct()
    return FX.pull_many(facts.unionByName(new), changed, {"old_id": "post/old-id", "body": "post/body"}).select("old_id", "e", "body")


@query(
    "u2_u3_add_and_retract",
    f"""WITH f AS (SELECT e, a, CASE WHEN a = 'post/author' AND e % 3 = 0 THEN 'someone' ELSE v END AS v FROM fx_full
          WHERE NOT (a = 'post/old-id' AND e % 8 = 1) AND NOT (a = 'post/crosspost' AND e % 6 = 1)) SELECT e, a, v FROM f""",
)
def u2(spark, sf):
    facts = fx.full_facts(spark, sf)
    posts = facts.where(F.col("a") == "post/id").select("e")
    added = FX.fact_rows(posts.where(F.col("e") % 3 == 0), "e", {"post/author": F.lit("someone")}, tx=2)
    dropped = FX.retract_attribute(facts, posts.where(F.col("e") % 8 == 1), "post/old-id", tx=3)
    dropped = dropped.unionByName(FX.retract_attribute(facts, posts.where(F.col("e") % 6 == 1), "post/crosspost", tx=3))
    return texts(FX.current(facts.unionByName(added).unionByName(dropped)))


@query(
    "u4_retract_entity",
    f"""WITH d AS (SELECT id AS e FROM fx_posts WHERE id % 9 = 0 UNION SELECT e FROM fx_media WHERE post_id % 9 = 0 OR post_id % 10 = 3
          UNION SELECT e FROM fx_crossposts WHERE post_id % 9 = 0),
        f AS (SELECT * FROM fx_full WHERE e NOT IN (SELECT e FROM d)
          AND NOT (a IN ('post/media', 'post/media-full', 'post/crosspost') AND v IN (SELECT e::varchar FROM d))) SELECT e, a, v FROM f""",
)
def u4(spark, sf):
    facts = fx.full_facts(spark, sf)
    posts = facts.where((F.col("a") == "post/id") & (F.col("v_long") % 9 == 0)).select("e")
    media = fx.fx_media(spark, sf).where(F.col("post_id") % 10 == 3).select("e")
    return texts(FX.current(facts.unionByName(FX.retract_entity(facts, posts.unionByName(media), tx=2))))


@query(
    "u5_read_modify_write",
    """SELECT e, CASE WHEN id % 2 = 0 THEN v + 1 ELSE v END AS version FROM (SELECT e, post_id AS id, version AS v FROM fx_media)""",
)
def u5(spark, sf):
    facts = fx.full_facts(spark, sf)
    owned = FX.media_posts(facts).join(FX.pull(facts, {"version": "media/version"}), "e")
    bumped = FX.fact_rows(owned.where(F.col("post") % 2 == 0), "e", {"media/version": F.col("version") + 1}, tx=2)
    return FX.pull(facts.unionByName(bumped), {"version": "media/version"})


@query(
    "u8_soft_delete",
    """WITH l AS (SELECT DISTINCT post_id AS id FROM fx_lookups),
         n AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM l WHERE id NOT IN (SELECT id FROM fx_posts))
       SELECT coalesce(p.id, (SELECT max(e) FROM fx_full) + n.i) AS e, coalesce(p.id, n.id) AS id, p.author,
         CASE WHEN l.id IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE p.updated END AS updated,
         CASE WHEN l.id IS NOT NULL THEN true ELSE p.deleted END AS deleted
       FROM fx_posts p FULL JOIN l ON l.id = p.id LEFT JOIN n ON n.id = l.id""",
)
def u8(spark, sf):
    facts = fx.full_facts(spark, sf)
    gone = FX.soft_delete(facts, fx.fx_lookups(spark, sf).select(F.col("post_id").alias("id")), now(), tx=2)
    s = FX.snapshot(facts.unionByName(gone))
    return s.select("e", "id", "author", F.col("updated").cast("timestamp_ntz").alias("updated"), "deleted")


def _step_sql(role: str, wanted: str, suffix: str) -> str:
    return f"""CASE WHEN x.{wanted} = s.{role} THEN s.{role} WHEN x.{wanted} LIKE 'uploads/%' THEN '2024/' || s.post_id::varchar
      || CASE WHEN coalesce(s.media_v, 0) + 1 > 1 THEN 'v' || (coalesce(s.media_v, 0) + 1)::varchar ELSE '' END || '{suffix}.png' END AS {role},
      CASE WHEN x.{wanted} = s.{role} THEN s.{role}_v WHEN x.{wanted} LIKE 'uploads/%' THEN coalesce(s.media_v, 0) + 1 END AS {role}_v"""


_PLAN = f"""s AS (
    SELECT p.id AS post_id, 0 AS seq, NULL::varchar AS body, p.media_url AS media, p.media_version AS media_v, p.full_url AS full_, CASE WHEN p.full_url IS NOT NULL THEN p.media_version END AS full__v
    FROM fx_posts p WHERE p.id IN (SELECT post_id FROM fx_edits)
    UNION ALL
    SELECT s.post_id, x.seq, x.body, {_step_sql('media', 'media_url', '')}, {_step_sql('full_', 'full_url', '_full')}
    FROM s JOIN fx_edits x ON x.post_id = s.post_id AND x.seq = s.seq + 1)"""


def edits(spark, sf):
    return fx.fx_edits(spark, sf).withColumn("author", F.lit(None).cast("string"))


@query(
    "u7_w4_publish_plan",
    f"WITH RECURSIVE {_PLAN} SELECT post_id, seq, media AS media_url, media_v AS media_version, full_ AS full_url, full__v AS full_version FROM s WHERE seq > 0",
)
def u7(spark, sf):
    plan = PB.publish_plan(fx.posts(spark, sf), edits(spark, sf), 2024)
    return plan.select("post_id", "seq", "media_url", "media_version", "full_url", "full_version")


# each post after its last edit: the upload an edit left has that edit's traits, anything else those stored
_LAST = f"""{_PLAN}, l AS (SELECT post_id, max_by((body, media, media_v, full_, full__v), seq) AS v FROM s GROUP BY post_id),
    um AS (SELECT s.post_id, s.media AS url, max_by((x.media_content_type, x.media_width, x.media_height), s.seq) AS t
      FROM s JOIN fx_edits x ON x.post_id = s.post_id AND x.seq = s.seq WHERE x.media_url LIKE 'uploads/%' GROUP BY 1, 2),
    uf AS (SELECT s.post_id, s.full_ AS url, max_by((x.full_content_type, x.full_width, x.full_height), s.seq) AS t
      FROM s JOIN fx_edits x ON x.post_id = s.post_id AND x.seq = s.seq WHERE x.full_url LIKE 'uploads/%' GROUP BY 1, 2),
    a AS (SELECT p.id, p.created, CASE WHEN l.post_id IS NULL THEN p.body ELSE v[1] END AS body,
      CASE WHEN l.post_id IS NULL THEN p.updated ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated,
      CASE WHEN l.post_id IS NULL THEN p.media_url ELSE v[2] END AS media_url, CASE WHEN l.post_id IS NULL THEN p.full_url ELSE v[4] END AS full_url,
      CASE WHEN l.post_id IS NULL THEN p.media_version ELSE v[3] END AS media_version,
      CASE WHEN l.post_id IS NULL THEN p.media_version ELSE v[5] END AS full_version, p.media_url AS m0, p.full_url AS f0, p.media_type, p.media_w, p.media_h
      FROM fx_posts p LEFT JOIN l ON l.post_id = p.id),
    after AS (SELECT a.id, a.body, a.created, a.updated, a.media_url, a.full_url,
      CASE WHEN a.media_url IS NOT NULL THEN a.media_version END AS media_version, CASE WHEN a.full_url IS NOT NULL THEN a.full_version END AS full_version,
      CASE WHEN a.media_url = m0 THEN media_type ELSE um.t[1] END AS media_type, CASE WHEN a.media_url = m0 THEN media_w ELSE um.t[2] END AS media_width,
      CASE WHEN a.media_url = m0 THEN media_h ELSE um.t[3] END AS media_height, CASE WHEN a.full_url = f0 THEN media_type ELSE uf.t[1] END AS full_type,
      CASE WHEN a.full_url = f0 THEN 2 * media_w ELSE uf.t[2] END AS full_width, CASE WHEN a.full_url = f0 THEN 2 * media_h ELSE uf.t[3] END AS full_height
      FROM a LEFT JOIN um ON um.post_id = a.id AND um.url = a.media_url LEFT JOIN uf ON uf.post_id = a.id AND uf.url = a.full_url)"""


def published(spark, sf):
    """All facts after the edits are published as transaction 2."""
    facts = fx.full_facts(spark, sf)
    plan = PB.publish_plan(FX.snapshot(facts), edits(spark, sf), 2024)
    return facts.unionByName(durable(PB.publish_facts(facts, plan, now(), tx=2)))  # folds read it once for each kind of entity


@query("u7_x2_publish_snapshot", f"WITH RECURSIVE {_LAST} SELECT * FROM after")
def u7b(spark, sf):
    after = FX.snapshot(published(spark, sf))
    traits = {"url": "url", "version": "version", "type": "content_type", "width": "width", "height": "height"}
    media = [F.col(f"{m}.{c}").alias(f"{role}_{n}") for role, m in (("media", "media"), ("full", "media_full")) for n, c in traits.items()]
    return after.select("id", "body", F.col("updated").cast("timestamp_ntz").alias("updated"), F.col("created").cast("timestamp_ntz").alias("created"), *media)


@query(
    "u7_live_media",
    f"""WITH RECURSIVE {_LAST} SELECT url, count(*) AS n FROM (SELECT media_url AS url FROM after UNION ALL SELECT full_url FROM after)
        WHERE url IS NOT NULL GROUP BY url""",
)
def u7d(spark, sf):
    """Every media entity alive after publishing, whether a post refers to it or not."""
    return FX.pull(published(spark, sf), {"url": "media/url"}).groupBy("url").agg(F.count("*").alias("n"))


@query(
    "u7_a3_new_posts",
    """WITH b AS (SELECT row_number() OVER (ORDER BY item_id) AS k, text FROM benchmark), t AS (SELECT max(id) AS top FROM fx_posts)
       SELECT top + k AS id, 'editor' AS author, text AS body, '2024/' || (top + k)::varchar || '.png' AS media_url,
         TIMESTAMP '2024-01-01 00:00:00' AS created FROM b, t""",
)
def u7c(spark, sf):
    facts = fx.full_facts(spark, sf)
    none = F.lit(None)
    new = fx.table(spark, sf, "benchmark").select(
        none.cast("bigint").alias("post_id"), F.col("item_id").alias("seq"), F.lit("editor").alias("author"), F.col("text").alias("body"),
        F.concat(F.lit("uploads/"), F.col("item_id").cast("string"), F.lit(".png")).alias("media_url"), none.cast("string").alias("full_url"),
    )
    posts = FX.snapshot(facts)
    plan = PB.publish_plan(posts, new, 2024)
    after = FX.snapshot(facts.unionByName(durable(PB.publish_facts(facts, plan, now(), tx=2))))
    fresh = after.where(F.col("id") > posts.agg(F.max("id").alias("m")).scalar())
    return fresh.select("id", "author", "body", F.col("media.url").alias("media_url"), F.col("created").cast("timestamp_ntz").alias("created"))
