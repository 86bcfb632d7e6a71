"""The fact log: current values, wide projections, snapshots and change rows.

Facts are rows `e, a, v_*, tx, ord, op`. The value of a single-valued attribute is the last fact by
`(tx, ord)` unless that is a retraction; of a many-valued one, each value by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.ordering import numbered
from postmill.schema import ATTR, ATTRS, FACT, VALUE_COLUMNS

MANY = [a.name for a in ATTRS if a.many]
COMPONENTS = [a.name for a in ATTRS if a.component]
BULKY = [a.name for a in ATTRS if a.bulky]
COLUMNS = FACT.fieldNames()

# wide names of the attributes, by entity
POST_ATTRS = {
    "id": "post/id",
    "old_id": "post/old-id",
    "author": "post/author",
    "body": "post/body",
    "created": "post/created",
    "updated": "post/updated",
    "deleted": "post/deleted?",
    "media_ref": "post/media",
    "full_ref": "post/media-full",
}
MEDIA_ATTRS = {
    "url": "media/url",
    "old_url": "media/old-url",
    "content_type": "media/content-type",
    "width": "media/width",
    "height": "media/height",
    "version": "media/version",
}
CROSSPOST_ATTRS = {
    "type": "crosspost/type",
    "channel": "crosspost.tg/channel",
    "message_id": "crosspost.tg/message-id",
    "media_id": "crosspost.mstd/media-id",
    "ids": "crosspost.mstd/ids",
}


# bits of a fact's place in the log: transaction, order within it, and whether it adds
_TX_BITS, _ORD_BITS = 26, 36


def place() -> Column:
    """A long that grows with `(tx, ord)` and is odd for facts that add.

    A fold keeps the highest place of each entity and attribute, which fits in a fixed-width buffer, and values are
    fetched by it afterwards. No two facts about one attribute of one entity may have the same place.
    """
    fits = F.col("tx").between(0, (1 << _TX_BITS) - 1) & F.col("ord").between(0, (1 << _ORD_BITS) - 1)
    packed = F.shiftleft("tx", _ORD_BITS + 1) + F.shiftleft("ord", 1) + (F.col("op") == "add").cast("bigint")
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("tx or ord of a fact is out of range")).cast("bigint"))


def _adds(at: Column) -> Column:
    return at.bitwiseAND(1) == 1


def fact_rows(df: DataFrame, e: str | Column, values: dict[str, Column], tx: int | Column, op: str = "add") -> DataFrame:
    """Facts from wide rows, one per non-null value. A column `ord` of `df` orders them, else 0."""
    types = {f.name: f.dataType for f in FACT.fields}
    ordinal = F.col("ord") if "ord" in df.columns else F.lit(0)
    empty = {c: F.lit(None).cast(types[c]).alias(c) for c in VALUE_COLUMNS}
    items = []
    for name, value in values.items():
        target = ATTR[name].column
        columns = [*{**empty, target: value.cast(types[target]).alias(target)}.values()]
        items.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("a"), *columns)))
    e = F.col(e) if isinstance(e, str) else e
    tx = F.lit(tx) if isinstance(tx, int) else tx
    each = df.select(
        e.cast("bigint").alias("e"), tx.cast("bigint").alias("tx"), ordinal.cast("bigint").alias("ord"), F.explode_outer(F.array(*items)).alias("f")
    )
    return each.where(F.col("f").isNotNull()).select("e", "f.*", "tx", "ord", F.lit(op).alias("op")).select(*COLUMNS)


def facts_from_tables(posts: DataFrame, media: DataFrame, crossposts: DataFrame, tx: int) -> DataFrame:
    """Facts of flat posts, media `(e, post_id, role, ...)` and crossposts `(e, post_id, ...)`."""
    names = {k: v for k, v in POST_ATTRS.items() if not k.endswith("_ref")}
    rows = [fact_rows(posts, "id", {a: F.col(c) for c, a in names.items()}, tx)]
    rows.append(fact_rows(media, "e", {a: F.col(c) for c, a in MEDIA_ATTRS.items()}, tx))
    refs = {
        "post/media": F.when(F.col("role") == "media", F.col("e")),
        "post/media-full": F.when(F.col("role") == "media_full", F.col("e")),
    }
    rows.append(fact_rows(media, "post_id", refs, tx))
    fields = {a: F.col(c) for c, a in CROSSPOST_ATTRS.items() if c in crossposts.columns}
    rows.append(fact_rows(crossposts, "e", fields, tx))
    rows.append(fact_rows(crossposts, "post_id", {"post/crosspost": F.col("e")}, tx))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def value_text(prefix: str = "") -> Column:
    """The value of a fact as text (times in epoch milliseconds)."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        c("v_str"),
        c("v_long").cast("string"),
        F.unix_millis(c("v_ts")).cast("string"),
        c("v_bool").cast("string"),
        F.array_join(c("v_arr"), ","),
    )


def current(facts: DataFrame) -> DataFrame:
    """Current facts `e, a, v_*`, folded map-side before the shuffle.

    Bulky values take no part in the fold: it finds their last place, by which they are fetched, so each moves once.
    """
    one = F.when(F.col("a").isin(MANY), F.col("v_long"))
    keyed = facts.select("e", "a", one.alias("one"), place().alias("at"), *VALUE_COLUMNS)
    bulky = F.col("a").isin(BULKY)
    small = keyed.where(~bulky).groupBy("e", "a", "one").agg(F.max_by(F.struct(*VALUE_COLUMNS), "at").alias("v"), F.max("at").alias("last"))
    small = small.where(_adds(F.col("last"))).select("e", "a", *[f"v.{c}" for c in VALUE_COLUMNS])
    large = keyed.where(bulky)
    last = large.groupBy("e", "a").agg(F.max("at").alias("last")).where(_adds(F.col("last")))
    # a difference instead of an equality keeps the join on the keys that the aggregation is dealt by
    large = large.join(last, ["e", "a"]).where(F.col("at") - F.col("last") == 0)
    return small.unionByName(large.select(*small.columns))


def pull(facts: DataFrame, attrs: dict[str, str], late: bool = False) -> DataFrame:
    """Wide rows `e, <name>...` of single-valued attributes: fold and pivot in one aggregation.

    Of bulky attributes it keeps the last place; their values come from their own part of the log, by a join on the
    entity that finds the wide rows dealt by it already. With `late` the places stay, as `at_<name>`, for `fetch` to
    replace after other joins. The attribute names are literals, so the filters prune the partitions of a stored log.
    """
    aggs = []
    for name, attr in attrs.items():
        # rows of other attributes have a null place and are ignored
        at = F.when(F.col("a") == attr, F.col("at"))
        aggs.append(F.max(at).alias(f"at_{name}"))
        if attr not in BULKY:
            aggs.append(F.max_by(F.col(ATTR[attr].column), at).alias(name))
    columns = sorted({ATTR[a].column for a in attrs.values() if a not in BULKY})
    wanted = facts.where(F.col("a").isin(list(attrs.values())))
    wide = wanted.select("e", "a", place().alias("at"), *columns).groupBy("e").agg(*aggs)
    kept = {n: n if a not in BULKY else f"at_{n}" for n, a in attrs.items()}
    out = wide.select("e", *[F.when(_adds(F.col(f"at_{n}")), F.col(c)).alias(c) for n, c in kept.items()])
    out = out.where(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in kept.values()]))
    if late:
        return out
    for name, attr in attrs.items():
        if attr in BULKY:
            out = fetch(out, facts, name, attr)
    return out.select("e", *attrs)


def fetch(wide: DataFrame, facts: DataFrame, name: str, attr: str) -> DataFrame:
    """Replaces `at_<name>` by the attribute's value at that place."""
    values = facts.where((F.col("a") == attr) & (F.col("op") == "add"))
    values = values.select(F.col("e").alias("e_"), place().alias("at_"), F.col(ATTR[attr].column).alias(name))
    same = (F.col("e") == F.col("e_")) & (F.col("at_") - F.col(f"at_{name}") == 0)
    return wide.join(values, same, "left").drop("e_", "at_", f"at_{name}")


def pull_many(facts: DataFrame, entities: DataFrame, attrs: dict[str, str]) -> DataFrame:
    """`pull` for the entities `e` of another table."""
    wanted = facts.where(F.col("a").isin(list(attrs.values())))
    return pull(wanted.join(entities.select("e"), "e", "left_semi"), attrs)


def references(facts: DataFrame, attr: str) -> DataFrame:
    """Current references `e, ref` of one attribute, single- or many-valued: one hash aggregation."""
    keys = ["e", "v_long"] if attr in MANY else ["e"]
    rows = facts.where(F.col("a") == attr).select("e", "v_long", place().alias("at"))
    last = rows.groupBy(*keys).agg(F.max_by("v_long", "at").alias("ref"), F.max("at").alias("last"))
    return last.where(_adds(F.col("last"))).select("e", "ref")


def snapshot(facts: DataFrame, entities: bool = False) -> DataFrame:
    """All posts with media and crossposts nested: `e`, then the columns of a post.

    Media and crossposts are brought to their post, and bodies come last, so that a body moves once. With `entities` there are also
    `media_ref`, `full_ref` and `crosspost_refs` (in the order of `crosspost`), the entities behind the nested columns.
    """
    names = [n for n in POST_ATTRS if not n.endswith("_ref")]
    posts = pull(facts, {n: POST_ATTRS[n] for n in names}, late=True).where(F.col("id").isNotNull())

    # each medium goes to the post that refers to it, in whichever role
    roles = {"media": POST_ATTRS["media_ref"], "full": POST_ATTRS["full_ref"]}
    refs = facts.where(F.col("a").isin(list(roles.values()))).select("e", "a", "v_long", place().alias("at"))
    refs = refs.groupBy("e", "a").agg(F.max_by("v_long", "at").alias("ref"), F.max("at").alias("last")).where(_adds(F.col("last")))
    found = refs.join(pull(facts, MEDIA_ATTRS).withColumnRenamed("e", "ref"), "ref")
    media = F.struct(*MEDIA_ATTRS)
    by_role = found.groupBy("e").agg(
        *[F.max(F.when(F.col("a") == a, media)).alias(n) for n, a in zip(("media", "media_full"), roles.values())],
        *[F.max(F.when(F.col("a") == a, F.col("ref"))).alias(f"{n}_ref") for n, a in roles.items()],
    )
    fields = list(CROSSPOST_ATTRS)
    crossposts = pull(facts, CROSSPOST_ATTRS).withColumnRenamed("e", "ref")
    by_post = (
        references(facts, "post/crosspost")
        .join(crossposts, "ref")
        .groupBy("e")
        .agg(F.sort_array(F.collect_list(F.struct("ref", *fields))).alias("c"))
        .select("e", F.transform("c", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("crosspost"), F.col("c.ref").alias("crosspost_refs"))
    )
    out = fetch(posts.join(by_role, "e", "left").join(by_post, "e", "left"), facts, "body", POST_ATTRS["body"])
    extra = ["media_ref", "full_ref", "crosspost_refs"] if entities else []
    return out.select("e", *names, "media", "media_full", "crosspost", *extra)


def facts_of_posts(posts: DataFrame, tx: int) -> DataFrame:
    """The facts behind rows of `snapshot(..., entities=True)`, as of transaction `tx`."""
    parts = [fact_rows(posts, "e", {a: F.col(n) for n, a in POST_ATTRS.items()}, tx)]
    for ref, column in (("media_ref", "media"), ("full_ref", "media_full")):
        own = posts.where(F.col(ref).isNotNull())
        parts.append(fact_rows(own, F.col(ref), {a: F.col(f"{column}.{n}") for n, a in MEDIA_ATTRS.items()}, tx))
    each = posts.select("e", F.explode(F.arrays_zip(F.col("crosspost_refs").alias("ref"), F.col("crosspost").alias("c"))).alias("z"))
    parts.append(fact_rows(each, F.col("z.ref"), {a: F.col(f"z.c.{n}") for n, a in CROSSPOST_ATTRS.items()}, tx))
    parts.append(fact_rows(each, "e", {"post/crosspost": F.col("z.ref")}, tx))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def media_posts(facts: DataFrame) -> DataFrame:
    """Media with the post that owns them in either role: `e, url, post`."""
    media = pull(facts, {"url": "media/url"})
    by_role = [
        references(facts, attr).select(F.col("e").alias(name), F.col("ref").alias("e"))
        for attr, name in (("post/media", "p1"), ("post/media-full", "p2"))
    ]
    joined = media.join(by_role[0], "e", "left").join(by_role[1], "e", "left")
    return joined.select("e", "url", F.coalesce("p1", "p2").alias("post"))


# ---- change rows ---------------------------------------------------------------------------------


def holders(facts: DataFrame, attr: str, values: DataFrame) -> DataFrame:
    """Entities `e` currently holding one of the `value`s of a unique attribute: `value, e`.

    Only entities that ever held one are folded, so a small batch does not shuffle the whole log.
    """
    column = F.col(ATTR[attr].column).alias("value")
    log = facts.where(F.col("a") == attr)
    wanted = values.select("value").distinct()
    ever = log.select("e", column).join(wanted, "value", "left_semi").select("e").distinct()
    now = current(log.join(ever, "e", "left_semi")).select(column, "e")
    return now.join(wanted, "value", "left_semi")


def resolve(facts: DataFrame, rows: DataFrame, attr: str, column: str, top: int | None = None) -> DataFrame:
    """Adds `e`: the entity holding the unique value, or a new one per distinct new value.

    `rows` is read several times; store it first if it is costly. New entities follow `top`, by default the highest
    one in `facts`.
    """
    values = rows.select(F.col(column).alias("value"))
    known = holders(facts, attr, values).withColumnRenamed("value", column)
    fresh = rows.select(column).distinct().join(known, column, "left_anti")
    top = facts.agg(F.coalesce(F.max("e"), F.lit(0)).alias("e")).scalar() if top is None else F.lit(top)
    new = numbered(fresh, [column], "k").select(column, (F.col("k") + top).alias("new_e"))
    return rows.join(known, column, "left").join(new, column, "left").withColumn("e", F.coalesce("e", "new_e")).drop("new_e")


def upsert(facts: DataFrame, rows: DataFrame, identity: str, values: dict[str, Column], tx: int, top: int | None = None) -> DataFrame:
    """Facts that set `values` on the entities found or made by a unique attribute, whose value is
    in the column of that attribute's wide name. Later rows of a batch (by `ord`) win in the fold."""
    column = {v: k for k, v in {**POST_ATTRS, **MEDIA_ATTRS}.items()}[identity]
    found = resolve(facts, rows, identity, column, top)
    return fact_rows(found, "e", {identity: F.col(column), **values}, tx)


def retract_attribute(facts: DataFrame, entities: DataFrame, attr: str, tx: int) -> DataFrame:
    """Tombstones for one attribute of the entities `e`.

    A many-valued attribute gets one for each value that the stored facts hold at present.
    """
    ordinal = F.col("ord") if "ord" in entities.columns else F.lit(0)
    if attr in MANY:
        log = facts.where(F.col("a") == attr).join(entities.select("e").distinct(), "e", "left_semi")
        last = entities.groupBy("e").agg(F.max(ordinal).alias("ord"))
        values = [F.col(c) for c in VALUE_COLUMNS]
        return current(log).join(last, "e").select(
            "e", "a", *values, F.lit(tx).cast("bigint").alias("tx"), F.col("ord").cast("bigint").alias("ord"), F.lit("retract").alias("op")
        )
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in FACT.fields if f.name in VALUE_COLUMNS]
    return entities.select(
        "e", F.lit(attr).alias("a"), *nothing, F.lit(tx).cast("bigint").alias("tx"), ordinal.cast("bigint").alias("ord"), F.lit("retract").alias("op")
    )


def facts_about(facts: DataFrame, post_ids: DataFrame) -> DataFrame:
    """All facts of the posts with the given `id`s and of what they own."""
    posts = facts.where(F.col("a") == "post/id").join(post_ids.select(F.col("id").alias("v_long")), "v_long", "left_semi").select("e")
    owned = facts.where(F.col("a").isin(COMPONENTS)).join(posts, "e", "left_semi").select(F.col("v_long").alias("e"))
    return facts.join(posts.unionByName(owned).distinct(), "e", "left_semi").select(*COLUMNS)


def retract_entity(facts: DataFrame, entities: DataFrame, tx: int, ord: int = 0) -> DataFrame:
    """Tombstones for everything said about the entities `e`, their components, and references to
    either. Only the facts concerned are folded."""
    gone = entities.select("e").distinct()
    refs = facts.where(F.col("a").isin(COMPONENTS))
    owned = current(refs.join(gone, "e", "left_semi")).select(F.col("v_long").alias("e"))
    doomed = gone.unionByName(owned).distinct()
    own = current(facts.join(doomed, "e", "left_semi"))
    targets = doomed.select(F.col("e").alias("v_long"))
    # whoever ever pointed at them; the fold then tells who still does
    pointing = refs.join(targets, "v_long", "left_semi").select("e").distinct()
    pointers = current(refs.join(pointing, "e", "left_semi")).join(targets, "v_long", "left_semi")
    both = own.unionByName(pointers.select(*own.columns))
    return both.select(
        "e", "a", *VALUE_COLUMNS, F.lit(tx).cast("bigint").alias("tx"), F.lit(ord).cast("bigint").alias("ord"), F.lit("retract").alias("op")
    ).select(*COLUMNS)


def soft_delete(facts: DataFrame, post_ids: DataFrame, now: Column, tx: int, top: int | None = None) -> DataFrame:
    """Marks posts `id` as deleted. An unknown id makes a new entity without a body."""
    return upsert(facts, post_ids.select("id").distinct(), "post/id", {"post/updated": now, "post/deleted?": F.lit(True)}, tx, top)
