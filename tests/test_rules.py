"""Golden values and properties of the row rules, worked out by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from postmill.functions import media as M
from postmill.functions import mime
from postmill.functions import text as X
from postmill.operators import listing as L
from postmill.operators import migrate as MG
from postmill.operators import outbox as OB
from postmill.operators import search as S
from postmill.operators.ordering import numbered
from postmill.operators.threads import split_thread


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def python_split(s):
    """The cutting rule written out step by step."""
    if len(s) < 500:
        return [s]
    parts = []
    while len(s) >= 480:
        pos = len(s) // 2 if len(s) < 960 else 480
        i = max(s.rfind(" ", 0, pos + 1), s.rfind("\n", 0, pos + 1))
        left, s = (s[:i], s[i:].lstrip(" \n\t\r\f\v")) if i > 0 else (s[:pos], s[pos:])
        parts.append(left)
    parts.append(s)
    n = len(parts)
    return [("... " if i else "") + p + (" ..." if i < n - 1 else "") + f" {i + 1}/{n}" for i, p in enumerate(parts)]


WORDY = "lorem ipsum dolor sit amet consectetur " * 200
BODIES = [
    *[WORDY[:n] for n in (0, 1, 479, 480, 499, 500, 501, 959, 960, 961, 1440, 5000, 7800)],
    *["x" * n for n in (499, 500, 959, 960, 961, 5000)],
    " " + "y" * 1200,
    "a " + "y" * 957,
    "a " + "y" * 500 + " " + "z" * 400,
    " " * 1300,
    "word\n" * 300,
    "two  spaces  " * 150,
    "tab\tand  \n\n  breaks " * 90,
    "b" * 480 + " " + "c" * 480,
    "b" * 481 + " " + "c" * 600,
    "é" * 700 + " ß" * 300,
]


def test_thread_split_against_model(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "id long, body string")
    for row in df.select("id", split_thread(F.col("body")).alias("parts")).collect():
        assert row["parts"] == python_split(BODIES[row["id"]]), row["id"]


def test_thread_keeps_every_character(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "body string").where("length(body) >= 500")
    bare = F.transform(split_thread(F.col("body")), lambda p, i: F.regexp_replace(F.regexp_replace(p, r" (\.\.\. )?\d+/\d+\z", ""), r"\A\.\.\. ", ""))
    squeezed = lambda c: F.regexp_replace(c, r"[\s.]+", "")
    assert df.where(squeezed(F.array_join(bare, "")) != squeezed(F.regexp_replace("body", r" \.\.\.", ""))).count() == 0


@pytest.mark.parametrize(
    "text, html",
    [
        ("hi", "<p>hi</p>"),
        ("a\n\r\nb\n\n", "<p>a</p><p>b</p>"),
        ("\nlead", "<p></p><p>lead</p>"),
        ("\n\n", ""),
        ("see https://www.a.org/x/, ok", '<p>see <a href="https://www.a.org/x/" target="_blank">a.org/x</a>, ok</p>'),
        ("http://a.org/p#frag.", '<p><a href="http://a.org/p#frag" target="_blank">a.org/p</a>.</p>'),
        ("@a-b and #tag", '<p><a href="/search?q=%40a-b">@a-b</a> and <a href="/search?q=%23tag">#tag</a></p>'),
        ("x@y", "<p>x@y</p>"),
        ("@<em>bob</em>!", '<p><a href="/search?q=%40bob">@<em>bob</em></a>!</p>'),
        ("http://x.org/<em>a</em>", '<p><a href="http://x.org/a" target="_blank">x.org/<em>a</em></a></p>'),
    ],
)
def test_format_text(spark, text, html):
    assert one(spark, X.format_text(F.col("t")), t=text) == html


def test_uri_component(spark):
    assert one(spark, X.encode_uri_component(F.col("t")), t="a b!'()~*é&") == "a%20b!'()~*%C3%A9%26"


def test_encode_number_keeps_order(spark):
    codes = [r[0] for r in spark.range(0, 5000, 37).select(X.encode_number(F.col("id"), 5).alias("c")).orderBy("c").collect()]
    again = [r[0] for r in spark.range(0, 5000, 37).select(X.encode_number(F.col("id"), 5).alias("c"), "id").orderBy("id").collect()]
    assert codes == again and one(spark, X.encode_number(F.lit(0), 3)) == "---"


@pytest.mark.parametrize("body, ok", [("", False), (" \t\n", False), ("   ", False), ("a", True), (" .", True)])
def test_publishable(spark, body, ok):
    assert one(spark, X.is_publishable(F.col("b")), b=body) is ok


@pytest.mark.parametrize(
    "w, h, box",
    [(100, 80, (100, 80)), (550, 500, (550, 500)), (1100, 500, (550, 250)), (100, 1000, (50, 500)), (1000, 1500, (333, 500)), (551, 1, (550, 0)), (1, 501, (0, 500))],
)
def test_fit(spark, w, h, box):
    assert tuple(one(spark, M.fit(F.lit(w).cast("bigint"), F.lit(h).cast("bigint")))) == box


@pytest.mark.parametrize("w, h, box", [(641, 481, (640, 480)), (2200, 1000, (1100, 500)), (1101, 2001, (550, 1000)), (333, 3000, (110, 1000))])
def test_video_size(spark, w, h, box):
    assert tuple(one(spark, M.video_size(F.lit(w).cast("bigint"), F.lit(h).cast("bigint")))) == box


@pytest.mark.parametrize(
    "name, kind, w, h, plan",
    [
        ("5_1_full.mp4", "video/mp4", 2200, 1000, ("transcode", "5_1.mp4", "video/mp4", 1100, 500, True)),
        ("5_1_full.gif", "image/gif", 2200, 1000, ("keep", "5_1.gif", "image/gif", 2200, 1000, False)),
        ("5_1_full.jpeg", "image/jpeg", 900, 900, ("keep", "5_1.jpeg", "image/jpeg", 900, 900, False)),
        ("5_1_full.jpeg", "image/jpeg", 2200, 900, ("resize", "5_1.jpeg", "image/jpeg", 1100, 450, True)),
        ("5_1_full.png", "image/png", 300, 300, ("convert", "5_1.jpeg", "image/jpeg", 300, 300, True)),
    ],
)
def test_conversion_plan(spark, name, kind, w, h, plan):
    got = one(spark, M.conversion_plan(F.col("n"), F.col("k"), F.lit(w).cast("bigint"), F.lit(h).cast("bigint")), n=name, k=kind)
    assert tuple(got) == plan


def test_unknown_upload_fails(spark):
    with pytest.raises(PySparkException, match="Unknown content-type"):
        one(spark, M.conversion_plan(F.lit("a_full.pdf"), F.col("k"), F.lit(1), F.lit(1)), k="application/pdf")


def test_probe(spark):
    assert tuple(one(spark, M.parse_probe(F.col("o")), o="640x480x10")) == (640, 480, 10)
    assert tuple(one(spark, M.parse_probe(F.col("o")), o="640x480xN/A")) == (640, 480, None)
    with pytest.raises(PySparkException, match="Unexpected probe"):
        one(spark, M.parse_probe(F.col("o")), o="bad")


def test_mime(spark):
    assert len(mime.MIME_TYPES) == 91
    assert one(spark, mime.mime_type(F.col("n")), n="2020/A.JPG") == "image/jpeg"
    assert one(spark, mime.mime_type(F.col("n")), n="no-ext") == "application/octet-stream"
    for kind, ext in [("image/png", "png"), ("image/svg+xml", "svg"), ("video/quicktime", "mov"), ("x/unknown", "unknown")]:
        assert one(spark, mime.extension_for(F.col("k")), k=kind) == ext


@pytest.mark.parametrize(
    "page, total, pages, before, after",
    [
        (1, 1, [], False, False),
        (-1, 5, [4, 3, 2, 1], False, False),
        (-1, 30, [29, 28, 27, 26, 25, 24, 23, 22, 21, 20], False, True),
        (4, 30, [8, 7, 6, 5, 4, 3, 2, 1], True, False),
        (5, 30, [8, 7, 6, 5, 4, 3, 2, 1], True, False),
        (10, 30, [13, 12, 11, 10, 9, 8, 7, 6], True, True),
        (23, 30, [26, 25, 24, 23, 22, 21, 20, 19], True, True),
        (24, 30, [29, 28, 27, 26, 25, 24, 23, 22, 21, 20], False, True),
    ],
)
def test_archive_window(spark, page, total, pages, before, after):
    w = one(spark, L.archive_window(F.lit(page).cast("bigint"), F.lit(total).cast("bigint")))
    assert (w["pages"], w["gap_before"], w["gap_after"]) == (pages, before, after)


@pytest.mark.parametrize(
    "page, hits, pages",
    [(1, 1, [1]), (1, 1000, list(range(1, 15))), (8, 1000, list(range(1, 15))), (9, 1000, list(range(4, 16))), (95, 1000, list(range(88, 101))), (94, 1000, list(range(89, 101)))],
)
def test_search_window(spark, page, hits, pages):
    assert one(spark, L.search_window(F.lit(page).cast("bigint"), F.lit(hits).cast("bigint"), 10))["pages"] == pages


def test_empty_store_has_no_pages(spark):
    empty = spark.createDataFrame([], "id bigint, deleted boolean")
    assert tuple(L.total_pages(empty, 10).first()) == (None, 0, 1)
    assert L.index_page(empty, 10).count() == 0


def test_deleted_by_presence_in_listings_by_truth_in_lookups(spark):
    posts = spark.createDataFrame([(1, None), (2, False), (3, True)], "id bigint, deleted boolean")
    assert [r["id"] for r in L.newest_first(posts).collect()] == [1]
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "post_id bigint")
    assert {r["post_id"]: r["message"] for r in L.resolve(asked, posts).collect()} == {1: "OK", 2: "OK", 3: "Deleted", 4: "Not found"}


def test_sitemap_blocks_cover_all_pages(spark):
    from postmill.schema import Site

    posts = spark.range(1, 96).select("id", F.lit(None).cast("boolean").alias("deleted"))
    rows = L.sitemap(posts, Site(), block=4).where("section = 2").collect()
    assert sorted(-r["ord"] for r in rows) == list(range(1, 10))


def test_numbering_spreads_equal_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("id"))
    got = numbered(rows, ["k", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_highlight(spark):
    cases = [
        ([S.term("cat")], "Cat, cats and CAT", "<em>Cat</em>, cats and <em>CAT</em>"),
        ([S.term("dog")], "a cat", None),
        ([S.prefix("ca")], "cat car dog", "<em>cat</em> <em>car</em> dog"),
        ([S.phrase("in the")], "the in the end", "the <em>in</em> <em>the</em> end"),
        ([S.term("s")], "ſ s", "ſ <em>s</em>"),
    ]
    for clauses, body, want in cases:
        assert one(spark, S.highlight(F.col("b"), clauses), b=body) == want


def test_phrase_of_three_and_repeats(spark):
    posts = spark.createDataFrame([(1, "to be or not to be"), (2, "be to or"), (3, "or not to go")], "id long, body string")
    index = S.build_index(posts.withColumn("created", F.timestamp_seconds(F.lit(0))))
    assert [r["id"] for r in S.matches(index, must=[S.phrase("or not to")]).orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in S.matches(index, must=[S.phrase("to be")], must_not=[S.term("go")]).collect()] == [1]
    with pytest.raises(ValueError):
        S.matches(index, must_not=[S.term("x")])


def test_index_upsert_with_same_rows_changes_nothing(spark):
    posts = spark.createDataFrame([(1, "a b a"), (2, "b c")], "id long, body string").withColumn("created", F.timestamp_seconds(F.lit(0)))
    index = S.build_index(posts)
    again = S.upsert_index(index, posts)
    rows = lambda i: sorted(map(str, i.postings.collect()))
    assert rows(index) == rows(again)


def test_unknown_repost_type_fails(spark):
    row = [("a", "b", "c", None, None, None, None, [("twitter", "x", "1", None)])]
    schema = (
        "id string, body string, author string, created timestamp, updated timestamp, "
        "picture struct<url string, content_type string, dimensions array<bigint>>, "
        "picture_original struct<url string, content_type string, dimensions array<bigint>>, "
        "reposts array<struct<type string, channel string, message_id string, photo string>>"
    )
    with pytest.raises(PySparkException, match="unknown type of repost"):
        MG.to_4(spark.createDataFrame(row, schema)).collect()


@pytest.mark.parametrize("old, new", [("2020/12_1.png", "2020/12.png"), ("2020/12_1_full.jpeg", "2020/12_full.jpeg"), ("2020/12v2.png", "2020/12v2.png")])
def test_unversioned(spark, old, new):
    assert one(spark, F.regexp_replace("u", MG.FIRST_VERSION, MG.UNVERSIONED), u=old) == new


def test_channels_switched_off(spark):
    posts = spark.createDataFrame(
        [(1, "me", "hello", None, None, None)],
        "id long, author string, body string, media struct<url string, content_type string>, "
        "media_full struct<url string, content_type string>, crosspost array<struct<type string, channel string, message_id string, media_id string, ids array<string>>>",
    )
    authors = spark.createDataFrame([(1, "me", "tgme")], "ord long, user_name string, telegram_user string")
    kinds = lambda c: sorted(r["kind"] for r in OB.outbox_new(posts, authors, c).collect())
    assert kinds(OB.Channels()) == ["status"]
    assert kinds(OB.Channels(telegram_channel="x")) == ["sendMessage", "status"]
    assert kinds(OB.Channels(telegram_channel="x", mastodon_token=False)) == ["sendMessage"]
    assert kinds(OB.Channels(mastodon_token=False)) == []
    message = OB.outbox_new(posts, authors, OB.Channels(telegram_channel="x", mastodon_token=False)).first()
    assert message["payload"] == '{"text":"@tgme: hello","disable_web_page_preview":"true"}'


def test_poll_outcomes(spark):
    rows = [("a", 1, 0, 200), ("b", 1, 0, 206), ("b", 2, 2000, 200), ("c", 1, 0, 206), ("c", 2, 30_000, 206), ("d", 1, 0, 500), ("e", 1, 0, 206)]
    got = OB.poll_outcome(spark.createDataFrame(rows, "media_id string, seq long, ts_ms long, code int"))
    assert {r["media_id"]: r["outcome"] for r in got.collect()} == {"a": "done", "b": "done", "c": "timed_out", "d": "failed", "e": "waiting"}


def test_duplicates_are_an_error(spark):
    from postmill.operators.checks import at_most_one

    rows = spark.createDataFrame([(1, "a"), (1, "b")], "id long, author string")
    with pytest.raises(PySparkException, match="no more than 1"):
        at_most_one(rows, "id", "author").collect()


def test_file_listing(spark, sf):
    from postmill.sources.files import file_listing

    names = {r.name for r in file_listing(spark, sf, r"[a-m].*\.parquet").collect()}
    assert "documents.parquet" in names and "pages.parquet" not in names


def test_malformed_edits_are_split_off(spark):
    from postmill.sources.files import good_edits, parse_edits

    rows = [(1, '{"post/body": "b", "post/media": {"media/url": "uploads/a.png", "media/width": 3}}'), (2, '{"post/bo'), (3, None), (4, "[1"), (5, "{}")]
    parsed = parse_edits(spark.createDataFrame(rows, "post_id long, json string"))
    assert sorted(r.post_id for r in parsed.where("bad IS NOT NULL").collect()) == [2, 3, 4]
    good = {r.post_id: r for r in good_edits(parsed).collect()}
    assert set(good) == {1, 5} and (good[1].body, good[1].media_url, good[1].media_width) == ("b", "uploads/a.png", 3)


def test_query_words_are_index_words(spark):
    from postmill.functions.text import tokens
    from postmill.operators.search import phrase, query_words, term
    from pyspark.sql import functions as F

    texts = ["हिन्दी में", "été snake_case x-y", "", "...", "A1 ² Ⅷ ǅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: query_words(t) for t in texts}
    assert term("x-y").words == ("x", "y") and phrase("").words == ()


def test_marks_words_with_signs(spark):
    from postmill.operators.search import any_of, highlight, phrase, prefix, term
    from pyspark.sql import functions as F

    text = "Don't, don t; 3.14 and 3.1 or 14 don't.\nDON'T"
    row = spark.createDataFrame([(text,)], "t string")
    marks = lambda *clauses: row.select(highlight(F.col("t"), list(clauses)).alias("m")).first().m
    assert marks(term("don")) == text.replace(" don ", " <em>don</em> ")
    assert marks(term("don't")) == "<em>Don't</em>, don t; 3.14 and 3.1 or 14 <em>don't</em>.\n<em>DON'T</em>"
    assert marks(term("14")) == text.replace(" 14 ", " <em>14</em> ")
    assert marks(prefix("3.")) == text.replace("3.14", "<em>3.14</em>").replace("3.1 ", "<em>3.1</em> ")
    assert marks(phrase("don't don't")) == "Don't, don t; 3.14 and 3.1 or 14 <em>don't</em>.\n<em>DON'T</em>"
    assert marks(term("1")) is None
    assert any_of(term("3.14")).should[0].words == ("3.14",)


def test_best_fragments(spark):
    from postmill.operators.search import best_fragments, build_index, fragment
    from pyspark.sql import functions as F

    bodies = {
        1: "the x x x x, the -- rare! the x",  # both words beat two common ones
        2: "the a the the b c d the the the",  # more hits win, then the first
        3: "nothing here",
        4: "the q the; q q q the q the",  # equal: the first
        5: "", 6: None, 7: "end the",
    }
    posts = spark.createDataFrame(list(bodies.items()), "id long, body string").withColumn("created", F.timestamp_seconds(F.lit(0)))
    best = best_fragments(build_index(posts), posts, "the rare", 4)
    rows = best.join(posts, "id").select("id", "first", "last", fragment(F.col("body"), F.col("first"), F.col("last")).alias("t")).collect()
    assert {r.id: (r.first, r.last, r.t) for r in rows} == {
        1: (5, 8, "the -- rare! the x"), 2: (0, 3, "the a the the"), 4: (0, 3, "the q the; q"), 7: (1, 1, "the"),
    }
    assert best_fragments(build_index(posts), posts, "?!", 4).collect() == []


def test_blank_query_finds_nothing(spark):
    from postmill.operators.search import build_index, result_page

    posts = spark.createDataFrame([(1, "a", "some words", None)], "id long, author string, body string, created timestamp")
    assert result_page(build_index(posts), posts, " !? ", 1, 10).collect() == []


def test_null_users_are_not_counted(spark):
    from datetime import datetime

    from postmill.streaming.requests import daily_requests

    rows = [(datetime(2024, 1, 1, 5), 1), (datetime(2024, 1, 1, 6), None), (datetime(2024, 1, 1, 7), 1)]
    got = daily_requests(spark.createDataFrame(rows, "ts timestamp, user_id long")).collect()
    assert [(r.requests, r.users) for r in got] == [(3, 1)]
