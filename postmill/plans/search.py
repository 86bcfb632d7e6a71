"""Search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.operators import search as S
from postmill.operators import topk as TK
from postmill.plans import fixtures as fx
from postmill.plans.registry import query
from postmill.plans.sqltext import WORDS, format_text_sql, highlight_sql
from postmill.session import dropping, new_path

_TOKENS = f"regexp_extract_all(lower(body), '{WORDS}')"
_WORDS = f"SELECT id, created, unnest(t) AS term, unnest(range(len(t))) AS pos, len(t) AS dl FROM (SELECT id, created, {_TOKENS} AS t FROM fx_posts)"
_INDEX = f"""w AS ({_WORDS}),
 docs AS (SELECT id, epoch_us(created) // 1000000 AS created_s, len({_TOKENS}) AS dl FROM fx_posts),
 postings AS (SELECT term, id, count(*) AS tf, max(dl) AS dl, list(pos ORDER BY pos) AS positions FROM w GROUP BY term, id),
 stats AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM docs),
 dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def _bm25(tf: str, df: str, dl: str, n: str = "(SELECT n FROM stats)", avg: str = "(SELECT avg_dl FROM stats)") -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} / ({tf} + 1.2 * (1 - 0.75 + 0.75 * {dl} / {avg}))"


def _words_sql(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""scored AS (SELECT p.id, sum({_bm25('p.tf', 'd.df', 'p.dl')}) AS score, count(*) AS found
      FROM postings p JOIN dfs d USING (term) WHERE p.term IN ({listed}) GROUP BY p.id)"""


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


def docs(spark, sf):
    return fx.fx_posts(spark, sf).select("id", "created", "body")


_STORED: dict[tuple, str] = {}


def _key(spark, sf) -> tuple:
    """The application, and the names, sizes and times of the files behind the posts: an index of older files is not used."""
    files = []
    for name in ("documents", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        files += [(str(x.getPath()), x.getLen(), x.getModificationTime()) for x in listed]
    return (spark.sparkContext.applicationId, *sorted(files))


def stored(spark, sf) -> S.Index:
    """The index of all posts, built once per application and state of the tables. Small blocks, since the tables are small."""
    key = _key(spark, sf)
    if key not in _STORED:
        path = new_path(spark, "index")
        with dropping(spark):
            S.write_index(S.build_index_once(docs(spark, sf)), path, block=1 << 13)
        _STORED[key] = path
    return S.read_index(spark, _STORED[key])


@query("i1_a7_index_postings", f"WITH {_INDEX} SELECT term, id, tf, dl, array_to_string(positions, ',') AS positions FROM postings")
def i1(spark, sf):
    postings = S.build_index(docs(spark, sf)).postings.drop("created_s")
    return postings.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query("i13_index_docs", f"WITH {_INDEX} SELECT id, created_s, dl FROM docs")
def i13(spark, sf):
    return S.build_index(docs(spark, sf)).docs


@query("a7_term_stats", f"WITH {_INDEX} SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS cf FROM postings GROUP BY term")
def a7(spark, sf):
    return S.term_stats(S.build_index(docs(spark, sf)))


@query("a7_corpus_stats", f"WITH {_INDEX} SELECT count(*) AS n, cast(sum(dl) AS bigint) AS total_dl, round(avg(dl), 6) AS avg_dl FROM docs")
def a7b(spark, sf):
    return S.corpus_stats(S.build_index(docs(spark, sf))).withColumn("avg_dl", F.round("avg_dl", 6))


@query("i3_tokens", f"SELECT id, array_to_string({_TOKENS}, ' ') AS words FROM fx_posts")
def i3(spark, sf):
    return docs(spark, sf).select("id", F.array_join(X.tokens(F.col("body")), " ").alias("words"))


@query("i4_term_match", f"WITH {_INDEX} SELECT id, tf FROM postings WHERE term = 'the'")
def i4(spark, sf):
    index = stored(spark, sf)
    return index.postings.where(F.col("bucket") == S.term_bucket(F.lit("the"), index.buckets)).where(F.col("term") == "the").select("id", "tf")


@query(
    "i5_a6_all_words_count",
    f"WITH {_INDEX}, {_words_sql(['in', 'the'])} SELECT count(*) AS total FROM scored WHERE found = 2",
)
def i5(spark, sf):
    clauses = S.words_clause("in the")
    return S.matches(stored(spark, sf), must=clauses).agg(F.count("*").alias("total"))


@query(
    "i10_scores",
    f"WITH {_INDEX}, {_words_sql(['in', 'the'])} SELECT id, round(score, 6) AS score FROM scored WHERE found = 2",
)
def i10(spark, sf):
    clauses = S.words_clause("in the")
    return rounded(S.matches(stored(spark, sf), must=clauses))


_TOP = """SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score,
  (SELECT count(*) FROM {hits}) AS total FROM {hits} ORDER BY score DESC, id LIMIT {limit} OFFSET {offset}"""


@query(
    "i11_search_and_top10",
    f"WITH {_INDEX}, {_words_sql(['in', 'the'])}, hits AS (SELECT * FROM scored WHERE found = 2) "
    + _TOP.format(hits="hits", limit=10, offset=0),
)
def i11(spark, sf):
    clauses = S.words_clause("in the")
    return rounded(S.search(stored(spark, sf), must=clauses))


@query(
    "o3_o8_third_result_page",
    f"WITH {_INDEX}, {_words_sql(['in', 'the'])}, hits AS (SELECT * FROM scored WHERE found = 2) "
    + _TOP.format(hits="hits", limit=10, offset=20),
)
def o3(spark, sf):
    clauses = S.words_clause("in the")
    return rounded(S.search(stored(spark, sf), must=clauses, limit=10, offset=20))


@query(
    "jn9_hits_to_posts",
    f"WITH {_INDEX}, {_words_sql(['der', 'und'])}, hits AS (SELECT * FROM scored WHERE found = 2), top AS ("
    + _TOP.format(hits="hits", limit=10, offset=0)
    + ") SELECT t.rank, p.id, p.author, p.body FROM top t JOIN fx_posts p ON p.id = t.id",
)
def jn9(spark, sf):
    clauses = S.words_clause("der und")
    found = S.matches(stored(spark, sf), must=clauses)
    return S.ranked(found, 10).join(fx.fx_posts(spark, sf), "id").select("rank", "id", "author", "body")


@query(
    "i6_boolean",
    f"""WITH {_INDEX}, m AS (SELECT id, max(dl) AS dl, max(CASE WHEN term = 'the' THEN tf ELSE 0 END) AS a,
          max(CASE WHEN term = 'is' THEN tf ELSE 0 END) AS b, max(CASE WHEN term = 'ating' THEN tf ELSE 0 END) AS c,
          max(CASE WHEN term = 'with' THEN 1 ELSE 0 END) AS x FROM postings GROUP BY id),
        d AS (SELECT max(CASE WHEN term = 'the' THEN df END) AS da, max(CASE WHEN term = 'is' THEN df END) AS db,
          coalesce(max(CASE WHEN term = 'ating' THEN df END), 0) AS dc FROM dfs)
        SELECT id, round({_bm25('a', 'da', 'dl')} + {_bm25('b', 'db', 'dl')} + {_bm25('c', 'dc', 'dl')}, 6) AS score
        FROM m, d WHERE a > 0 AND x = 0""",
)
def i6(spark, sf):
    must, should, must_not = [S.term("the")], [S.term("is"), S.term("ating")], [S.term("with")]
    return rounded(S.matches(stored(spark, sf), must, should, must_not))


@query(
    "i6_any_of",
    f"""WITH {_INDEX}, {_words_sql(['les', 'und'])} SELECT id, round(score, 6) AS score FROM scored""",
)
def i6b(spark, sf):
    should = [S.term("les"), S.term("und")]
    return rounded(S.matches(stored(spark, sf), should=should))


@query(
    "i7_phrase",
    f"""WITH {_INDEX}, f AS (SELECT a.id, max(a.dl) AS dl, count(*) AS f FROM w a JOIN w b ON b.id = a.id AND b.pos = a.pos + 1
          WHERE a.term = 'in' AND b.term = 'the' GROUP BY a.id)
        SELECT id, round((ln(1 + (n - da + 0.5) / (da + 0.5)) + ln(1 + (n - db + 0.5) / (db + 0.5)))
          * f / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)), 6) AS score
        FROM f, stats, (SELECT max(CASE WHEN term = 'in' THEN df END) AS da, max(CASE WHEN term = 'the' THEN df END) AS db FROM dfs)""",
)
def i7(spark, sf):
    clause = S.phrase("in the")
    return rounded(S.matches(stored(spark, sf), must=[clause]))


@query(
    "i8_prefix_and_wildcard",
    f"""WITH {_INDEX} SELECT id, 3.0::double AS score FROM postings GROUP BY id
        HAVING bool_or(term LIKE 'ther%') AND bool_or(term LIKE '%i_g')""",
)
def i8(spark, sf):
    must = [S.prefix("ther", boost=2.0), S.wildcard("*i?g")]
    return S.matches(stored(spark, sf), must=must)


@query(
    "i9_fuzzy_range_boost",
    rf"""WITH {_INDEX} SELECT id, CASE WHEN bool_or(levenshtein(regexp_replace(term, '[^\x00-\x7F]', '~', 'g'), 'tionth') <= 2) THEN 1.5 ELSE 0 END
          + CASE WHEN bool_or(term BETWEEN 'un' AND 'und') THEN 0.5 ELSE 0 END AS score
        FROM postings GROUP BY id
        HAVING bool_or(levenshtein(regexp_replace(term, '[^\x00-\x7F]', '~', 'g'), 'tionth') <= 2) OR bool_or(term BETWEEN 'un' AND 'und')""",
)
def i9(spark, sf):
    should = [S.fuzzy("tionth", boost=1.5), S.term_range("un", "und", boost=0.5)]
    return S.matches(stored(spark, sf), should=should)


_LOOKUPS = {"prefix": S.prefix("ther"), "range": S.term_range("un", "und"), "wildcard": S.wildcard("in*g"), "fuzzy": S.fuzzy("there", 1)}


@query(
    "i8_i9_dictionary_terms",
    rf"""WITH {_INDEX}, d AS (SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS cf FROM postings GROUP BY term)
        SELECT 'prefix' AS clause, * FROM d WHERE term LIKE 'ther%'
        UNION ALL SELECT 'range', * FROM d WHERE term BETWEEN 'un' AND 'und'
        UNION ALL SELECT 'wildcard', * FROM d WHERE term LIKE 'in%g'
        UNION ALL SELECT 'fuzzy', * FROM d WHERE levenshtein(regexp_replace(term, '[^\x00-\x7F]', '~', 'g'), 'there') <= 1""",
)
def i8b(spark, sf):
    """The terms that each clause stands for, from the blocks of the dictionary that may have them."""
    index, parts = stored(spark, sf), []
    for name, clause in _LOOKUPS.items():
        parts.append(S.dictionary_of(index, [], [clause]).select(F.lit(name).alias("clause"), "term", "df", "cf"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "i2_index_upsert",
    f"""WITH {_INDEX.replace("FROM fx_posts", "FROM fx_now")}""".replace(
        "WITH w AS",
        "WITH fx_now AS (SELECT id, created, CASE WHEN id % 10 = 0 THEN body || ' edited again' ELSE body END AS body FROM fx_posts), w AS",
    )
    + " SELECT term, id, tf, dl, array_to_string(positions, ',') AS positions FROM postings",
)
def i2(spark, sf):
    posts = docs(spark, sf)
    changed = posts.where(F.col("id") % 10 == 0).withColumn("body", F.concat("body", F.lit(" edited again")))
    postings = S.upsert_index(stored(spark, sf), changed).postings.drop("created_s")
    return postings.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(
    "i13_time_filter",
    f"""WITH {_INDEX}, {_words_sql(['in', 'the'])} SELECT s.id, round(score, 6) AS score FROM scored s JOIN docs d ON d.id = s.id
        WHERE found = 2 AND created_s >= 1490000000""",
)
def i13b(spark, sf):
    clauses = S.words_clause("in the")
    return rounded(S.matches(stored(spark, sf), must=clauses, since_s=1490000000))


@query(
    "i12_highlight",
    f"SELECT id, {highlight_sql('body', ['in', 'the'])} AS marked FROM fx_posts",
)
def i12(spark, sf):
    return docs(spark, sf).select("id", S.highlight(F.col("body"), S.words_clause("in the")).alias("marked"))


_JOINED = """WITH fx_signs AS (SELECT id, created, replace(replace(body, ' the ', ' the''s 3.14 '), ' und ', ' und:so 1,000;5 a.b2.5 ') AS body FROM fx_posts)"""


@query("i3_words_with_signs", f"{_JOINED} SELECT id, array_to_string({_TOKENS}, ' ') AS words FROM fx_signs")
def i3b(spark, sf):
    """Every post, with words that hold signs put into it."""
    body = F.replace(F.replace("body", F.lit(" the "), F.lit(" the's 3.14 ")), F.lit(" und "), F.lit(" und:so 1,000;5 a.b2.5 "))
    return docs(spark, sf).select("id", F.array_join(X.tokens(body), " ").alias("words"))


_BEST_SIZE = 12


@query(
    "i12_best_fragment",
    f"""WITH {_INDEX}, hit AS (SELECT id, term, pos, dl FROM w WHERE term IN ('the', 'with')),
        runs AS (SELECT a.id, a.pos, max(a.dl) AS dl, count(*) AS hits, bool_or(b.term = 'the') AS has0, bool_or(b.term = 'with') AS has1
          FROM hit a JOIN hit b ON b.id = a.id AND b.pos BETWEEN a.pos AND a.pos + {_BEST_SIZE - 1} GROUP BY a.id, a.pos),
        rare AS (SELECT coalesce(max(CASE WHEN term = 'the' THEN df END), 0) AS d0, coalesce(max(CASE WHEN term = 'with' THEN df END), 0) AS d1 FROM dfs),
        weighed AS (SELECT id, pos, dl, hits, CASE WHEN has0 THEN ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) ELSE 0 END
            + CASE WHEN has1 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) ELSE 0 END AS weight FROM runs, rare, stats),
        best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, hits DESC, pos) AS k FROM weighed),
        cut AS (SELECT b.id, b.pos AS first, least(b.pos + {_BEST_SIZE}, b.dl) - 1 AS last, round(b.weight, 6) AS weight,
            regexp_split_to_array(p.body, '{WORDS}') AS gaps, regexp_extract_all(p.body, '{WORDS}') AS found
          FROM best b JOIN fx_posts p ON p.id = b.id WHERE k = 1),
        text AS (SELECT id, first, last, weight,
            array_to_string(list_transform(range(first, last + 1), lambda i: CASE WHEN i > first THEN gaps[i + 1] ELSE '' END || found[i + 1]), '') AS part FROM cut)
        SELECT id, cast(first AS int) AS first, cast(last AS int) AS last, weight, {highlight_sql('part', ['the', 'with'])} AS marked FROM text""",
)
def i12b(spark, sf):
    """For every post with one of the words, its best fragment, marked."""
    index = stored(spark, sf)
    clauses = S.words_clause("with the")
    best = S.best_fragments(index, S.matches(index, should=clauses), "the with", _BEST_SIZE)
    part = best.join(docs(spark, sf), "id").withColumn("part", S.fragment(F.col("body"), F.col("first"), F.col("last")))
    marked = S.highlight(F.col("part"), clauses).alias("marked")
    return part.select("id", "first", "last", F.round("weight", 6).alias("weight"), marked)


@query(
    "i14_result_page",
    f"""WITH {_INDEX}, {_words_sql(['in', 'the'])}, hits AS (SELECT * FROM scored WHERE found = 2), top AS ({_TOP.format(hits='hits', limit=10, offset=10)}),
        marked AS (SELECT t.rank, t.total, p.id, '<span class="post_author">' || p.author || ': </span>' || {highlight_sql('p.body', ['in', 'the'])} AS txt
          FROM top t JOIN fx_posts p ON p.id = t.id)
        SELECT rank, total, id, {format_text_sql('txt')} AS html FROM marked""",
)
def i14(spark, sf):
    return S.result_page(stored(spark, sf), fx.fx_posts(spark, sf), "in* the?", page=2, size=10)


@query(
    "i6_nested",
    f"""WITH {_INDEX}, m AS (SELECT id, max(dl) AS dl, max(CASE WHEN term = 'the' THEN tf ELSE 0 END) AS a,
          max(CASE WHEN term = 'les' THEN tf ELSE 0 END) AS b, max(CASE WHEN term = 'in' THEN tf ELSE 0 END) AS c,
          max(CASE WHEN term = 'with' THEN 1 ELSE 0 END) AS x, max(CASE WHEN term = 'for' THEN 1 ELSE 0 END) AS y FROM postings GROUP BY id),
        d AS (SELECT max(CASE WHEN term = 'the' THEN df END) AS da, max(CASE WHEN term = 'les' THEN df END) AS db,
          max(CASE WHEN term = 'in' THEN df END) AS dc FROM dfs)
        SELECT id, round({_bm25('a', 'da', 'dl')} + {_bm25('b', 'db', 'dl')} + {_bm25('c', 'dc', 'dl')}, 6) AS score
        FROM m, d WHERE (a > 0 OR b > 0) AND c > 0 AND NOT (x = 1 AND y = 1)""",
)
def i6c(spark, sf):
    """(the OR les) AND in, but not both with and for."""
    must = [S.any_of(S.term("the"), S.term("les")), S.term("in")]
    return rounded(S.matches(stored(spark, sf), must, must_not=[S.all_of(S.term("with"), S.term("for"))]))


@query(
    "o4_best_first",
    f"WITH {_INDEX}, {_words_sql(['la', 'que'])}, hits AS (SELECT * FROM scored WHERE found = 2) SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM hits ORDER BY score DESC, id LIMIT 50",
)
def o4(spark, sf):
    return rounded(S.ranked(S.matches(stored(spark, sf), must=S.words_clause("la que")), 50))


_BLOCKED: dict[tuple, str] = {}


def blocked(spark, sf) -> TK.Blocks:
    """The index in blocks, built once per application and state of the tables. Small blocks, since the tables are small."""
    key = _key(spark, sf)
    if key not in _BLOCKED:
        path = new_path(spark, "blocks")
        with dropping(spark):
            TK.write_blocks(S.build_index_once(docs(spark, sf)), path, buckets=8, block=50)
        _BLOCKED[key] = path
    return TK.Blocks(spark, _BLOCKED[key])


@query(
    "i11_block_max_top10",
    f"WITH {_INDEX}, {_words_sql(['in', 'the'])}, hits AS (SELECT * FROM scored WHERE found = 2) "
    + _TOP.format(hits="hits", limit=10, offset=0),
)
def i11b(spark, sf):
    return rounded(blocked(spark, sf).top("in the").rows)


@query(
    "o4_block_max_one_word",
    f"WITH {_INDEX}, {_words_sql(['que'])}, hits AS (SELECT * FROM scored) " + _TOP.format(hits="hits", limit=20, offset=10),
)
def o4b(spark, sf):
    return rounded(blocked(spark, sf).top("Que", limit=20, offset=10).rows)
