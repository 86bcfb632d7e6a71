"""Full-text search: an inverted index as tables, boolean retrieval, ranking and highlighting.

A posting carries the length of its document, so that scoring needs no join with the documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postmill.functions.text import BETWEEN_DIGITS, BETWEEN_LETTERS, DIGIT, LETTER, WORD, WORDS, format_text, replace_matches, tokens
from postmill.operators.ordering import numbered
from postmill.session import bounded_batches, durable

# fixed values: parameters of the ranking formula
K1 = 1.2
B = 0.75
TERM_BUCKETS = 64
BLOCK_TERMS = 1 << 16
_DICTIONARY = "bucket int, term string, df bigint, cf bigint, block bigint"

POSTING_COLUMNS = ["term", "id", "tf", "dl", "created_s", "positions"]


# ---- query clauses -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """A condition on single terms (`matches`), or a phrase of exact words."""

    label: str
    matches: Callable[[Column], Column]
    words: tuple[str, ...] = ()  # exact words: one for a term, several for a phrase
    boost: float = 1.0
    between: Callable[[str, str], bool] | None = None  # whether terms from the first to the second may match; None: any may


@dataclass(frozen=True)
class Group:
    """Clauses and groups of them: all of `must`, else any of `should`, and none of `must_not`."""

    must: tuple[Clause | Group, ...] = ()
    should: tuple[Clause | Group, ...] = ()
    must_not: tuple[Clause | Group, ...] = ()


def all_of(*parts: Clause | Group) -> Group:
    return Group(must=parts)


def any_of(*parts: Clause | Group) -> Group:
    return Group(should=parts)


_SHAPE = re.compile(f"(?:L+(?:{BETWEEN_LETTERS}L+)*|N+(?:{BETWEEN_DIGITS}N+)*|_+)+")


def query_words(text: str) -> list[str]:
    """The words of a text as the index has them."""
    lowered = text.lower()
    kinds = {"L": "L", "M": "L", "N": "N"}
    shape = "".join(kinds.get(unicodedata.category(c)[0], c) for c in lowered)
    return [lowered[m.start() : m.end()] for m in _SHAPE.finditer(shape)]


def term(word: str, boost: float = 1.0) -> Clause:
    """One word; text that the index splits into several is a phrase."""
    return phrase(word, boost)


def phrase(text: str, boost: float = 1.0) -> Clause:
    """Words next to each other. A phrase without words matches nothing."""
    words = tuple(query_words(text))
    if not words:
        return Clause("", lambda t: F.lit(False), (), boost)
    return Clause(" ".join(words), lambda t: t.isin(*words), words, boost)


def _starting(start: str) -> Callable[[str, str], bool]:
    return lambda a, b: b >= start and a[: len(start)] <= start


def near_between(word: str, distance: int, first: str, last: str) -> bool:
    """Whether some string from `first` to `last` may be within so many edits of `word`.

    Walks the edit-distance automaton along both ends. A branch strictly inside is free to go on as `word` does, so it is
    settled by the least number of edits so far, and at most two branches are followed on.
    """

    def step(row: list[int], char: str) -> list[int]:
        new = [row[0] + 1]
        for i, c in enumerate(word):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (c != char)))
        return new

    def walk(row: list[int], low: str | None, high: str | None) -> bool:
        low = low or None
        if min(row) > distance:
            return False
        if low is None and (high is None or row[-1] <= distance):
            return True
        if high == "":
            return False
        # "" stands for a character that is not in the word, where there is room for one inside
        other = [""] if not (low and high) or ord(high[0]) - ord(low[0]) > 1 else []
        for char in sorted({*word, *(low or "")[:1], *(high or "")[:1], *other}):
            if char and ((low and char < low[0]) or (high and char > high[0])):
                continue
            at_low, at_high = low if char and low and char == low[0] else None, high if char and high and char == high[0] else None
            if walk(step(row, char), at_low and at_low[1:], at_high and at_high[1:]):
                return True
        return False

    return walk(list(range(len(word) + 1)), first, last)


def prefix(start: str, boost: float = 1.0) -> Clause:
    start = start.lower()
    return Clause(start + "*", lambda t: t.startswith(start), (), boost, _starting(start))


def wildcard(pattern: str, boost: float = 1.0) -> Clause:
    """`*` stands for any run of characters, `?` for one."""
    pattern = pattern.lower()
    like = re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%").replace("?", "_")
    return Clause(pattern, lambda t: t.like(like), (), boost, _starting(re.split(r"[*?]", pattern)[0]))


def fuzzy(word: str, distance: int = 2, boost: float = 1.0) -> Clause:
    word = word.lower()
    return Clause(f"{word}~{distance}", lambda t: F.levenshtein(t, F.lit(word), distance) >= 0, (), boost, lambda a, b: near_between(word, distance, a, b))


def term_range(first: str, last: str, boost: float = 1.0) -> Clause:
    first, last = first.lower(), last.lower()
    return Clause(f"[{first} TO {last}]", lambda t: t.between(first, last), (), boost, lambda a, b: a <= last and b >= first)


def words_clause(text: str) -> list[Clause]:
    """All words of a plain query; joined by AND when passed as `must`."""
    return [term(w) for w in dict.fromkeys(query_words(text))]


# ---- index ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # id, created_s, dl
    postings: DataFrame  # term, id, tf, dl, created_s, positions
    buckets: int | None = None  # of a stored index
    terms: DataFrame | None = None  # bucket, term, df, cf, block: the dictionary of a stored index
    totals: DataFrame | None = None  # n, avg_dl: one row, of a stored index
    blocks: tuple[tuple[int, str, str], ...] = ()  # of the dictionary: number, first and last term of each


_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each row's array `words` by `terms`, one entry for each different word, in order. A row without an array gets one entry of nulls."""
    entry = pa.struct([("term", pa.string()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32()))])
    for batch in batches:
        words = batch.column("words")
        n = len(words)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten().cast(pa.string()).dictionary_encode()
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = pc.array_sort_indices(flat.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = row * max(len(order), 1) + rank[flat.indices.to_numpy()]
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(start, append=len(key))
        of, term = row[by][start], key[start] % max(len(order), 1)
        empty = np.flatnonzero(pc.is_null(words).to_numpy(zero_copy_only=False))
        if len(empty):
            at = np.searchsorted(of, empty)
            of, term, tf = np.insert(of, at, empty), np.insert(term, at, -1), np.insert(tf, at, 0)
        none = pa.array(term < 0)
        terms = flat.dictionary.take(pa.array(order)).take(pa.array(term, mask=term < 0))
        positions = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(place[by], pa.int32()), mask=none)
        entries = pa.StructArray.from_arrays([terms, pa.array(tf, pa.int64(), mask=term < 0), positions], fields=list(entry))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, entries)], names=[*batch.schema.names[:-1], "terms"])


def _with_terms(posts: DataFrame) -> DataFrame:
    """Each post with an array of `struct<term, tf, positions>`, one per distinct term.

    The tokens are grouped inside the row, by Arrow's arrays, so building the index needs no shuffle.
    """
    bounded_batches(posts.sparkSession)
    words = posts.select("id", F.unix_seconds("created").alias("created_s"), tokens(F.col("body")).alias("words"))
    words = words.select("id", "created_s", F.size("words").cast("bigint").alias("dl"), "words")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in words.schema.fields[:-1]] + [T.StructField("terms", T.ArrayType(_TERM))])
    return words.mapInArrow(_grouped, schema)


def _posting_rows(rows: DataFrame) -> DataFrame:
    # explode_outer, because for a plain explode the optimizer infers a non-empty filter and pushes
    # it below the row-local steps, repeating the whole tokenisation once more per reference to it
    each = rows.select("id", "dl", "created_s", F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
    return each.select("t.term", "id", "t.tf", "dl", "created_s", "t.positions")


def build_index(posts: DataFrame) -> Index:
    """Index of all posts, deleted ones included. Needs `id, created, body`."""
    rows = _with_terms(posts)
    docs = posts.select(
        "id", F.unix_seconds("created").alias("created_s"), F.size(tokens(F.col("body"))).cast("bigint").alias("dl")
    )
    postings = _posting_rows(rows)
    return Index(docs, postings)


def build_index_once(posts: DataFrame) -> Index:
    """The same index, with every body tokenised once: its terms are stored, and documents and postings derive from that."""
    rows = durable(_with_terms(posts))
    return Index(rows.select("id", "created_s", "dl"), _posting_rows(rows))


def term_bucket(t: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.hash(t), F.lit(buckets))


def write_index(index: Index, path: str, buckets: int = TERM_BUCKETS, block: int = BLOCK_TERMS) -> None:
    """Store the index: postings by term bucket, ordered by term and id, and a dictionary of its terms in blocks.

    A block has `block` terms that follow each other in code point order, so prefixes, ranges and most wildcards need few of them.

    Rows are dealt by bucket; adaptive execution splits large buckets, so a term found in most posts is spread over many
    tasks and files instead of landing in one, and how many there are follows the size of the data.
    """
    bucketed = index.postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
    (
        bucketed.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "id")
        .write.partitionBy("bucket")
        .mode("errorifexists")
        .parquet(f"{path}/postings")
    )
    spark = index.docs.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    dictionary = stored.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    placed = numbered(dictionary, ["term"], "place", 0).withColumn("block", F.floor(F.col("place") / block)).drop("place")
    placed.sortWithinPartitions("block", "term").write.partitionBy("block").mode("errorifexists").parquet(f"{path}/terms")
    ends = spark.read.schema(_DICTIONARY).parquet(f"{path}/terms").groupBy("block").agg(F.min("term").alias("first"), F.max("term").alias("last"))
    ends.coalesce(1).write.mode("errorifexists").parquet(f"{path}/blocks")
    index.docs.write.mode("errorifexists").parquet(f"{path}/docs")
    totals = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    totals.withColumn("buckets", F.lit(buckets)).write.mode("errorifexists").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index. The table of blocks comes to the driver: a row for each BLOCK_TERMS different terms."""
    meta = spark.read.parquet(f"{path}/meta")
    buckets = meta.first()["buckets"]
    terms = spark.read.schema(_DICTIONARY).parquet(f"{path}/terms")
    blocks = tuple(tuple(r) for r in spark.read.parquet(f"{path}/blocks").select("block", "first", "last").collect())
    docs, postings = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    return Index(docs, postings, buckets, terms, meta.select("n", "avg_dl"), blocks)


def dictionary_of(index: Index, words: list[str], sets: list[Clause] = ()) -> DataFrame:
    """Dictionary rows of exact words and of terms that set clauses accept, from the blocks that may have any of them."""
    t = F.col("term")
    test = t.isin(*words) if words else F.lit(False)
    for c in sets:
        test = test | c.matches(t)
    if not index.blocks or any(c.between is None for c in sets):
        return index.terms.where(test)
    wanted = [n for n, a, b in index.blocks if any(a <= w <= b for w in words) or any(c.between(a, b) for c in sets)]
    # the numbers of blocks prune the folders that are read
    return index.terms.where(F.col("block").isin(*wanted) if wanted else F.lit(False)).where(test)


def upsert_index(index: Index, changed_posts: DataFrame) -> Index:
    """The index after replacing the entries of the changed posts."""
    fresh = build_index(changed_posts)
    # stored, so that its size is known and a small one is broadcast before any posting is shuffled
    ids = durable(changed_posts.select("id").distinct())
    docs = index.docs.join(ids, "id", "left_anti").unionByName(fresh.docs)
    columns = POSTING_COLUMNS
    postings = (
        index.postings.join(ids, "id", "left_anti").select(*columns).unionByName(fresh.postings.select(*columns))
    )
    return Index(docs, postings)


# ---- statistics ----------------------------------------------------------------------------------


def term_stats(index: Index) -> DataFrame:
    """Document frequency and total frequency of each term; combined before the shuffle."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(index: Index) -> DataFrame:
    return index.docs.agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl"), F.avg("dl").alias("avg_dl"))


# ---- retrieval -----------------------------------------------------------------------------------


def _minus(offset: int) -> Callable[[Column], Column]:
    return lambda p: p - offset


def _phrase_frequency(columns: list[Column]) -> Column:
    """How often words stand next to each other, given the position arrays of each word in turn."""
    starts = columns[0]
    for offset, positions in enumerate(columns[1:], start=1):
        starts = F.array_intersect(starts, F.transform(positions, _minus(offset)))
    return F.size(starts).cast("bigint")


def _leaves(part: Clause | Group) -> list[Clause]:
    if isinstance(part, Clause):
        return [part]
    return [c for p in (*part.must, *part.should, *part.must_not) for c in _leaves(p)]


def _positive(part: Clause | Group) -> bool:
    """Whether a match needs a posting of one of its clauses."""
    return isinstance(part, Clause) or any(map(_positive, part.must)) or (not part.must and bool(part.should) and all(map(_positive, part.should)))


def _postings_of(index: Index, words: list[str], sets: list[Clause]) -> DataFrame:
    """Postings of exact words and of terms that set clauses accept."""
    t = F.col("term")
    test = t.isin(*words) if words else F.lit(False)
    for c in sets:
        test = test | c.matches(t)
    if index.buckets and not sets:
        # the bucket numbers fold to literals, which prune the stored index to the files of the words
        return index.postings.where(F.col("bucket").isin(*[term_bucket(F.lit(w), index.buckets) for w in words])).where(test)
    if index.terms is None:
        return index.postings.where(test)
    # the dictionary tells which terms are meant; only their postings are read on. They are stored, so that their size
    # is known and few terms are broadcast instead of shuffling every posting
    meant = durable(dictionary_of(index, words, sets).select("bucket", "term"))
    return index.postings.join(meant, ["bucket", "term"], "left_semi")


def matches(
    index: Index,
    must: list[Clause | Group] = (),
    should: list[Clause | Group] = (),
    must_not: list[Clause | Group] = (),
    since_s: int | None = None,
) -> DataFrame:
    """Posts matching the clauses, as `id, score`; parts may be groups of clauses.

    One aggregation by post over the postings of the query's terms decides everything: a slot per
    exact word, a flag per set of terms (prefix, wildcard, fuzzy, range). Words and phrases score
    by BM25, sets of terms score their boost. Parts that must not match score nothing.
    """
    query = Group(tuple(must), tuple(should), tuple(must_not))
    if not _positive(query):
        raise ValueError("a query needs a clause that can match")
    clauses = list(dict.fromkeys(_leaves(query)))
    t = F.col("term")
    words = list(dict.fromkeys(w for c in clauses for w in c.words))
    in_phrase = {w for c in clauses if len(c.words) > 1 for w in c.words}
    word_slot = {w: i for i, w in enumerate(words)}
    sets = [c for c in clauses if not c.words]
    hits = _postings_of(index, words, sets)
    if since_s is not None:
        hits = hits.where(F.col("created_s") >= since_s)

    aggs = [F.max("dl").alias("dl")]
    for w, i in word_slot.items():
        aggs.append(F.max(F.when(t == w, F.col("tf"))).alias(f"tf{i}"))
        if w in in_phrase:
            aggs.append(F.max(F.when(t == w, F.col("positions"))).alias(f"pos{i}"))
    for i, c in enumerate(sets):
        aggs.append(F.max(c.matches(t)).alias(f"set{i}"))
    slots = hits.groupBy("id").agg(*aggs)

    totals = index.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")) if index.totals is None else index.totals
    slots = slots.withColumn("stats", totals.agg(F.struct(F.max("n").alias("n"), F.max("avg_dl").alias("avg_dl")).alias("s")).scalar())
    if words:
        if index.terms is None:
            counted = index.postings.where(t.isin(*words)).select("term", F.lit(1).alias("df"))
        else:
            counted = dictionary_of(index, words).select("term", "df")
        df_row = counted.agg(
            F.struct(*[F.sum(F.when(t == w, F.col("df")).otherwise(0)).alias(f"df{i}") for w, i in word_slot.items()]).alias("d")
        )
        slots = slots.withColumn("dfs", df_row.scalar())

    def frequency(c: Clause) -> Column:
        if len(c.words) == 1:
            return F.coalesce(F.col(f"tf{word_slot[c.words[0]]}"), F.lit(0))
        return F.coalesce(_phrase_frequency([F.col(f"pos{word_slot[w]}") for w in c.words]), F.lit(0))

    def idf(word: str) -> Column:
        df = F.col(f"dfs.df{word_slot[word]}")
        return F.log(1 + (F.col("stats.n") - df + 0.5) / (df + 0.5))

    prepared, flags, scores = slots, {}, {}
    for i, c in enumerate(clauses):
        if c.words:
            prepared = prepared.withColumn(f"f{i}", frequency(c))
            f = F.col(f"f{i}")
            flags[c] = f > 0
            weight = idf(c.words[0])
            for w in c.words[1:]:
                weight = weight + idf(w)
            norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("stats.avg_dl"))
            scores[c] = F.lit(c.boost) * weight * f / (f + norm)
        else:
            flags[c] = F.col(f"set{sets.index(c)}")
            scores[c] = F.when(flags[c], F.lit(c.boost)).otherwise(0.0)

    def flag(part: Clause | Group) -> Column:
        if isinstance(part, Clause):
            return flags[part]
        test = F.lit(True)
        for p in part.must:
            test = test & flag(p)
        if part.should and not part.must:
            some = F.lit(False)
            for p in part.should:
                some = some | flag(p)
            test = test & some
        for p in part.must_not:
            test = test & ~flag(p)
        return test

    def score(part: Clause | Group) -> Column:
        if isinstance(part, Clause):
            return scores[part]
        total = F.lit(0.0)
        for p in (*part.must, *part.should):
            # a group counts only where it matches
            total = total + (score(p) if isinstance(p, Clause) else F.when(flag(p), score(p)).otherwise(0.0))
        return total

    return prepared.where(flag(query)).select("id", score(query).alias("score"))


def ranked(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of matches, best first, ties by id: `rank, id, score`. Only the page is numbered."""
    order = [F.desc("score"), F.asc("id")]
    page = found.orderBy(*order).offset(offset).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)) + offset
    return page.withColumn("rank", rank.cast("bigint"))


def result_page(index: Index, posts: DataFrame, q: str, page: int, size: int) -> DataFrame:
    """What the search page shows: `rank, total, id, html`, for all words of a text as typed.

    A text without words finds nothing.
    """
    clauses = words_clause("".join(c for c in q if c not in "!*?"))
    if not clauses:
        nothing = posts.limit(0)
        return nothing.select(F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("total"), "id", F.col("body").alias("html"))
    found = search(index, must=clauses, limit=size, offset=size * (page - 1))
    body = highlight(F.col("body"), clauses)
    text = F.concat(F.lit('<span class="post_author">'), F.col("author"), F.lit(": </span>"), body)
    hits = found.join(posts, "id").withColumn("text", text)
    return hits.select("rank", "total", "id", format_text(F.col("text")).alias("html"))


def search(index: Index, must=(), should=(), must_not=(), limit: int = 10, offset: int = 0) -> DataFrame:
    """`rank, id, score, total`: the best matches and the exact number of all."""
    found = matches(index, must, should, must_not)
    total = found.agg(F.count("*").alias("total")).scalar()
    return ranked(found, limit, offset).withColumn("total", total)


# ---- highlighting --------------------------------------------------------------------------------


def _alone(word: str) -> str:
    """Pattern of a word that is no part of a longer one."""

    def joined(end: str) -> tuple[str, str]:
        kind = unicodedata.category(end)[0]
        return (LETTER, BETWEEN_LETTERS) if kind in "LM" else (DIGIT, BETWEEN_DIGITS) if kind == "N" else ("(?!)", "")

    (before, left), (after, right) = joined(word[0]), joined(word[-1])
    return f"(?<!{WORD})(?<!{before}{left}){re.escape(word)}(?!{WORD})(?!{right}{after})"


def highlight(body: Column, clauses: list[Clause]) -> Column:
    """Body with `<em>` around each word a clause matches, null when there is none. Words of a phrase
    are marked only where the phrase stands."""
    if all(len(c.words) == 1 for c in clauses):
        # exact words only: look for these, and check each candidate the way the index folds case
        words = [c.words[0] for c in clauses]
        candidates = f"(?iu)(?:{'|'.join(map(_alone, words))})"
        marked = replace_matches(
            body, candidates, lambda m: F.when(F.lower(m).isin(words), F.concat(F.lit("<em>"), m, F.lit("</em>"))).otherwise(m)
        )
        return F.nullif(marked, body)
    singles = [c for c in clauses if len(c.words) < 2]
    phrases = [c for c in clauses if len(c.words) > 1]

    def hit(lowered: Column, w: Column, i: Column) -> Column:
        test = F.lit(False)
        for c in singles:
            test = test | c.matches(F.lower(w))
        for c in phrases:
            whole = F.array(*[F.lit(x) for x in c.words])
            for k in range(len(c.words)):
                at = i - k
                test = test | ((at >= 0) & (F.slice(lowered, F.greatest(at, F.lit(0)) + 1, len(c.words)) == whole))
        return test

    def mark(words: Column) -> Column:
        lowered = F.transform(words, F.lower) if phrases else words
        return F.transform(
            words, lambda w, i: F.when(hit(lowered, w, i), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w)
        )

    gaps = F.split(body, WORDS, -1)
    found = F.regexp_extract_all(body, F.lit(WORDS), F.lit(0))
    marked = F.transform(F.array(found), mark)[0]
    joined = F.array_join(F.zip_with(gaps, marked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(joined != body, joined)


def fragment(body: Column, first: Column, last: Column) -> Column:
    """The text from word `first` to word `last`, both counted from 0, with all that stands between."""
    gaps = F.split(body, WORDS, -1)
    words = F.regexp_extract_all(body, F.lit(WORDS), F.lit(0))
    between = F.concat(F.array(F.lit("")), F.slice(gaps, first + 2, F.greatest(last - first, F.lit(0))))
    return F.array_join(F.zip_with(between, F.slice(words, first + 1, last - first + 1), lambda gap, word: F.concat(gap, word)), "")


def best_fragments(index: Index, found: DataFrame, text: str, size: int = 40) -> DataFrame:
    """`id, first, last, weight` for each post of `found`: its best run of at most `size` words that starts with a word of `text`.

    A run weighs the rarity of each different word of `text` that it has. Among equals, the one with more of them
    in all, then the earliest. Positions come from the postings of these words: no body is read. Posts without any of them have no row.
    """
    words = list(dict.fromkeys(query_words(text)))
    if not words:
        return found.limit(0).select("id", *[F.lit(0).cast("int").alias(c) for c in ("first", "last")], F.lit(0.0).alias("weight"))
    own = _postings_of(index, words, []).select("id", "term", "dl", "positions").join(found.select("id").distinct(), "id", "left_semi")
    hits = own.select("id", "term", "dl", F.explode("positions").alias("pos"))
    run = Window.partitionBy("id").orderBy("pos").rangeBetween(0, size - 1)
    t = F.col("term")
    counted = index.postings.select("term", F.lit(1).alias("df")) if index.terms is None else dictionary_of(index, words).select("term", "df")
    sums = [F.sum(F.when(t == w, F.col("df")).otherwise(0)).alias(f"df{i}") for i, w in enumerate(words)]
    dfs = counted.where(t.isin(*words)).agg(F.struct(*sums).alias("d")).scalar()
    n = (index.docs.agg(F.count("*").alias("n")) if index.totals is None else index.totals.agg(F.max("n").alias("n"))).scalar()
    seen = [F.max(F.when(t == w, 1)).over(run).alias(f"has{i}") for i, w in enumerate(words)]
    runs = hits.select("id", "dl", "pos", F.count("*").over(run).alias("hits"), *seen).withColumns({"dfs": dfs, "n": n})
    weight = F.lit(0.0)
    for i in range(len(words)):
        df = F.col(f"dfs.df{i}")
        weight = weight + F.when(F.col(f"has{i}") == 1, F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))).otherwise(0.0)
    runs = runs.select("id", "dl", "pos", "hits", weight.alias("weight"))
    order = F.struct("weight", "hits", -F.col("pos"))
    best = runs.groupBy("id").agg(F.max("dl").alias("dl"), F.max(order).alias("best"))
    first = (-F.col("best.col3")).cast("int")
    return best.select("id", first.alias("first"), F.least(first + size, F.col("dl")).cast("int").alias("end"), F.col("best.weight").alias("weight")).select(
        "id", "first", (F.col("end") - 1).alias("last"), "weight"
    )
