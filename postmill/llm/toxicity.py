"""Toxicity by two class-conditional Kneser-Ney models with a shared backoff.

Toxic and ordinary texts each have a bigram model of words. Both orders count the different words before: a pair or a word
that copies of one text repeat weighs little. Below that both classes back off to the same continuation counts
of all learned texts, and those to a uniform share, so a rare expression looks alike to both. Discounts
follow from the counts of counts, and differ for counts of 1, 2 and 3 or more.

A text is judged by the difference of its two log-likelihoods, divided by the number of words: over the whole text and over its most
toxic run of 1, 4 and 16 words, since a few words make a long text toxic. A logistic curve over these four and the logarithm
of the number of words gives the score; it is fitted on differences that models without the text's own part
of the sample give.

`learn_all` counts all labelled texts, as Spark jobs: words in context are shuffled by pair, and both models, also those that leave out
a part, come from one table of pairs. `learn` does the same in one process on a bounded sample (TOXIC, ORDINARY and LONGEST below;
different texts are drawn by their hash, each once).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.hashing import kept, mix, range_hash
from postmill.llm.rows import Scratch, bounded_batches, computed

U64 = np.uint64
#: Expected rows and bytes of text that are drawn of each class at most; texts over LONGEST bytes are not learned from.
TOXIC, ORDINARY = (1_200, 4 << 20), (3_500, 12 << 20)
LONGEST = 1 << 20
PARTS = 4
TURNS = 3  # in which texts and words in context are shuffled
RUNS = (1, 4, 16)
THRESHOLD = 0.3
LEAST_PREVIOUS = 5  # words with fewer different words before them, over both classes, count as unknown
LEAST_PAIR = 10  # pairs behind fewer different words are left to the lower order
SHORT = 24  # bits that `learn_all` leaves off a word's key, so that a word and the two before it fit two longs
FILE, BLOCK = 1 << 16, 16  # rows of a stored model in a file, at most on average; files that are looked through at once
HELD = 64 << 20  # bytes of a stored model that a worker keeps; the rest is read again for every GATHERED bytes of texts
GATHERED = 12 << 20
CHUNK = 1 << 20  # words whose contexts a task makes distinct at once
_START = U64(0x5BD1E995)  # stands before a text's first word
_DRAWS = 1 << 30
_SIGN = U64(1 << 63)  # stored keys are signed numbers in the same order

_LETTER = np.zeros(256, np.uint8)
for _b in range(26):
    _LETTER[65 + _b] = _LETTER[97 + _b] = 97 + _b
_LETTER[128:] = np.arange(128, 256)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of every word of the texts, and where each text's words start and end.

    Words are runs of letters, A-Z in lower case, and of characters beyond ASCII.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    low = _LETTER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    edge = np.diff((low > 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = range_hash(31)
    keys = mix(hashes.ranges(hashes.prefix(low), start, end)) | U64(1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return keys, np.searchsorted(start, np.concatenate([[0], ends]))


def pairs(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word together with the word before it in its text, and that word's key."""
    before = np.full(len(keys), _START)
    before[1:] = keys[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = _START
    return mix(before * U64(0x9E3779B97F4A7C15) + keys), before


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and 3 or more, from the counts of counts."""
    return discounts_of(np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float))


def discounts_of(n) -> np.ndarray:
    """The same from the numbers of counts of 1 to 4."""
    share = n[0] / max(n[0] + 2 * n[1], 1)
    own = [k - (k + 1) * share * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(own, [0.1, 0.2, 0.3], [0.95, 1.9, 2.8])])


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, len(table) where it is not in there."""
    at = np.searchsorted(table, keys)
    inside = np.minimum(at, max(len(table) - 1, 0))
    return np.where(table[inside] == keys, inside, len(table)) if len(table) else np.zeros(len(keys), int)


@dataclass
class Model:
    """Log-likelihood ratios, toxic over ordinary; each array ends with the entry for what is not in its table."""

    words: np.ndarray
    lower: np.ndarray  # of a word without regard to the one before
    backoff: np.ndarray  # of the share that a word, as the one before, leaves to the lower order
    pairs: np.ndarray
    higher: np.ndarray  # of a pair's second word
    short: int = 0  # bits left off the keys of words
    gathered = 0  # bytes of texts to be judged at once, at least

    def ratios(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        keys = keys >> U64(self.short)
        pair, before = pairs(keys, bounds)
        at = find(self.pairs, pair)
        backed = self.backoff[find(self.words, before)] + self.lower[find(self.words, keys)]
        return np.where(at < len(self.pairs), self.higher[at], backed)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), unquote(urlparse(path).path)
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _arrays(files: list[str], columns: list[str]) -> list[np.ndarray]:
    """Columns of files one behind the other; the first is the key, ascending."""
    parts = []
    for file in files:
        store, path = _file_system(file)
        with store.open_input_file(path) as f:
            parts.append(pq.ParquetFile(f).read(columns, use_threads=False))
    table = pa.concat_tables(parts) if parts else pa.table({c: [] for c in columns})
    return _columns(table.column(c).to_numpy() for c in columns)


def _columns(values) -> list[np.ndarray]:
    key, *values = values
    return [key.astype(np.int64).view(U64) ^ _SIGN, *(v.astype(np.float32) for v in values)]


_COLUMNS = {"words": ["key", "lower", "backoff"], "pairs": ["key", "higher"]}


class _Held:
    """The blocks of one stored model that a worker keeps, up to HELD bytes."""

    def __init__(self):
        self.of, self.blocks, self.size = None, {}, 0

    def block(self, model: Stored, name: str, at: int) -> list[np.ndarray]:
        if self.of != (of := (model.files["words"][:1], model.files["pairs"][:1])):
            self.of, self.blocks, self.size = of, {}, 0
        if (name, at) in self.blocks:
            return self.blocks[name, at]
        arrays = _arrays(model.files[name][at : at + BLOCK], _COLUMNS[name])
        size = sum(a.nbytes for a in arrays)
        if self.size + size <= HELD:
            self.blocks[name, at] = arrays
            self.size += size
        return arrays


@dataclass
class Stored:
    """A model of any size in files, which the tasks that judge read from the shared folder. A task holds HELD bytes and one block of it at most."""

    files: dict[str, list[str]]  # of `words` and `pairs`, in order of their keys
    size: int  # bytes of both tables in memory
    rare: float  # `lower` of a word that is not in the table
    short: int

    @property
    def gathered(self) -> int:
        return 0 if self.size <= HELD else GATHERED

    def _found(self, name: str, keys: np.ndarray, missing: list[float]) -> list[np.ndarray]:
        """What the table has for each key, `missing` where it has nothing."""
        out = [np.full(len(keys), m, np.float32) for m in missing]
        files = self.files[name]
        order = np.argsort(keys) if len(files) > BLOCK else None
        asked = keys if order is None else keys[order]
        held = kept("toxicity model", _Held)
        for i in range(0, len(files), BLOCK):
            table, *values = held.block(self, name, i)
            if not len(table):
                continue
            a, b = (0, len(keys)) if order is None else (np.searchsorted(asked, table[0]), np.searchsorted(asked, table[-1], "right"))
            at = find(table, asked[a:b])
            hit = np.flatnonzero(at < len(table))
            place = hit if order is None else order[a:b][hit]
            for o, v in zip(out, values, strict=True):
                o[place] = v[at[hit]]
        return out

    def ratios(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        keys = keys >> U64(self.short)
        pair, _ = pairs(keys, bounds)
        lower, backoff = self._found("words", np.append(keys, _START) << U64(self.short), [self.rare, 0.0])
        before = np.arange(-1, len(keys) - 1)  # the last entry is that of the start
        before[bounds[:-1][bounds[:-1] < bounds[1:]]] = -1
        (higher,) = self._found("pairs", pair, [np.nan])
        return np.where(np.isnan(higher), backoff[before] + lower[:-1], higher)

    def whole(self, read: Callable = _arrays) -> Model:
        """The model in memory, for a small one."""
        (word, lower, backoff), (pair, higher) = (read(self.files[n], _COLUMNS[n]) for n in ("words", "pairs"))
        last = lambda x, y: np.append(x, y).astype(np.float32)
        return Model(word >> U64(self.short), last(lower, self.rare), last(backoff, 0), pair, last(higher, 0), self.short)

    words = property(lambda self: self.whole().words)
    lower = property(lambda self: self.whole().lower)
    backoff = property(lambda self: self.whole().backoff)
    pairs = property(lambda self: self.whole().pairs)
    higher = property(lambda self: self.whole().higher)


def fit(keys: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> Model:
    """The two models of texts with those words, of which the ones marked `toxic` make one class."""
    pair, before = pairs(keys, bounds)
    of = np.repeat(toxic.astype(np.int8), np.diff(bounds))
    # the word before the pair: a pair counts once for each different one
    ahead = np.full(len(keys), _START)
    ahead[1:] = before[:-1]
    ahead[before == _START] = U64(0)
    _, one = np.unique(mix(pair + ahead * U64(0xC2B2AE3D27D4EB4F)) ^ of.astype(U64), return_index=True)
    pair, before, word, of = pair[one], before[one], keys[one], of[one]
    order = np.lexsort((of, pair))
    pair, before, word, of = pair[order], before[order], word[order], of[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(pair)))
    pair, before, word, of = pair[at], before[at], word[at], of[at]
    kinds = np.ones(len(pair), bool)
    kinds[1:] = pair[1:] != pair[:-1]

    vocabulary, number = np.unique(word, return_inverse=True)
    size = len(vocabulary)
    shared = np.bincount(number[kinds], minlength=size)  # different words before, in either class
    share = 0.75 * size / max(shared.sum(), 1)
    base = np.append(np.maximum(shared - 0.75, 0) / max(shared.sum(), 1), 0) + share / (size + 1)
    known = np.flatnonzero(shared >= LEAST_PREVIOUS)
    contexts, context = np.unique(before, return_inverse=True)
    lower, left, own = [], [], []
    for c in (0, 1):
        mine = of == c
        counts = np.bincount(number[mine], minlength=size)
        off = np.append(discounts(counts)[np.minimum(counts, 3)], 0)
        total = max(counts.sum(), 1)
        rest = off.sum() / total if counts.any() else 1.0
        lower.append((np.append(counts, 0) - off) / total + rest * base)
        off = discounts(times[mine])[np.minimum(times[mine], 3)]
        uses = np.bincount(context[mine], weights=times[mine], minlength=len(contexts))
        taken = np.bincount(context[mine], weights=off, minlength=len(contexts))
        left.append(np.where(uses > 0, taken / np.maximum(uses, 1), 1.0))
        rows = np.zeros(len(pair))
        rows[mine] = (times[mine] - off) / uses[context[mine]]
        own.append(rows)

    met = np.add.reduceat(times, np.flatnonzero(kinds)) if len(times) else times
    heads = np.flatnonzero(kinds)
    heads = heads[met >= LEAST_PAIR]
    both = np.minimum(heads + 1, len(pair) - 1)
    both = np.where((both > heads) & (pair[both] == pair[heads]), both, heads) if len(heads) else heads
    higher = []
    for c in (0, 1):
        direct = np.maximum(own[c][heads], own[c][both])  # one of the two rows is of the class
        higher.append(direct + left[c][context[heads]] * lower[c][number[heads]])
    log = lambda x: np.log(x[1] / x[0])
    ratio = log(left)
    place = find(contexts, vocabulary[known])
    backoff = np.where(place < len(contexts), np.append(ratio, 0)[place], 0.0)
    return Model(
        vocabulary[known],
        np.append(log(lower)[known], log(lower)[-1]).astype(np.float32),
        np.append(backoff, 0).astype(np.float32),
        pair[heads],
        np.append(log(higher), 0).astype(np.float32),
    )


def features(model: Model | Stored, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean ratio of each text's most toxic run of each length, of the whole text, and the log of its number of words."""
    ratio = model.ratios(keys, bounds).astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    n = np.diff(bounds)
    some = np.flatnonzero(n > 0)
    whole = np.zeros(len(n))
    whole[some] = (total[bounds[1:][some]] - total[bounds[:-1][some]]) / n[some]
    out = []
    for run in RUNS:
        best = whole.copy()
        long = np.flatnonzero(n >= run)
        if len(long):
            # runs that start in one text and end in the next are masked
            means = (total[run:] - total[:-run]) / run
            starts, ends = bounds[:-1][long], bounds[1:][long] - run + 1
            cuts = np.empty(2 * len(long), int)
            cuts[::2], cuts[1::2] = starts, ends
            means = np.append(means, -np.inf)
            best[long] = np.maximum.reduceat(means, cuts)[::2]
        out.append(best)
    return np.stack([*out, whole, np.log1p(n)], axis=1)


@dataclass
class Judge:
    model: Model | Stored | None
    weights: np.ndarray  # of the features, then the intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), float(self.weights[-1]))
        keys, bounds = words(texts)
        x = features(self.model, keys, bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method on standardised columns; the last one is the intercept."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (weight * (p - y)) + penalty * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ mean)


def trained(keys: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rate: float) -> Judge:
    """`rate` is the share of toxic texts among all that could be learned from."""
    if not toxic.any() or toxic.all():
        return Judge(None, np.array([rate]))
    n = np.diff(bounds)
    # every class is dealt evenly over the parts
    part = np.empty(len(toxic), int)
    for c in (False, True):
        part[toxic == c] = np.arange((toxic == c).sum()) % PARTS
    x = np.zeros((len(toxic), len(RUNS) + 2))
    for p in range(PARTS):
        inside = np.repeat(part != p, n)
        rest = fit(keys[inside], np.concatenate([[0], np.cumsum(n[part != p])]), toxic[part != p])
        outside = np.concatenate([[0], np.cumsum(n[part == p])])
        x[part == p] = features(rest, keys[~inside], outside)
    weight = np.where(toxic, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    return Judge(fit(keys, bounds, toxic), logistic(x, toxic.astype(float), weight))


def _word_keys(frames):
    for frame in frames:
        keys, bounds = words(list(frame["text"]))
        parts = [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pd.DataFrame({"key": frame["key"], "toxic": frame["toxic"], "words": parts})


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Judge:
    """A judge from the documents that `labels` (doc_id, toxic) marks 0 or 1 and for which `may_learn`, over doc_id, holds.

    Rows without an id, text or label are not learned from. A text that comes several times counts once, as toxic if half
    of its labels say so. Which texts are drawn depends on their hashes and on the numbers of different texts and
    bytes of each class, counted over all rows.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.select(labels["doc_id"].alias("id_"), labels["toxic"].alias("toxic_")).where("toxic_ IN (0, 1)")
    marks = marks.groupBy("id_").agg(F.sum("toxic_").alias("yes"), F.count("*").alias("all"))
    rows = docs.where(may_learn).select(docs["doc_id"].alias("id_"), docs["text"].alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("size", F.octet_length("text")).where(F.col("size") <= LONGEST)
    key = F.xxhash64("text")
    found = rows.select("id_", key.alias("key"), "size").join(marks, "id_")
    texts = found.groupBy("key").agg((2 * F.sum("yes") >= F.sum("all")).cast("int").alias("toxic"), F.max("size").alias("size"))
    held = {r.toxic: (r.n, r.size) for r in texts.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    total = sum(n for n, _ in held.values())
    if not total:
        return Judge(None, np.array([0.0]))

    def share(kind: int, bound: tuple[int, int]) -> int:
        n, size = held.get(kind, (1, 1))
        return int(_DRAWS * min(1.0, bound[0] / max(n, 1), bound[1] / max(size, 1)))

    drawn = F.pmod(F.xxhash64("key", F.lit("drawn")), F.lit(_DRAWS))
    chosen = texts.where(drawn < F.when(F.col("toxic") == 1, share(1, TOXIC)).otherwise(share(0, ORDINARY))).select("key", "toxic")
    # bounded by the rows of TOXIC and ORDINARY
    whole = rows.select(key.alias("key"), "text").join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = whole.mapInPandas(_word_keys, "key long, toxic int, words binary").toPandas().sort_values("key", kind="stable")
    keys = np.frombuffer(b"".join(sample["words"]), U64)
    bounds = np.concatenate([[0], np.cumsum([len(w) // 8 for w in sample["words"]])]).astype(int)
    return trained(keys, bounds, sample["toxic"].to_numpy() == 1, held.get(1, (0, 0))[0] / total)


_FEATURES = [f"x{i}" for i in range(len(RUNS) + 2)]


def _contexts(frames, turn: int):
    """Each different word with the two before it, as two longs: the word before and the word's low bits; its high bits, the one before that, and the tag.

    Only words whose key gives `turn` modulo TURNS.
    """

    def distinct(parts):
        first, second = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return pd.DataFrame({"first": first[new].view(np.int64), "second": second[new].view(np.int64)})

    held, size = [], 0
    for frame in frames:
        keys, bounds = words(list(frame["text"]))
        keys = keys >> U64(SHORT)
        _, before = pairs(keys, bounds)
        ahead = np.full(len(keys), _START)
        ahead[1:] = before[:-1]
        ahead[before == _START] = U64(0)
        tag = np.repeat(frame["tag"].to_numpy().astype(U64), np.diff(bounds))
        mine = keys % U64(TURNS) == U64(turn)
        keys, before, ahead, tag = keys[mine], before[mine], ahead[mine], tag[mine]
        first = before << U64(24) | keys & U64(0xFFFFFF)
        held.append((first, (keys >> U64(24)) << U64(43) | ahead << U64(3) | tag))
        size += len(keys)
        if size >= CHUNK:
            yield distinct(held)
            held, size = [], 0
    if held:
        yield distinct(held)


def _times(tagged: DataFrame, turn: int) -> DataFrame:
    """`before, word` of every pair and, in `t<class>_<m>`, the number of different words before it: m leaves out that part, PARTS none.

    `tagged` has `text` and `tag`, the class times PARTS plus the part. One shuffle, by the pair's first long, serves both steps. A turn
    has the pairs whose word belongs to it.
    """
    rows = tagged.mapInPandas(lambda frames: _contexts(frames, turn), "first long, second long").repartition("first")
    place = F.shiftrightunsigned("second", 3)
    met = rows.groupBy("first", place.alias("place")).agg(F.expr("bit_or(shiftleft(1, cast(second & 7 as int)))").alias("tags"))
    columns = []
    for c in (0, 1):
        for m in range(PARTS + 1):
            mask = sum(1 << (c * PARTS + p) for p in range(PARTS) if p != m)
            columns.append(F.count_if(F.col("tags").bitwiseAND(mask) != 0).cast("int").alias(f"t{c}_{m}"))
    found = met.groupBy("first", F.shiftrightunsigned("place", 40).alias("high")).agg(*columns)
    word = F.col("first").bitwiseAND(0xFFFFFF) + F.shiftleft("high", 24)
    return found.select(F.shiftrightunsigned("first", 24).alias("before"), word.alias("word"), *[f"t{c}_{m}" for c in (0, 1) for m in range(PARTS + 1)])


def _pick(count: Column, values: np.ndarray) -> Column:
    """The entry of `values` for a count of 0, 1, 2 and 3 or more."""
    return F.when(count == 0, 0.0).when(count == 1, float(values[1])).when(count == 2, float(values[2])).otherwise(float(values[3]))


def _pair_keys(frames):
    for frame in frames:
        key = mix(frame["before"].to_numpy().astype(U64) * U64(0x9E3779B97F4A7C15) + frame["word"].to_numpy().astype(U64))
        yield pd.DataFrame({"key": (key ^ _SIGN).view(np.int64), "higher": frame["higher"].astype(np.float32)})


def _in_files(rows: DataFrame, n: int, scratch: Scratch, name: str) -> list[str]:
    """Stores about `n` rows by ranges of `key`, whose values are spread evenly; the files in order."""
    bits = max(0, (n - 1) // FILE).bit_length()
    place = F.shiftright("key", 64 - bits) + (1 << bits >> 1) if bits else F.lit(0)
    stored = scratch.keep(rows.repartitionById(1 << bits, place.cast("int")).sortWithinPartitions("key"), name)
    return sorted(stored.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])


def fit_counts(counted: DataFrame, scratch: Scratch, name: str = "model") -> Stored:
    """What `fit` makes of the same texts, with keys without SHORT bits, from a table `before, word, t0, t1` of the pairs of both classes.

    The model is stored as `<name>_words` and `<name>_pairs` of `scratch`, with all words behind LEAST_PREVIOUS and all pairs behind
    LEAST_PAIR different words, however many they are.
    """
    counted = counted.where("t0 + t1 > 0")
    t = [F.col("t0"), F.col("t1")]
    own = [F.count_if(t[c] > 0).alias(f"n{c}") for c in (0, 1)]
    vocabulary = scratch.keep(counted.groupBy("word").agg(F.count("*").alias("shared"), *own), "vocabulary")
    uses = [f(t[c]).alias(f"{n}{c}") for c in (0, 1) for n, f in (("u", F.sum), ("a", lambda x: F.count_if(x == 1)), ("b", lambda x: F.count_if(x == 2)), ("d", lambda x: F.count_if(x > 2)))]
    contexts = scratch.keep(counted.groupBy("before").agg(*uses), "contexts")
    is_kept, is_known = t[0] + t[1] >= LEAST_PAIR, F.col("shared") >= LEAST_PREVIOUS
    few = counted.agg(F.count_if(is_kept).alias("kept"), *[F.count_if(t[c] == k).alias(f"c{c}_{k}") for c in (0, 1) for k in range(1, 5)]).first()
    n = [F.col("n0"), F.col("n1")]
    sums = [x for c in (0, 1) for x in (F.sum(n[c]).alias(f"all{c}"), F.count_if(n[c] > 2).alias(f"more{c}"), *[F.count_if(n[c] == k).alias(f"c{c}_{k}") for k in range(1, 5)])]
    of = vocabulary.agg(F.count("*").alias("size"), F.sum("shared").alias("shared"), F.count_if(is_known).alias("known"), *sums).first()
    if not of["size"]:
        scratch.drop("vocabulary", "contexts")
        return Stored({"words": [], "pairs": []}, 0, 0.0, SHORT)
    share = 0.75 * of["size"] / of["shared"]
    flat = share / (of["size"] + 1)
    base = F.greatest(F.col("shared") - 0.75, F.lit(0.0)) / float(of["shared"]) + flat
    lower, rare, left, higher = [], [], [], []
    for c in (0, 1):
        off = discounts_of(np.array([of[f"c{c}_{k}"] for k in range(1, 5)], float))
        total = max(of[f"all{c}"], 1)
        rest = float(off[1] * of[f"c{c}_1"] + off[2] * of[f"c{c}_2"] + off[3] * of[f"more{c}"]) / total if of[f"all{c}"] else 1.0
        lower.append((n[c] - _pick(n[c], off)) / float(total) + rest * base)
        rare.append(rest * flat)
        off = discounts_of(np.array([few[f"c{c}_{k}"] for k in range(1, 5)], float))
        taken = float(off[1]) * F.col(f"a{c}") + float(off[2]) * F.col(f"b{c}") + float(off[3]) * F.col(f"d{c}")
        left.append(F.when(F.col(f"u{c}") > 0, taken / F.col(f"u{c}")).otherwise(1.0))
        direct = F.when(t[c] > 0, (t[c] - _pick(t[c], off)) / F.col(f"u{c}")).otherwise(0.0)
        higher.append(direct + left[c] * lower[c])
    # tables of the vocabulary's size are not to be broadcast, which takes them through the driver
    known = vocabulary.where(is_known).join(contexts.withColumnRenamed("before", "word").hint("merge"), "word", "left")
    ratio = F.ln(lower[1] / lower[0]).cast("float").alias("lower"), F.coalesce(F.ln(left[1] / left[0]), F.lit(0.0)).cast("float").alias("backoff")
    spread = F.shiftleft("word", SHORT).bitwiseXOR(F.lit(-(1 << 63))).alias("key")
    kept_pairs = counted.where(is_kept).join(vocabulary.hint("merge"), "word").join(contexts.hint("merge"), "before")
    kept_pairs = kept_pairs.select("before", "word", F.ln(higher[1] / higher[0]).alias("higher")).mapInPandas(_pair_keys, "key long, higher float")
    files = {"words": _in_files(known.select(spread, *ratio), of["known"], scratch, f"{name}_words"), "pairs": _in_files(kept_pairs, few["kept"], scratch, f"{name}_pairs")}
    scratch.drop("vocabulary", "contexts")
    model = Stored(files, 16 * of["known"] + 12 * few["kept"], float(np.log(rare[1] / rare[0])), SHORT)
    try:
        for file in [*files["words"], *files["pairs"]][:1]:
            _file_system(file)
    except (pa.ArrowException, OSError, ImportError):
        # the shared folder is in a store that Python cannot open, so Spark hands the model out
        read = counted.sparkSession.read.parquet
        return model.whole(lambda f, names: _columns(x.to_numpy() for _, x in read(*f).select(names).toPandas().sort_values("key").items()))
    return model


def _gathered(frames, least: int):
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += sum(map(len, frame["text"]))
        if size >= least:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else frame
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _judged(model: Stored) -> Callable:
    def run(frames):
        for frame in _gathered(frames, model.gathered):
            x = features(model, *words(list(frame["text"])))
            yield pd.DataFrame({"key": frame["key"], "toxic": frame["toxic"], **dict(zip(_FEATURES, x.T, strict=True))})

    return run


def logistic_of(rows: DataFrame, columns: list[str], label: str, steps: int = 40, ridge: float = 1.0) -> np.ndarray:
    """`logistic` with equal weights, its sums taken by Spark."""
    seen = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    k = len(columns)
    mean, spread = np.array([seen[f"m{i}"] for i in range(k)]), np.array([seen[f"s{i}"] for i in range(k)]) + 1e-6
    z = [F.col(f"z{i}") for i in range(k)] + [F.lit(1.0)]
    scaled = rows.select(F.col(label).alias("y"), *[((F.col(c) - float(mean[i])) / float(spread[i])).alias(f"z{i}") for i, c in enumerate(columns)])
    places = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    penalty = ridge * np.append(np.ones(k), 1e-6)
    w = np.zeros(k + 1)
    for _ in range(steps):
        line = reduce(lambda a, b: a + b, [z[i] * float(w[i]) for i in range(k + 1)])
        p = scaled.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(50.0)), F.lit(-50.0)))))
        p = p.select("*", (F.col("p") - F.col("y")).alias("miss"), (F.col("p") * (1 - F.col("p"))).alias("bend"))
        got = p.agg(*[F.sum(F.col("miss") * z[i]).alias(f"g{i}") for i in range(k + 1)], *[F.sum(F.col("bend") * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in places]).first()
        slope = np.array([got[f"g{i}"] for i in range(k + 1)]) + penalty * w
        bend = np.diag(penalty) + 1e-9 * np.eye(k + 1)
        for i, j in places:
            bend[i, j] += got[f"h{i}_{j}"]
            bend[j, i] = bend[i, j]
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    # rounded, so that the order of Spark's sums does not show
    return np.array([float(f"{x:.6g}") for x in np.append(slopes, w[-1] - slopes @ mean)])


def learn_all(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Judge:
    """A judge as `learn` gives it, from every such text, however many and long they are.

    The counts, the curve and the share of toxic texts come from all of them. What reaches the driver is sums and names of files: the model stays in
    the shared folder, where tasks read it.
    """
    scratch = Scratch(docs.sparkSession)
    marks = labels.select(labels["doc_id"].alias("id_"), labels["toxic"].alias("toxic_")).where("toxic_ IN (0, 1)")
    marks = marks.groupBy("id_").agg(F.sum("toxic_").alias("yes"), F.count("*").alias("all"))
    rows = docs.where(may_learn).select(docs["doc_id"].alias("id_"), docs["text"].alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("text"))
    texts = rows.select("id_", "key").join(marks, "id_").groupBy("key").agg((2 * F.sum("yes") >= F.sum("all")).cast("int").alias("toxic"))
    texts = scratch.keep(texts, "marked")
    held = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(held) < 2:
        scratch.drop("marked")
        return Judge(None, np.array([float(1 in held)]))
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(PARTS)).cast("int")
    # turn by turn, so that the shuffle of one is gone before that of the next comes
    turns = range(TURNS)
    joined = rows.join(texts, "key").select("key", "toxic", part.alias("part"), "text")
    learned = reduce(DataFrame.unionByName, [scratch.keep(joined.where(F.pmod("key", F.lit(TURNS)) == turn), f"learned_{turn}") for turn in turns])
    tagged = learned.select("text", (F.col("toxic") * PARTS + F.col("part")).alias("tag"))
    counted = reduce(DataFrame.unionByName, [scratch.keep(_times(tagged, turn), f"pairs_{turn}") for turn in turns])
    models = [fit_counts(counted.select("before", "word", *[F.col(f"t{c}_{m}").alias(f"t{c}") for c in (0, 1)]), scratch, f"model_{m}") for m in range(PARTS + 1)]
    kinds = ", ".join(["key long", "toxic int", *[f"{x} double" for x in _FEATURES]])
    judged = [learned.where(F.col("part") == p).select("key", "toxic", "text").mapInPandas(_judged(models[p]), kinds) for p in range(PARTS)]
    judged = scratch.keep(reduce(DataFrame.unionByName, judged).dropDuplicates(["key"]), "features")
    weights = logistic_of(judged, _FEATURES, "toxic")
    scratch.drop("marked", "features", *[f"{name}_{turn}" for name in ("learned", "pairs") for turn in turns])
    scratch.drop(*[f"model_{m}_{name}" for name in _COLUMNS for m in range(PARTS) if f"model_{m}_{name}" in scratch.paths])
    return Judge(models[PARTS], weights)


def score(docs: DataFrame, judge: Judge, columns: list[str]) -> DataFrame:
    """`columns` of each row, then score (0 to 1) and predicted (1 from THRESHOLD on), row by row.

    Null texts and those without a word get the score of an empty text. Without labels of both classes every score
    is the share of toxic ones, 0 if there are none.
    """
    bounded_batches(docs.sparkSession)

    def make():
        def compute(frame: pd.DataFrame) -> pd.DataFrame:
            found = judge.scores([t if isinstance(t, str) else None for t in frame["text"]])
            return pd.DataFrame({"score": found, "predicted": (found >= THRESHOLD).astype(np.int32)})

        return compute

    return computed(docs, columns, ["text"], make, "score double, predicted int", judge.model.gathered if judge.model is not None else 0)
