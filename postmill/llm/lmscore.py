"""Documents scored by the cross-entropy difference of two n-gram models.

Bigram models of a target part and of the whole corpus (the background) are estimated in the same way over one shared
vocabulary: words are lower-cased, and words, contexts and word pairs are counted by 64-bit keys of their own, for both alike.

A word's share is (count + WORD_PRIOR / WORDS) / (number of words + WORD_PRIOR), and behind the word before it
(pair count + PAIR_PRIOR * share) / (context count + PAIR_PRIOR); its loss is -log2 of the latter. The models are matched: the background's
counts are multiplied by the target's number of words over the corpus's, so that the priors weigh on both equally, whatever part of
the corpus is the target. No document counts for itself: its own words and pairs are taken out of both models before it is scored (out of
the target only if it is in it), so being in the target is no merit. Copies of it elsewhere do count. A document's
score is its mean loss in the target minus that in the background: the lower, the more it reads like the target. All scores shift upwards
alike where the target is small, since it knows fewer pairs than the corpus: scores are to be compared with each other, not with 0.

The counts grow with the corpus: no table of them is held anywhere. Documents are cut into chunks of bounded size where they are read; which
of them are the target is found by their ids and places alone, and a chunk gets a bit a document. A chunk asks for
each of its distinct keys once, with its own counts, so a key has as many rows as there are chunks at most; buckets of keys, of
which there are the more the more words there are, add the counts up and answer every chunk, and each chunk scores its documents.
Keys are asked for, and chunks scored, in turns, so that the shuffle of one is gone before that of the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.hashing import U64, mix, range_hash
from postmill.llm.rows import Scratch

WORDS = 1 << 17  # the uniform share is one of so many words, whatever the corpus has
WORD_PRIOR, PAIR_PRIOR = 1000.0, 20.0  # counts that the uniform share and the share anywhere stand for
CHUNK_WORDS, CHUNK_ROWS = 1 << 19, 50_000
BUCKET_WORDS, LEAST_BITS = 1 << 21, 8  # words of the corpus a bucket of keys; 2^LEAST_BITS buckets at least
TURNS = 3  # each asks for a share of the buckets, or scores a share of the chunks
_WORD, _CONTEXT = U64(0x9E6C63D0876A9A47), U64(0xC2B2AE3D27D4EB4F)  # set words and contexts apart from pairs
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def hashes(text) -> np.ndarray:
    """64-bit hashes of a text's words."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, U64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    hasher = range_hash(21)
    return mix(hasher.ranges(hasher.prefix(data), start, end) ^ (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of whole numbers, all first bytes in front, so that the zeros of small numbers compress."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(raw: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _gaps(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the gaps between them, whose high bytes are zeros."""
    return _planes(np.diff(keys, prepend=U64(0)), 8)


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw, 8).view(U64), dtype=U64)


_CHUNK = "ids array<bigint>, sizes array<int>, words binary, at binary"
_CHUNK_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("at", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's documents in chunks: ids, numbers of words, distinct words, and the place of each word among these."""
    ids, found, size = [], [], 0

    def made() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate(found), return_inverse=True)
        row = [ids, [len(f) for f in found], _gaps(words), _planes(at, 4)]
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)

    for batch in batches:
        for i, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
            ids.append(i)
            found.append(hashes(text))
            size += len(found[-1])
            if size >= CHUNK_WORDS or len(ids) >= CHUNK_ROWS:
                yield made()
                ids, found, size = [], [], 0
    if ids:
        yield made()


def _marked(places: pa.Table) -> pa.Table:
    """The documents of one chunk that are the target: a bit for each document up to the last of them, and their number of words."""
    bits = np.zeros(max(places.column("place").to_pylist()) + 1, bool)
    bits[places.column("place").to_numpy()] = True
    row = [places.column("chunk")[0].as_py(), np.packbits(bits).tobytes(), sum(places.column("size").to_pylist())]
    return pa.table([[x] for x in row], schema=pa.schema([("chunk", pa.int64()), ("chosen", pa.binary()), ("n_target", pa.int64())]))


class Chunk:
    """Distinct keys of a chunk, ascending, and which of them belong to each of its words."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], np.int64)
        words, self.at = _keys(row["words"]), _numbers(row["at"], 4)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.filled = np.flatnonzero(self.sizes)
        self.chosen = np.unpackbits(np.frombuffer(row["chosen"] or b"\0", np.uint8), count=len(self.sizes)).astype(bool)
        self.target = np.repeat(self.chosen, self.sizes)
        start = len(words)  # the start of a text counts as a word
        self.before = np.concatenate([[start], self.at[:-1]])[: len(self.at)]
        self.before[self.first[self.filled]] = start
        contexts = np.append(words, U64(0))
        pairs, self.pair = np.unique(mix(contexts[self.before] * U64(0xD6E8FEB86659FD93) + words[self.at]), return_inverse=True)
        self.parts = np.cumsum([len(pairs), len(words)])
        used = np.flatnonzero(np.bincount(self.before, minlength=start + 1))
        self.context = np.zeros(start + 1, np.int64)
        self.context[used] = np.arange(len(used))
        every = np.concatenate([pairs, mix(words ^ _WORD), mix(contexts[used] ^ _CONTEXT)])
        self.order = np.argsort(every)
        self.keys = every[self.order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, in the target and in all documents of the chunk."""
        a, b = self.parts
        found = np.concatenate([self.pair, a + self.at, b + self.context[self.before]])
        n = len(self.keys)
        marked = found[np.tile(self.target, 3)]
        return np.bincount(marked, minlength=n)[self.order], np.bincount(found, minlength=n)[self.order]

    def _own(self, keys: np.ndarray) -> np.ndarray:
        """For each word of the chunk: how often its key occurs in its document."""
        place = np.repeat(np.arange(len(self.sizes)), self.sizes) * (int(keys.max()) + 1) + keys
        _, at, times = np.unique(place, return_inverse=True, return_counts=True)
        return times[at]

    def losses(self, target: np.ndarray, every: np.ndarray, n_target: int, n_every: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean losses of each filled document in target and background, from the whole corpus's counts of the keys."""
        a, b = self.parts
        places = [self.pair, a + self.at, b + self.context[self.before]]
        own = [self._own(k) for k in (self.pair, self.at, self.before)]
        scale = n_target / max(n_every, 1)
        means = []
        for counts, total, by, counted in ((target, n_target, 1.0, self.chosen), (every, n_every, scale, np.ones(len(self.sizes), bool))):
            held = np.empty(len(counts))
            held[self.order] = counts
            mine = np.repeat(counted, self.sizes)
            pairs, words, contexts = (by * (held[p] - o * mine) for p, o in zip(places, own, strict=True))
            rest = np.repeat(by * (total - self.sizes * counted), self.sizes)
            share = (words + WORD_PRIOR / WORDS) / (rest + WORD_PRIOR)
            loss = -np.log2((pairs + PAIR_PRIOR * share) / (contexts + PAIR_PRIOR))
            means.append(np.add.reduceat(loss, self.first[self.filled]) / self.sizes[self.filled])
        return means[0], means[1]


_ASKED = "bucket long, chunk long, keys binary, target binary, every binary"
_ASKED_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("target", pa.binary()), ("every", pa.binary())])


def _asked(bits: int, turn: int):
    """Keys and counts of each chunk, a row per bucket of this turn. A bucket is a range of keys."""

    def rows(row: dict) -> pa.RecordBatch:
        chunk = Chunk(row)
        target, every = chunk.counts()
        bucket = (chunk.keys >> U64(64 - bits)).astype(np.int64)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        end, mine = np.append(begin[1:], len(bucket)), bucket[begin] % TURNS == turn
        spans = [slice(a, b) for a, b in zip(begin[mine], end[mine], strict=True)]
        columns = [
            pa.array(bucket[begin[mine]]),
            pa.array(np.full(len(spans), row["chunk"], np.int64)),
            pa.array([_gaps(chunk.keys[s]) for s in spans], pa.binary()),
            pa.array([_planes(target[s], 4) for s in spans], pa.binary()),
            pa.array([_planes(every[s], 4) for s in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_ASKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield rows(batch.slice(i, 1).to_pylist()[0])

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """The same rows of one bucket with the counts of all chunks together."""
    raw = {c: asked.column(c).to_pylist() for c in ("keys", "target", "every")}
    keys = [_keys(k) for k in raw["keys"]]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    answers = []
    for name in ("target", "every"):
        # sums are whole and below 2^53
        total = np.bincount(at, np.concatenate([_numbers(r, 4) for r in raw[name]]), minlength=len(known)).astype(np.int64)
        answers.append(pa.array([_planes(n, 8) for n in np.split(total[at], ends)], pa.binary()))
    return pa.table([asked.column("bucket"), asked.column("chunk"), *answers], names=["bucket", "chunk", "target", "every"])


_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _scored(n_target: int, n_every: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        held = Chunk(chunk.to_pylist()[0])
        losses, empty = np.zeros((2, len(held.ids))), held.sizes == 0
        if len(held.filled):
            answers = answers.sort_by("bucket")
            counts = (np.concatenate([_numbers(r, 8) for r in answers.column(c).to_pylist()]) for c in ("target", "every"))
            losses[:, held.filled] = held.losses(*counts, n_target, n_every)
        columns = [pa.array(held.ids, pa.int64()), pa.array(held.sizes)]
        columns += [pa.array(x, mask=empty) for x in (*losses, losses[0] - losses[1])]
        return pa.table(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return run


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of each row of `docs`.

    `target_ids` has the doc_id of documents that are the target; repeated and null ones are no matter. Null, empty
    and blank texts have no words and null losses. Without any target every loss is that of the uniform model, and every score 0.
    """
    scratch = Scratch(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_chunks, _CHUNK)
    chunks = scratch.keep(cut.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    chosen = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "of"))
    places = places.select("chunk", "place", F.col("of.ids").alias("doc_id"), F.col("of.sizes").alias("size")).join(chosen, "doc_id")
    marks = scratch.keep(places.groupBy("chunk").applyInArrow(_marked, "chunk long, chosen binary, n_target long"), "marks")
    n_target = marks.agg(F.sum("n_target")).first()[0] or 0
    n_every = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)"))).first()[0] or 0
    bits = max(LEAST_BITS, (n_every // BUCKET_WORDS).bit_length())
    chunks = chunks.join(marks.select("chunk", "chosen"), "chunk", "left")
    kinds = "bucket long, chunk long, target binary, every binary"
    asked = [f"answers_{turn}" for turn in range(TURNS)]
    answers = reduce(
        DataFrame.unionAll,
        [scratch.keep(chunks.mapInArrow(_asked(bits, t), _ASKED).groupBy("bucket").applyInArrow(_answered, kinds), name) for t, name in enumerate(asked)],
    )
    scores = []
    for turn in range(TURNS):
        held, told = (df.where(F.col("chunk") % TURNS == turn).groupBy("chunk") for df in (chunks, answers))
        scores.append(scratch.keep(held.cogroup(told).applyInArrow(_scored(n_target, n_every), _SCORES), f"scores_{turn}"))
    scratch.drop("chunks", "marks", *asked)
    return reduce(DataFrame.unionAll, scores)
