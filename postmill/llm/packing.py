"""Packing of token ids into windows, neighbours by BM25 next to each other.

Whole windows of a long document stand alone; what is left of each document (its rest) is packed. Rests
are dealt out by a MinHash of their tokens, so that lexically close ones tend to meet, and cut into shards of bounded
size; a token set shared by very many documents just fills several shards. Each shard has its own BM25 inverted index,
all with the statistics of the whole corpus. A seed's index lookup ranks the unused rests; they
are appended in that order, and the one that no longer fits is cut: its remainder is the next seed. The ids left at a shard's end go
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.hashing import U64, mix
from postmill.llm.rows import Scratch, computed, keyed
from postmill.llm.words import word_encoder

K1, B = 1.2, 0.75  # usual BM25 constants
SHARD_TOKENS = 1 << 19
_TAILS = 1 << 62  # sequence ids of packed rests start here


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoded(path: str, window: int, end_id: int):
    def make():
        encoder = word_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()

        def of(raw: bytes) -> tuple:
            ids = np.frombuffer(raw + end, encoder.dtype)
            whole = len(ids) // window
            rest = ids[whole * window :]
            near = int(mix(rest.astype(U64) + U64(1)).min() >> U64(1)) if len(rest) else 0
            return len(ids), [crc(ids[i * window : (i + 1) * window]) for i in range(whole)], rest.tobytes(), near

        names = ["doc_tokens", "whole", "rest", "near"]
        return lambda frame: pd.DataFrame([of(raw) for raw in encoder.encode(frame["text"].tolist())], columns=names)

    return make


def _frequencies(dtype: np.dtype, size: int):
    """Per task: in how many rests each token occurs. Token -1 counts the rests, -2 their tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rests, tokens = np.zeros(size, np.int64), 0, 0
        for frame in frames:
            for raw in frame["rest"]:
                ids = np.frombuffer(raw, dtype)
                seen[np.unique(ids)] += 1
                rests, tokens = rests + 1, tokens + len(ids)
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"token": np.concatenate([used, [-1, -2]]), "n": np.concatenate([seen[used], [rests, tokens]])})

    return run


class Shard:
    """A BM25 inverted index over some rests."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(r) for r in rests])
        place, count = np.unique(np.repeat(np.arange(len(rests)) << 32, size) | np.concatenate(rests).astype(np.int64), return_counts=True)
        doc, term = place >> 32, place & 0xFFFFFFFF
        self.terms = np.split(term, np.cumsum(np.bincount(doc, minlength=len(rests)))[:-1])
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.n, self.doc, self.weight, self.term = len(rests), doc[order], weight[order], term[order]
        self._ranges()

    def _ranges(self) -> None:
        self.begin = np.flatnonzero(np.diff(self.term, prepend=-1))
        self.end, self.known = np.append(self.begin[1:], len(self.term)), self.term[self.begin]

    def only(self, unused: np.ndarray) -> None:
        """Lets the postings of all other rests go; the scores of these stay the same."""
        held = unused[self.doc]
        self.doc, self.weight, self.term = self.doc[held], self.weight[held], self.term[held]
        self._ranges()

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, terms)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms)]
        size = self.end[at] - self.begin[at]
        where = np.arange(size.sum()) + np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[where], self.weight[where], minlength=self.n)


def fill(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (rest, from, to). All but the last ones are `window` long."""
    index = Shard(rests, idf, mean)
    unused = np.ones(len(rests), bool)
    sequences, now, room, begin = [], [], window, 0
    seed, at, indexed = 0, 0, len(rests)
    while True:
        if at == 0:
            while begin < len(rests) and not unused[begin]:
                begin += 1
            if begin == len(rests):
                break
            seed = begin
            unused[seed] = False
        take = min(room, len(rests[seed]) - at)
        now.append((seed, at, at + take))
        room -= take
        at = at + take if at + take < len(rests[seed]) else 0
        if room and at == 0 and unused.any():
            free = np.flatnonzero(unused)
            if len(free) < 0.8 * indexed:
                index.only(unused)
                indexed = len(free)
            score = index.scores(index.terms[now[0][0]])
            ranked = free[np.argsort(-score[free], kind="stable")]
            reach = np.cumsum([len(rests[i]) for i in ranked[:window]])
            n = int(np.searchsorted(reach, room)) + 1
            for i in ranked[:n]:
                take = min(room, len(rests[i]))
                now.append((int(i), 0, take))
                unused[i] = False
                room -= take
                if take < len(rests[i]):
                    seed, at = int(i), take
        if room == 0:
            sequences.append(now)
            now, room = [], window
    # what is left, in powers of two from the largest down
    size = window - room
    bit = 1 << max(0, size.bit_length() - 1)
    while now:
        if not size & bit:
            bit >>= 1
            continue
        part, need = [], bit
        while need:
            i, a, b = now.pop(0)
            take = min(need, b - a)
            part.append((i, a, a + take))
            need -= take
            if a + take < b:
                now.insert(0, (i, a + take, b))
        sequences.append(part)
        size -= bit
    return sequences


def _packed(dtype: np.dtype, idf: np.ndarray, mean: float, window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = _TAILS + (TaskContext.get().partitionId() << 36), 0

        def write(held: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal made
            frame = pd.concat(held, ignore_index=True)
            rests = [np.frombuffer(r, dtype) for r in frame["rest"]]
            before = frame["doc_tokens"].to_numpy() - np.array([len(r) for r in rests])
            rows = []
            for sequence in fill(rests, idf, mean, window):
                offset = 0
                for i, a, b in sequence:
                    rows.append((i, before[i] + a, b - a, crc(rests[i][a:b]), first + made, offset))
                    offset += b - a
                made += 1
            out = pd.DataFrame(rows, columns=["row", "start", "length", "ids_crc32", "sequence_id", "offset"])
            row = out.pop("row").to_numpy()
            ids = frame[["doc_id", "known", "doc_tokens"]].iloc[row].reset_index(drop=True)
            return pd.concat([ids, out], axis=1)

        held, size = [], 0
        for frame in frames:
            sizes = np.cumsum(frame["rest"].str.len().to_numpy()) // dtype.itemsize
            while len(frame):
                n = int(np.searchsorted(sizes, SHARD_TOKENS - size)) + 1
                held.append(frame.iloc[:n])
                size += int(sizes[min(n, len(sizes)) - 1])
                frame, sizes = frame.iloc[n:], sizes[n:] - sizes[min(n, len(sizes)) - 1]
                if size >= SHARD_TOKENS:
                    yield write(held)
                    held, size = [], 0
        if held:
            yield write(held)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids end with `end_id`; null and empty texts have that id only. Rows that share a doc_id, or have
    none, are separate documents.
    """
    scratch = Scratch(docs.sparkSession)
    encoder = word_encoder(tokenizer)
    texts = keyed(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kinds = "doc_tokens long, whole array<bigint>, rest binary, near long"
    encoded = scratch.keep(computed(texts, ["uid", "doc_id"], ["text"], _encoded(tokenizer, window, end_id), kinds), "encoded")
    known = [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id")]
    rests = encoded.where(F.length("rest") > 0).select("uid", *known, "doc_tokens", "rest", "near")
    counts = rests.select("rest").mapInPandas(_frequencies(encoder.dtype, encoder.size), "token long, n long")
    # at most one row per token of the vocabulary
    frequency = {r["token"]: r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, tokens = frequency.pop(-1, 0), frequency.pop(-2, 0)
    df = np.zeros(encoder.size)
    df[list(frequency)] = list(frequency.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    dealt = rests.repartitionByRange("near", "uid").sortWithinPartitions("near", "uid")
    columns = "doc_id long, known boolean, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.mapInPandas(_packed(encoder.dtype, idf, max(tokens / max(n, 1), 1.0), window), columns)
    packed = packed.withColumn("doc_id", F.expr("if(known, doc_id, null)")).drop("known")
    whole = encoded.select("doc_id", "doc_tokens", F.posexplode("whole").alias("i", "ids_crc32")).select(
        "doc_id",
        "doc_tokens",
        (F.col("i") * window).cast("bigint").alias("start"),
        F.lit(window).cast("bigint").alias("length"),
        "ids_crc32",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.unionByName(whole).select(*order)
