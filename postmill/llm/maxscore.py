"""Exact top-k inner products by MaxScore over sharded postings.

A shard holds some vectors term-major: the posting list of a component is its value in each vector. For a query the
components are ordered by the most they can add in the shard. Those at the end, whose bounds together stay below the
score that the query's k-th hit has already, are non-essential: alone they cannot make a hit. Essential postings
are traversed for all vectors; the others are probed, a few components at a time, only for vectors that can
still reach that score. Queries are copied to each of a few groups of shards; the shards of a group pass the score on, and
the groups' hits are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.rows import Scratch

SHARD, BLOCK, PROBE = 4096, 256, 8
BAND = 32 << 20  # bytes of queries that a task holds
SCALE = 1024
_EXACT = float(1 << 53)
_WITHIN = (1 << 33) - 1  # the bits of `monotonically_increasing_id` that count within a task


def _whole(vector) -> np.ndarray | None:
    """floor(SCALE * x) of each component, or None where the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    return scaled if np.isfinite(scaled).all() else None


def _blocks(size: int):
    """Packs the task's usable vectors into rows of up to `size` of them, term-major."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []

        def made() -> pd.DataFrame:
            dim = max(len(r) for r in rows)
            matrix = np.zeros((dim, len(rows)))
            for i, r in enumerate(rows):
                matrix[: len(r), i] = r
            return pd.DataFrame({"n": [len(rows)], "ids": [np.array(ids, np.int64).tobytes()], "matrix": [matrix.tobytes()]})

        for frame in frames:
            for i, vector in zip(frame["vec_id"], frame["embedding"], strict=True):
                values = _whole(vector)
                if values is None:
                    continue
                ids.append(int(i))
                rows.append(values)
                if len(rows) == size:
                    yield made()
                    ids, rows = [], []
        if rows:
            yield made()

    return run


def search(matrix: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, ids: np.ndarray | None = None, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (a column of `queries`) the vectors whose score reaches `floor`, and their scores.

    Both are component-major with equal numbers of components and whole values. At least the k best are among
    the vectors returned where no floor is given (-inf). Vectors whose number in `ids` is the query's in `asked` are left out.
    """
    high, low = matrix.max(axis=1), matrix.min(axis=1)
    for n, (q, least) in enumerate(zip(queries.T, floor, strict=True)):
        bound = np.maximum(np.maximum(q * high, q * low), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # the most that components from i on add
        essential = len(order) if least == -np.inf else max(1, int(np.argmax(rest < max(least, 1))))
        first = order[:essential]
        score = q[first] @ matrix[first]
        alive = np.flatnonzero(score + rest[essential] >= least)
        if ids is not None:
            alive = alive[ids[alive] != asked[n]]
        score = score[alive]
        for i in range(essential, len(order), PROBE):
            if not len(alive):
                break
            probed = order[i : i + PROBE]
            score = score + q[probed] @ matrix[np.ix_(probed, alive)]
            keep = score + rest[min(i + PROBE, len(order))] >= least
            alive, score = alive[keep], score[keep]
        if least == -np.inf and len(alive) > k:
            edge = np.sort(score)[len(score) - k]
            keep = score >= edge
            alive, score = alive[keep], score[keep]
        yield alive, score


def _padded(raw: bytes, n: int, dim: int) -> np.ndarray:
    m = np.frombuffer(raw).reshape(-1, n)
    return np.vstack([m, np.zeros((dim - len(m), n))]) if len(m) < dim else m


def _scored(best: dict, shard, block, k: int) -> None:
    """Brings the `k` best hits of a block's queries (query -> scores, ids, best first) up to date with a shard."""
    dim = max(len(shard.matrix) // (8 * shard.n), len(block.matrix) // (8 * block.n))
    matrix, queries = _padded(shard.matrix, shard.n, dim), _padded(block.matrix, block.n, dim)
    ids, asked = np.frombuffer(shard.ids, np.int64), np.frombuffer(block.ids, np.int64)
    if dim * np.abs(matrix).max(initial=0) * np.abs(queries).max(initial=0) >= _EXACT:
        # too large for exact floating point: whole numbers of any size
        matrix, queries = (np.vectorize(int, otypes=[object])(m) for m in (matrix, queries))
    floor = np.array([best[a][0][-1] if a in best and len(best[a][0]) == k else -np.inf for a in asked.tolist()], object if matrix.dtype == object else float)
    for a, (where, score) in zip(asked.tolist(), search(matrix, queries, floor, k, ids, asked), strict=True):
        s, i = score, ids[where]
        if a in best:
            s, i = np.concatenate([best[a][0], s]), np.concatenate([best[a][1], i])
        order = np.argsort(i, kind="stable")
        order = order[np.argsort(-s[order], kind="stable")][:k]
        best[a] = (s[order], i[order])


def _rows(best: dict) -> Iterator[pd.DataFrame]:
    queries = list(best)
    for at in range(0, len(queries), SHARD):
        rows = [(a, i, max(min(int(x), (1 << 63) - 1), -(1 << 63))) for a in queries[at : at + SHARD] for x, i in zip(*(v.tolist() for v in best[a]), strict=True)]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})


def _hits(k: int):
    """Rows come by cell, the blocks of queries (`asks`) before the shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, blocks, best = None, [], {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.cell != cell:
                    yield from _rows(best)
                    cell, blocks, best = row.cell, [], {}
                if row.asks:
                    blocks.append(row)
                    continue
                for block in blocks:
                    _scored(best, row, block, k)
        yield from _rows(best)

    return run


def _dealt(parts: int, most: int) -> Column:
    """A number below `parts` of each row of a stored table: in turn, where every task that wrote it has `most` of them."""
    turn = F.shiftright("number", 33) * most + F.col("number").bitwiseAND(_WITHIN)
    return F.pmod(turn, F.lit(parts)).cast("int")


def _sizes(stored: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes and the most rows of one writing task."""
    got = stored.agg(F.count("*").alias("rows"), F.sum(F.octet_length("matrix")).alias("bytes"), F.max(F.col("number").bitwiseAND(_WITHIN)).alias("last")).first()
    return got["rows"], got["bytes"] or 0, (got["last"] or 0) + 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors other than its own, ties to the smaller id.

    Both inputs have vec_id and embedding. Rows without an id, null vectors and those with null or non-finite components
    (before or after scaling) take no part; a shorter vector counts as filled up with zeros. Rows with a
    query's id are not among its hits; if several queries share an id, the smallest vector asks. Scores beyond 64 bits are cut
    to the nearest long.
    """
    scratch = Scratch(vectors.sparkSession)
    kinds = "n int, ids binary, matrix binary"
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    shards = scratch.keep(usable.mapInPandas(_blocks(SHARD), kinds).withColumn("number", F.monotonically_increasing_id()), "shards")
    asked = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    asked = asked.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = scratch.keep(asked.mapInPandas(_blocks(BLOCK), kinds).withColumn("number", F.monotonically_increasing_id()), "queries")
    rows, size, most = _sizes(shards)
    pieces, asked_size, most_asked = _sizes(blocks)
    # a task has the queries of one band in memory, and one shard of its group after the other; groups are so few that the copies of the queries are
    # no more than a share of the vectors, but enough for all cores
    bands = max(1, min(pieces, -(-asked_size // BAND)))
    groups = max(1, min(rows, max(2 * vectors.sparkSession.sparkContext.defaultParallelism, size // (4 * max(asked_size, 1)))))
    held = shards.withColumn("group", _dealt(groups, most)).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    sent = blocks.withColumn("band", _dealt(bands, most_asked)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = (F.col("group") * bands + F.col("band")).alias("cell")
    both = [x.select(cell, F.lit(asks).alias("asks"), "n", "ids", "matrix") for x, asks in ((sent, True), (held, False))]
    cells = both[0].unionByName(both[1]).repartitionById(groups * bands, "cell").sortWithinPartitions("cell", F.desc("asks"))
    hits = cells.mapInPandas(_hits(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
