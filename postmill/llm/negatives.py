"""Hard-negative mining by best-first search of packed R-trees.

Each shard of the vectors holds one R-tree a label, packed by sort-tile-recursive: sorted along one coordinate, cut into
slabs, each slab along the next one, until a tile fits in a leaf; the tiles' centres are packed in the same way into upper
levels. A node keeps the smallest and largest value of every coordinate, so the inner product with an anchor lies in the sum of
one interval per coordinate. A queue pops the node with the highest bound first. Boxes outside every score
window, and those strictly below the k-th score that a window has already, are never opened.

The same search runs twice: in the trees of the anchor's label for its positives, then in all others for the rows whose score
lies in the windows that the positives set. Anchors meet the shards in blocks; a shard's vectors, a block of anchors
and that block's hits are all that a task holds.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from postmill.llm.rows import Scratch

SHARD, LEAF, FANOUT, BLOCK = 16_384, 128, 16, 512
SHARDS_PER_GROUP = 4
SCALE = 256
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def tiles(points: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Row numbers of each tile of at most `capacity` points, by sort-tile-recursive over the widest coordinates first."""
    coordinates = np.argsort(-points.var(axis=0), kind="stable") if points.shape[1] else np.zeros(1, int)

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        n = -(-len(rows) // capacity)
        if n <= 1:
            return [rows]
        if points.shape[1]:
            rows = rows[np.argsort(points[rows, coordinates[depth]], kind="stable")]
        left = len(coordinates) - depth
        slabs = n if left == 1 else math.ceil(n ** (1 / left))
        size = -(-n // slabs) * capacity
        return [t for i in range(0, len(rows), size) for t in cut(rows[i : i + size], depth + 1)]

    return cut(np.arange(len(points)), 0)


@dataclass
class Forest:
    """R-trees of a shard's vectors, one a label. Node i's children are `child[first[i]:last[i]]`, a leaf's rows `first[i]:last[i]`."""

    ids: np.ndarray
    rows: np.ndarray  # whole values, in leaf order
    lower: np.ndarray
    upper: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    child: np.ndarray
    roots: dict[int, int]  # label -> node


def forest(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Forest:
    near = rows.astype(float)
    order, lower, upper, first, last, leaf, child, roots = [], [], [], [], [], [], [], {}
    placed = 0

    def add(low, high, start, end, is_leaf) -> int:
        for column, value in ((lower, low), (upper, high), (first, start), (last, end), (leaf, is_leaf)):
            column.append(value)
        return len(lower) - 1

    for label in np.unique(labels).tolist():
        own = np.flatnonzero(labels == label)
        level = []
        for tile in tiles(near[own], LEAF):
            at = own[tile]
            order.append(at)
            level.append(add(rows[at].min(axis=0), rows[at].max(axis=0), placed, placed + len(at), True))
            placed += len(at)
        while len(level) > 1:
            centres = np.array([(lower[i] + upper[i]).astype(float) / 2 for i in level])
            above = []
            for tile in tiles(centres, FANOUT):
                nodes = [level[i] for i in tile]
                low, high = np.min([lower[i] for i in nodes], axis=0), np.max([upper[i] for i in nodes], axis=0)
                above.append(add(low, high, len(child), len(child) + len(nodes), False))
                child.extend(nodes)
            level = above
        roots[label] = level[0]
    at = np.concatenate(order)
    arrays = [np.array(x) for x in (lower, upper, first, last, leaf, child)]
    return Forest(ids[at], rows[at], *arrays[:5], arrays[5].astype(int), roots)


def intervals(trees: Forest, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest inner product that a vector in each node's box can have, (anchors, nodes)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ trees.lower.T + down @ trees.upper.T, up @ trees.upper.T + down @ trees.lower.T


def search(trees: Forest, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, roots: list[int], own: int, windows: list[tuple], k: int, found: list[list]) -> int:
    """Adds to each window's list the k best (-score, id) inside it, ids other than `own`. Returns how many rows were scored."""
    queue = [(-high[r], r) for r in roots]
    heapq.heapify(queue)
    scored = 0
    while queue:
        most, node = heapq.heappop(queue)
        most = -most
        open_ = [
            j for j, (least, top) in enumerate(windows)
            if most >= least and low[node] <= top and (len(found[j]) < k or min(most, top) >= -found[j][-1][0])
        ]
        if not open_:
            continue
        a, b = trees.first[node], trees.last[node]
        if not trees.leaf[node]:
            for c in trees.child[a:b]:
                heapq.heappush(queue, (-high[c], int(c)))
            continue
        score = trees.rows[a:b] @ anchor
        scored += b - a
        if score.dtype == object:
            score = np.clip(score, _LEAST, _MOST)
        ids = trees.ids[a:b]
        for j in open_:
            least, top = windows[j]
            if len(found[j]) == k:
                least = max(least, -found[j][-1][0])
            at = np.flatnonzero((score >= least) & (score <= top) & (ids != own))
            if len(at):
                s, i = score[at], ids[at]
                by_id = np.argsort(i, kind="stable")
                best = by_id[np.argsort(-s[by_id], kind="stable")][:k]
                found[j] = sorted([*found[j], *((-int(x), int(y)) for x, y in zip(s[best], i[best], strict=True))])[:k]
    return scored


def _whole(vector) -> np.ndarray | None:
    """floor(SCALE * x) of each component, or None where the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * np.asarray(vector, dtype=np.float64))
    return scaled if np.isfinite(scaled).all() else None


def _matrix(rows: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _small(matrix: np.ndarray) -> np.ndarray:
    """The same whole values in fewer bytes, where they fit."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _packed(size: int, columns: list[str]):
    """Rows of up to `size` usable vectors of the task as one pickled (columns..., matrix)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = [[] for _ in columns]
        rows: list[np.ndarray] = []

        def made() -> pd.DataFrame:
            matrix = _matrix(rows, max(map(len, rows)))
            return pd.DataFrame({"packed": [pickle.dumps(([*map(list, held)], _small(matrix)))]})

        for frame in frames:
            for vector, *values in zip(frame["embedding"], *(frame[c] for c in columns), strict=True):
                whole = _whole(vector)
                if whole is None:
                    continue
                rows.append(whole)
                for column, value in zip(held, values, strict=True):
                    column.append(value)
                if len(rows) == size:
                    yield made()
                    held, rows = [[] for _ in columns], []
        if rows:
            yield made()

    return run


def _trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for packed in frame["packed"]:
            (ids, labels), matrix = pickle.loads(packed)
            trees = forest(np.array(ids, np.int64), np.array(labels, np.int64), matrix)
            yield pd.DataFrame({"trees": [pickle.dumps(vars(trees))]})


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as floats, or as whole numbers of any size where products could pass 2^53."""
    dim = arrays[0].shape[1]
    if dim * np.prod([max(1.0, float(np.abs(a.astype(float)).max(initial=0))) for a in arrays]) >= _EXACT:
        return [np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object) for a in arrays]
    return [a.astype(float) for a in arrays]


def _wide(a: np.ndarray, dim: int) -> np.ndarray:
    return np.hstack([a, np.zeros((len(a), dim - a.shape[1]), a.dtype)]) if a.shape[1] < dim else a


def _hits(k: int, same_label: bool):
    """Hits of one block after another; what a block has found in one shard bounds the search of the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, number, found = None, None, {}

        def made() -> pd.DataFrame:
            rows = [(a, j, i, -s) for a, lists in found.items() for j, hits in enumerate(lists) for s, i in hits]
            kinds = {"anchor": "int64", "slot": "int32", "vec_id": "int64", "score": "int64"}
            return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.block != number:
                    if found:
                        yield made()
                    number, found = row.block, {}
                    block = pickle.loads(row.packed)
                trees = Forest(**pickle.loads(row.trees))
                (anchors, ids, labels, *scores), vectors = block
                dim = max(vectors.shape[1], trees.rows.shape[1])
                vectors, trees.rows = _exact(_wide(vectors, dim), _wide(trees.rows, dim))
                trees.lower, trees.upper = (_wide(x, dim).astype(trees.rows.dtype) for x in (trees.lower, trees.upper))
                low, high = intervals(trees, vectors)
                if low.dtype == object:
                    low, high = np.clip(low, _LEAST, _MOST), np.clip(high, _LEAST, _MOST)
                for n, a in enumerate(anchors):
                    if same_label:
                        roots = [trees.roots[labels[n]]] if labels[n] in trees.roots else []
                        windows = [(-math.inf, math.inf)]
                    else:
                        roots = [r for label, r in trees.roots.items() if label != labels[n]]
                        windows = scores[0][n]
                    lists = found.setdefault(a, [[] for _ in windows])
                    search(trees, vectors[n], low[n], high[n], roots, ids[n], windows, k, lists)
        if found:
            yield made()

    return run


def window_of(positive: int, percent: int = 80) -> tuple[int, int]:
    """The whole scores s for which percent * positive <= 100 * s <= 100 * positive."""
    return -(-percent * positive // 100), positive


def _with_windows(percent: int):
    """Turns each anchor's positive scores into the windows of its negatives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["windows"] = [pickle.dumps([window_of(int(p), percent) for p in scores]) for scores in frame.pop("scores")]
            yield frame

    return run


def _asked(anchors: DataFrame, columns: list[str], windows: bool) -> DataFrame:
    pack = _packed(BLOCK, columns)

    def run(frames):
        for frame in frames:
            if windows:
                frame["windows"] = frame["windows"].map(pickle.loads)
            yield frame

    blocks = anchors.mapInPandas(lambda frames: pack(run(frames)), "packed binary")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _probe(scratch: Scratch, shards: DataFrame, blocks: DataFrame, groups: int, k: int, same_label: bool, name: str) -> DataFrame:
    """The k best hits of each (anchor, slot) over all shards: anchor, slot, vec_id, score, rank."""
    blocks = scratch.keep(blocks, f"{name}_blocks")
    sent = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    hits = sent.join(shards, "group").select("block", "packed", "trees").mapInPandas(_hits(k, same_label), "anchor long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return scratch.keep(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and embedding of the rows that can take part."""
    chosen = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), vectors["embedding"].alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id and embedding; `label` and `is_anchor` are conditions over vec_id and its own columns. An anchor's positives are its best
    rows of the same label, and for each of them the best rows of other labels with a score of at least `percent` per cent of the
    positive's and at most the positive's are returned. Higher scores come first, ties by smaller vec_id.

    Rows without an id, label or vector, or with null or non-finite components (before or after scaling), take no part; a shorter
    vector counts as filled up with zeros. Rows under the anchor's own id are none of its candidates. Repeated rows are candidates of
    their own, so an id may come several times; equal anchor rows count once, unlike ones under one id mine each by itself. Scores
    beyond 64 bits are cut to the nearest long before they are compared. An anchor without positives, and a positive
    without negatives, have no rows. Extra columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = usable(vectors, label)
    packed = rows.mapInPandas(_packed(SHARD, ["vec_id", "label"]), "packed binary")
    shards = scratch.keep(packed.mapInPandas(_trees, "trees binary").withColumn("shard", F.monotonically_increasing_id()), "shards")
    groups = max(1, -(-shards.count() // SHARDS_PER_GROUP))
    shards = shards.select(F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group"), "trees")
    anchors = rows.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = scratch.keep(anchors, "anchors")
    columns = ["anchor", "vec_id", "label"]
    found = _probe(scratch, shards, _asked(anchors, columns, False), groups, positives, True, "positives")
    scores = found.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    narrowed = anchors.join(scores, "anchor").select(*columns, "embedding", "scores")
    kinds = StructType([*anchors.select(*columns, "embedding").schema.fields, *StructType.fromDDL("windows binary").fields])
    narrowed = narrowed.mapInPandas(_with_windows(percent), kinds)
    worst = _probe(scratch, shards, _asked(narrowed, [*columns, "windows"], True), groups, negatives, False, "negatives")
    positive = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = worst.join(positive, ["anchor", "slot"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
