"""Removal of repeated passages by a suffix array built through bucket-pointer refinement.

A *window* is `length` bytes of one text. A window is a repeat if the same bytes also start earlier:
in a document with a smaller id, or earlier in the same one. Every byte that a repeat covers goes.

Most positions of a corpus cannot repeat, so the suffixes are dealt out before they are sorted. The head of a
window is its q-gram with the smallest hash, the leftmost if several have it. Equal windows have
equal heads, and neighbouring windows mostly share theirs, so a text falls into a few *spans*: runs of windows with one
head. Spans are the initial q-gram buckets:

1. spans whose head occurs once hold no repeat and leave;
2. of equal spans the first stays, the others are repeats as a whole;
3. where different spans share a head, their windows are sorted: positions start in buckets by their
   first 8 bytes; a bucket is refined by the bucket numbers found 8, 16, 32, .. bytes later, each pass
   reading the numbers that the pass before has updated, until the order is `length` bytes deep. Of each
   final bucket the first window stays.

Heads shared by very many different spans are split over several tasks by document; the first windows of
each part then meet in an aggregation by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.hashing import U64, mix, range_hash
from postmill.llm.rows import Scratch, computed, keyed

Q = 32  # bytes of a head; windows must be longer
SHARE = 2_000  # spans of one head sorted in one task
BLOCK = 1 << 18  # bytes hashed or sorted at once; their tables take over a hundred times that
_RUN_BITS = 12  # windows of a span (below 2^12) are packed behind its start


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def spans(data: np.ndarray, ends: np.ndarray, length: int):
    """(head, hash, text number, start in data, windows) of each span; `ends` are the texts' ends in data."""
    hasher, second = range_hash(1), range_hash(2)
    prefix, other = hasher.prefix(data), second.prefix(data)
    grams = mix(hasher.grams(prefix, Q))
    at = np.arange(len(grams), dtype=U64)
    head = (_sliding_min((grams & U64(0xFFFFFFFF00000000)) | at, length - Q + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(head))
    text = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[text]
    start, head, text = start[inside], head[inside], text[inside]
    if not len(start):
        return None
    new = np.concatenate([[True], (head[1:] != head[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    p0, p1 = start[first], start[last]
    whole = mix(second.ranges(other, p0, p1 + length) ^ (p1 - p0).astype(U64))
    return grams[head[first]], whole, text[first], p0, p1 - p0 + 1


def _blocks(texts: list[bytes], length: int):
    """Joined texts of about BLOCK bytes; a longer text is cut into pieces that overlap by length - 1."""
    part, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), BLOCK):
            piece = raw[at : at + BLOCK + length - 1]
            if len(piece) >= length:
                part.append((i, at, piece))
                size += len(piece)
            if size >= BLOCK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _span_rows(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["text"]]
            uid = frame["uid"].to_numpy()
            for part in _blocks(texts, length):
                row = np.array([i for i, _, _ in part])
                offset = np.array([at for _, at, _ in part])
                ends = np.cumsum([len(piece) for _, _, piece in part])
                begin = np.concatenate([[0], ends[:-1]])
                found = spans(np.frombuffer(b"".join(p for _, _, p in part), np.uint8), ends, length)
                if found is None:
                    continue
                head, whole, text, p0, n = found
                start = p0 - begin[text] + offset[text]
                yield pd.DataFrame(
                    {"head": head.view(np.int64), "whole": whole.view(np.int64), "uid": uid[row[text]], "at": (start << _RUN_BITS) | n}
                )

    return run


def refine(data: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Bucket number of each position, equal where the next `length` bytes are; numbers ascend in byte order.

    `last` is the end of each position's own text. Positions nearer to it than `length` get buckets that
    mean nothing and that no window reads.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(len(data), U64)
    for i in range(8):
        key = (key << U64(8)) | padded[i : i + len(data)]
    _, bucket = np.unique(key, return_inverse=True)
    depth = min(8, length)
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(bucket)
        # a bucket of one position is final; the others are sorted by the bucket `step` bytes on
        open_ = np.flatnonzero((size[bucket] > 1) & (np.arange(len(data)) + step < last))
        if not len(open_):
            break
        pair = (bucket[open_].astype(U64) << U64(32)) | bucket[open_ + step].astype(U64)
        order = np.argsort(pair)
        sorted_ = pair[order]
        changed = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        # ranks within the old bucket keep all numbers in byte order: old number first, then the new cut
        full = bucket.astype(U64) << U64(32)
        full[open_[order]] |= np.cumsum(changed).astype(U64)
        _, bucket = np.unique(full, return_inverse=True)
        depth += step
    return bucket


def _windows(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of windows that an earlier one here equals, and of heads in several parts each first window with its hash.

    Rows of the second kind have n = 0.
    """
    raw = frame["span"].tolist()
    sizes = np.array([len(r) for r in raw], np.int32)
    ends = np.cumsum(sizes, dtype=np.int32)
    data = np.frombuffer(b"".join(raw), np.uint8)
    bucket = refine(data, np.repeat(ends, sizes), length).astype(np.int32)
    # a span's place among the spans in order of document and start; several may be of one document
    uid, at = frame["uid"].to_numpy(), frame["start"].to_numpy()
    count = sizes - length + 1
    span = np.repeat(np.arange(len(raw), dtype=np.int32), count)
    inner = np.arange(len(span), dtype=np.int32) - np.repeat(np.cumsum(count, dtype=np.int32) - count, count)
    where = (ends - sizes)[span] + inner
    start = at[span] + inner
    documents, document = np.unique(uid, return_inverse=True)
    document = document.astype(np.int32)[span]
    order = np.lexsort((start, document, bucket[where])).astype(np.int32)
    b, u, s = bucket[where[order]], document[order], start[order]
    new = np.concatenate([[True], b[1:] != b[:-1]])
    # the same window may come twice where a long text was cut: an equal place is no repeat of itself
    first = np.maximum.accumulate(np.where(new, np.arange(len(b), dtype=np.int32), 0))
    repeat = (u != u[first]) | (s != s[first])
    heads = new & (frame["parts"].to_numpy()[span[order]] > 1)
    w = where[order[heads]]
    hashes = []
    for seed in (3, 4):
        hasher = range_hash(seed)
        hashes.append(mix(hasher.ranges(hasher.prefix(data), w, w + length)).view(np.int64))
    u_head, s_head = u[heads], s[heads]
    u, s = u[repeat], s[repeat]
    by_place = np.lexsort((s, u))
    u, s = u[by_place], s[by_place]
    cut = np.flatnonzero(np.concatenate([np.ones(min(len(u), 1), bool), (u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1)]))
    last = np.append(cut[1:], len(u))[: len(cut)] - 1
    nothing = np.zeros(len(cut), np.int64)
    return pd.DataFrame(
        {
            "uid": documents[np.concatenate([u[cut], u_head])],
            "start": np.concatenate([s[cut], s_head]),
            "n": np.concatenate([s[last] - s[cut] + 1, np.zeros(len(u_head), np.int64)]),
            "w1": np.concatenate([nothing, hashes[0]]),
            "w2": np.concatenate([nothing, hashes[1]]),
        }
    )


def _sorted_groups(length: int):
    """Sorts the windows of whole (head, part) groups, some megabytes of spans at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            while len(frame):
                group = frame["group"].to_numpy()
                if size >= BLOCK and held and group[0] != held[-1]["group"].iloc[-1]:
                    yield _windows(pd.concat(held, ignore_index=True), length)
                    held, size = [], 0
                room = np.cumsum(frame["span"].str.len().to_numpy())
                cut = len(frame)
                if size + room[-1] >= BLOCK:
                    # stop at the first change of group after the block is full
                    full = int(np.searchsorted(room, BLOCK - size))
                    later = np.flatnonzero(group[full + 1 :] != group[full:-1]) if full + 1 < len(group) else []
                    cut = full + 1 + int(later[0]) if len(later) else len(frame)
                held.append(frame.iloc[:cut])
                size += int(room[cut - 1])
                frame = frame.iloc[cut:]
        if held:
            yield _windows(pd.concat(held, ignore_index=True), length)

    return run


def _slices(length: int):
    """Bytes of the wanted spans of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uid, text, wanted in zip(frame["uid"], frame["text"], frame["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    start, n = w["at"] >> _RUN_BITS, w["at"] & ((1 << _RUN_BITS) - 1)
                    rows.append((w["head"], w["parts"], uid, start, raw[start : start + n + length - 1]))
            yield pd.DataFrame(rows, columns=["head", "parts", "uid", "start", "span"])

    return run


def repeated_windows(texts: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """(uid, start, n): runs of n windows from `start` on (in bytes) that are repeats. `texts` has uid and text.

    Null and short texts have no windows.
    """
    if not Q < length < (1 << _RUN_BITS):
        raise ValueError(f"length must be over {Q} and below {1 << _RUN_BITS}")
    plain = texts.where(F.length("text") * 4 >= length)
    all_spans = scratch.keep(
        plain.select("uid", "text").mapInPandas(_span_rows(length), "head long, whole long, uid long, at long"), "spans"
    )
    shared = all_spans.groupBy("head").agg(F.count("*").alias("_n")).where("_n > 1").select("head")
    scratch.keep(all_spans.join(shared, "head"), "shared")
    scratch.drop("spans")
    both = scratch.spark.read.schema("head long, whole long, uid long, at long").parquet(scratch.paths["shared"])
    first = F.min(F.struct("uid", "at")).alias("f")
    classes = scratch.keep(both.groupBy("head", "whole").agg(first, F.count("*").alias("n")), "classes")
    # equal spans after the first
    copied = both.join(classes.where("n > 1").select("head", "whole", "f"), ["head", "whole"]).where(
        "uid != f.uid OR at != f.at"
    )
    run_of = [F.shiftright("at", _RUN_BITS).alias("start"), F.col("at").bitwiseAND((1 << _RUN_BITS) - 1).alias("n")]
    copies = scratch.keep(copied.select("uid", *run_of), "copies")
    mixed = classes.groupBy("head").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / SHARE).cast("int").alias("parts")
    wanted = (
        classes.join(mixed.select("head", parts), "head")
        .groupBy(F.col("f.uid").alias("uid"))
        .agg(F.collect_list(F.struct("head", "parts", F.col("f.at").alias("at"))).alias("wanted"))
    )
    cut = plain.join(wanted, "uid").select("uid", "text", "wanted")
    # dealt out by a hash of head and document, so that a head with many different spans has many parts
    group = F.xxhash64("head", F.pmod(F.xxhash64("uid"), F.col("parts")))
    dealt = (
        cut.mapInPandas(_slices(length), "head long, parts int, uid long, start long, span binary")
        .withColumn("group", group)
        .repartition("group")
        .sortWithinPartitions("group")
    )
    columns = "uid long, start long, n long, w1 long, w2 long"
    sorted_ = scratch.keep(dealt.mapInPandas(_sorted_groups(length), columns), "sorted")
    # parts of a split head: of equal windows, only the first of all parts stays
    heads = sorted_.where("n = 0")
    best = heads.groupBy("w1", "w2").agg(F.min(F.struct("uid", "start")).alias("f"), F.count("*").alias("c")).where("c > 1")
    met = heads.join(best, ["w1", "w2"]).where("uid != f.uid OR start != f.start")
    one = F.lit(1).cast("long").alias("n")
    return copies.unionByName(sorted_.where("n > 0").select("uid", "start", "n")).unionByName(met.select("uid", "start", one))


def _runs(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered ranges, merged where they touch."""
    order = np.argsort(starts)
    lo = starts[order]
    hi = np.maximum.accumulate((starts + counts + length - 1)[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(new)
    return lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1]


def _whole_characters(raw: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The code points that lie wholly inside a range."""
    while lo < hi and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def _kept(length: int, characters: bool):
    def of(text, starts, counts) -> tuple:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        cuts = []
        if starts is not None and len(starts):
            cuts = list(zip(*_runs(np.asarray(starts), np.asarray(counts), length), strict=True))
        if characters:
            cuts = [(a, b) for a, b in (_whole_characters(raw, *s) for s in cuts) if a < b]
        left, at = [], 0
        for lo, hi in cuts:
            left.append(raw[at:lo])
            at = hi
        left.append(raw[at:])
        rest = b"".join(left)
        digest = hashlib.sha256(rest).hexdigest()
        return len(raw), len(raw) - len(rest), len(cuts), digest, rest.decode("utf-8", "replace") if characters else None

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    return lambda: lambda f: pd.DataFrame([of(*r) for r in zip(f["text"], f["starts"], f["counts"], strict=True)], columns=names)


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's `columns`, n_bytes, n_removed, n_spans and kept_sha256 after repeats are cut out.

    With `keep_text` also kept_text; cuts then shrink to whole code points. Null texts count as empty. Rows that share
    a doc_id, or have none, are separate documents, in the order of their texts.
    """
    scratch = Scratch(docs.sparkSession)
    texts = keyed(docs, list(dict.fromkeys([*columns, "text"])))
    found = repeated_windows(texts.select("uid", "text"), scratch, length)
    runs = found.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = texts.join(runs, "uid", "left")
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return computed(joined, list(columns), ["text", "starts", "counts"], _kept(length, keep_text), kinds)
