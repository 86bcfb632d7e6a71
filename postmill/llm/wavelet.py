"""Token ids in wavelet-matrix files, one per shard of documents.

A shard's ids are stored as bit planes, highest bit first. Below each plane the ids with a 0 bit come
before those with a 1 bit, in stable order. Planes are cut into compressed blocks; the ones before each block are
counted. So one file answers, from a few of its blocks, which id stands at a place (`access`), how often an id occurs
before a place (`rank`) and where its k-th occurrence is (`select`).

File: magic, length of the header, header (JSON: counts, sections), sections. Tasks write and read files through
the file system of the shared folder's URI; a file gets its final name once it is complete.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.rows import Scratch, computed, keyed
from postmill.llm.words import word_encoder
from postmill.session import new_path

MAGIC = b"PMWM0001"
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 22  # a file ends with the document that reaches so many


def pack(tokens: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, bits: int) -> bytes:
    """File contents. `known` is false for documents without an id."""
    sections, planes, at = [], [], 0

    def add(raw: bytes) -> list[int]:
        nonlocal at
        sections.append(raw)
        at += len(raw)
        return [at - len(raw), len(raw)]

    x = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for bit in range(bits - 1, -1, -1):
        blocks, counts, low, high = [], [0], [], []
        for i in range(0, len(x), BLOCK_BITS):
            part = x[i : i + BLOCK_BITS]
            ones = (part & x.dtype.type(1 << bit)) != 0
            blocks.append(add(zlib.compress(np.packbits(ones).tobytes(), 1)))
            low.append(part.compress(~ones))
            high.append(part.compress(ones))
            counts.append(counts[-1] + len(high[-1]))
        planes.append({"blocks": blocks, "ones": counts})
        x = np.concatenate([x[:0], *low, *high])
    columns = {
        name: add(zlib.compress(a.astype(kind).tobytes(), 1))
        for name, a, kind in (("lengths", lengths, "<i8"), ("doc_ids", doc_ids, "<i8"), ("known", known, "u1"))
    }
    header = json.dumps({"n": len(tokens), "bits": bits, "planes": planes, "columns": columns}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *sections])


class WaveletFile:
    """Reads a file's blocks as they are needed. `source` has seek and read."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = int.from_bytes(source.read(8), "little")
        head = json.loads(source.read(size))
        self.n, self.bits, self.planes, self.columns = head["n"], head["bits"], head["planes"], head["columns"]
        self.body = 16 + size
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, place: list[int]) -> bytes:
        self.source.seek(self.body + place[0])
        return zlib.decompress(self.source.read(place[1]))

    def column(self, name: str) -> np.ndarray:
        return np.frombuffer(self._section(self.columns[name]), {"known": "u1"}.get(name, "<i8"))

    def _block(self, plane: int, i: int) -> np.ndarray:
        if (plane, i) not in self._blocks:
            rest = min(BLOCK_BITS, self.n - i * BLOCK_BITS)
            raw = np.frombuffer(self._section(self.planes[plane]["blocks"][i]), np.uint8)
            self._blocks[plane, i] = np.unpackbits(raw, count=rest)
        return self._blocks[plane, i]

    def _ones(self, plane: int, end: int) -> int:
        """1 bits before `end`."""
        i, rest = divmod(end, BLOCK_BITS)
        return self.planes[plane]["ones"][i] + (int(self._block(plane, i)[:rest].sum()) if rest else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - self.planes[plane]["ones"][-1]

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, at // BLOCK_BITS)[at % BLOCK_BITS])
            ones = self._ones(plane, at)
            at = self._zeros(plane) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _path(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's ids begin below the last plane, and where those before `end` stop."""
        lo, hi = 0, end
        for plane in range(self.bits):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if value >> (self.bits - 1 - plane) & 1:
                zeros = self._zeros(plane)
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of `value` before `end`."""
        if not 0 <= value < 1 << self.bits:
            return 0
        lo, hi = self._path(value, min(max(end, 0), self.n))
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence, k from 0."""
        if k < 0 or k >= self.rank(value, self.n):
            raise IndexError(k)
        at = self._path(value, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            wanted = at - self._zeros(plane) if bit else at
            counts = np.array(self.planes[plane]["ones"])
            if not bit:
                counts = np.minimum(np.arange(len(counts)) * BLOCK_BITS, self.n) - counts
            i = int(np.searchsorted(counts, wanted, side="right")) - 1
            block = self._block(plane, i)
            at = i * BLOCK_BITS + int(np.flatnonzero(block == bit)[wanted - counts[i]])
        return at

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest to the highest."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            low, high = 0, self._zeros(plane)
            y = np.empty_like(x)
            for i in range(len(self.planes[plane]["blocks"])):
                ones = self._block(plane, i).view(bool)
                part = y[i * BLOCK_BITS : i * BLOCK_BITS + len(ones)]
                at = np.flatnonzero(~ones)
                part[at] = x[low : low + len(at)]
                low += len(at)
                at = np.flatnonzero(ones)
                part[at] = x[high : high + len(at)] | x.dtype.type(1 << (self.bits - 1 - plane))
                high += len(at)
            self._blocks.clear()
            x = y
        return x.astype(np.uint32)


def _encoded(path: str, end_id: int):
    def make():
        encoder = word_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        return lambda frame: pd.DataFrame({"ids": [x + end for x in encoder.encode(frame["text"].tolist())]})

    return make


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _written(folder: str, width: int, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), 0

        def write(held: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal made
            frame = pd.concat(held, ignore_index=True)
            tokens = np.frombuffer(b"".join(frame["ids"]), f"<u{width}")
            lengths = frame["ids"].str.len().to_numpy() // width
            raw = pack(tokens, lengths, frame["doc_id"].to_numpy(), frame["known"].to_numpy(), bits)
            name = f"{part:08d}-{made:06d}.wm"
            made += 1
            part_file = f"{root}/{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(part_file) as out:
                out.write(raw)
            files.move(part_file, f"{root}/{name}")
            return pd.DataFrame({"name": [name], "n_tokens": [len(tokens)], "n_docs": [len(frame)], "n_bytes": [len(raw)]})

        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += int(frame["ids"].str.len().sum()) // width
            if size >= SHARD_TOKENS:
                yield write(held)
                held, size = [], 0
        if held:
            yield write(held)

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order over the files; returns a row per file.

    Null texts have only the end id. Documents without a doc_id come first; equal ids are ordered by text.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    encoder = word_encoder(tokenizer)
    texts = keyed(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    texts = texts.select("uid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    ids = scratch.keep(computed(texts, ["uid", "doc_id", "known"], ["text"], _encoded(tokenizer, end_id), "ids binary"), "ids")
    ordered = ids.repartitionByRange("uid").sortWithinPartitions("uid")
    bits = max(1, max(encoder.size - 1, end_id).bit_length())
    run = _written(folder, encoder.dtype.itemsize, bits)
    files = ordered.mapInPandas(run, "name string, n_tokens long, n_docs long, n_bytes long")
    path = new_path(spark, "shards")
    files.write.parquet(path)
    scratch.drop("ids")
    return spark.read.schema(files.schema).parquet(path)


def _read(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _file_system(folder)
        for frame in frames:
            for name, start in zip(frame["name"], frame["start"], strict=True):
                with files.open_input_file(f"{root}/{name}") as source:
                    file = WaveletFile(source)
                    tokens = file.tokens().astype("<u4")
                    lengths, ids = file.column("lengths"), file.column("doc_ids")
                    known = file.column("known").astype(bool)
                ends = np.cumsum(lengths)
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                doc_id = pd.array(ids, dtype="Int64")
                doc_id[~known] = pd.NA
                yield pd.DataFrame({"doc_id": doc_id, "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)})

    return run


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    # one row per file, so the running total over file names is bounded by the number of files
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    # by number, as files are few rows but much work: coalesced by size they would all meet in one task
    dealt = placed.repartition(max(1, files.count()), "name")
    return dealt.mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    folder = new_path(spark, "wavelet")
    return read_shards(write_shards(docs, folder, tokenizer, end_id), folder)
