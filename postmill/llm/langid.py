"""Language identification by a small convolutional network over bytes.

Bytes are embedded; filters of several widths slide over a window of fixed length; the highest response of each
filter goes through a softmax layer. A text's language is the one with the highest mean probability over all
of its windows, weighted by their bytes. The network is trained in numpy on windows of labelled texts.

The learning sample is bounded by PER_LANGUAGE documents of each language, those with the smallest hashed ids, and
PER_DOCUMENT windows of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.rows import bounded_batches, computed, keyed

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 12, 8
PER_LANGUAGE, PER_DOCUMENT = 600, 4
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: byte embedding, filters by width, output layer. Byte 0 also fills up short windows."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * EMBEDDING, FILTERS)
    biases: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Each width's filters as sums of tables: (offset, table over a byte or a pair of bytes)."""
        out = []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            per_byte = [self.embedding @ weights[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(width)]
            parts = [(i, (per_byte[i][:, None] + per_byte[i + 1][None]).reshape(-1, FILTERS)) for i in range(0, width - 1, 2)]
            if width % 2:
                parts.append((width - 1, per_byte[-1]))
            out.append([(at, np.ascontiguousarray(t, np.float32)) for at, t in parts])
        return out

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        """Softmax outputs of (n, WINDOW) bytes."""
        single = windows.astype(np.int32)
        pair = (single[:, :-1] << 8) | single[:, 1:]
        pooled = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            places = WINDOW - width + 1
            total = None
            for at, table in parts:
                index = pair if len(table) > 256 else single
                found = np.take(table, index[:, at : at + places], axis=0)
                total = found if total is None else np.add(total, found, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.biases, 0)
        return softmax(hidden @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on cross-entropy; classes weigh the same. Only each filter's best place gets a gradient."""
    rng = np.random.default_rng(seed)
    classes, n_filters = len(languages), FILTERS * len(WIDTHS)
    weights = [rng.normal(0, 0.3, (256, EMBEDDING))]
    weights += [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS]
    weights += [np.zeros(n_filters), rng.normal(0, 0.2, (n_filters, classes)), np.zeros(classes)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    share = np.bincount(labels, minlength=classes)
    weight = len(labels) / (classes * np.maximum(share, 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            x, y = windows[at], labels[at]
            embedding, filters, (biases, out, out_bias) = weights[0], weights[1:-3], weights[-3:]
            embedded = embedding[x]
            pooled, patches, bytes_ = [], [], []
            for width, f in zip(WIDTHS, filters, strict=True):
                places = WINDOW - width + 1
                response = sum(embedded[:, j : j + places] @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(width))
                best = response.argmax(axis=1)  # (batch, filters)
                pooled.append(np.take_along_axis(response, best[:, None], axis=1)[:, 0])
                where = best[:, :, None] + np.arange(width)
                bytes_.append(np.take_along_axis(x[:, None, :], where, axis=2))
                patches.append(embedding[bytes_[-1]].reshape(len(at), FILTERS, -1))
            raw = np.concatenate(pooled, axis=1) + biases
            hidden = np.maximum(raw, 0)
            delta = softmax(hidden @ out + out_bias)
            delta[np.arange(len(at)), y] -= 1
            delta *= (weight[y] / len(at))[:, None]
            back = (delta @ out.T) * (raw > 0)
            to_embedding, to_filters = np.zeros_like(embedding), []
            for k, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                to_filters.append(np.einsum("bf,bfp->pf", own, patches[k]))
                spread = (own[:, :, None] * f.T[None]).reshape(len(at), FILTERS, width, EMBEDDING)
                np.add.at(to_embedding, bytes_[k], spread)
            gradients = [to_embedding, *to_filters, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for w, g, m, v in zip(weights, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    small = [w.astype(np.float32) for w in weights]
    return Network(languages, small[0], small[1:-3], *small[-3:])


def windows_of(raw: bytes) -> np.ndarray:
    """A text's bytes in rows of WINDOW, the last one filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def _has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def _samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows at places drawn by the document's hash; every other one is cut short, as short texts are."""
    for frame in frames:
        rows = []
        for key, lang, text in zip(frame["key"], frame["lang"], frame["text"], strict=True):
            if not _has_letter(text):
                continue
            raw = text.encode("utf-8", "replace")
            rng = np.random.default_rng(key & ((1 << 63) - 1))
            for i in range(PER_DOCUMENT):
                at = int(rng.integers(0, max(1, len(raw) - WINDOW // 2)))
                size = WINDOW if i % 2 == 0 else int(rng.integers(12, WINDOW))
                rows.append((lang, raw[at : at + size].ljust(WINDOW, b"\0")))
        yield pd.DataFrame(rows, columns=["lang", "window"])


def learn(docs: DataFrame, may_learn: Column) -> Network | None:
    """A network from the labelled rows for which `may_learn` holds; None without any."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(may_learn).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # rows under one id are documents of their own, drawn one by one
    labelled = keyed(labelled, ["lang", "text"])
    key = F.xxhash64(F.col("uid").cast("string"))
    order = Window.partitionBy("lang").orderBy("key", "uid")
    chosen = labelled.select("uid", "lang", key.alias("key")).withColumn("r", F.row_number().over(order))
    # bounded: PER_LANGUAGE rows of each language
    chosen = F.broadcast(chosen.where(F.col("r") <= PER_LANGUAGE).select("uid", "lang", "key"))
    texts = labelled.join(chosen, ["uid", "lang"]).select("key", "lang", "text")
    sample = texts.mapInPandas(_samples, "lang string, window binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "window"], kind="stable")
    languages = sorted(sample["lang"].unique())
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(languages, sample["lang"].to_numpy(str)), languages)


def _predicted(network: Network | None):
    def make():
        tables = network.tables() if network else None

        def compute(frame: pd.DataFrame) -> pd.DataFrame:
            predictions, scores = [UNKNOWN] * len(frame), np.zeros(len(frame))
            held, size = [], 0

            def judge(held) -> None:
                all_ = np.concatenate([w for _, w, _ in held])
                found = np.concatenate([network.probabilities(all_[i : i + 32], tables) for i in range(0, len(all_), 32)])
                at = 0
                for i, w, n in held:
                    part = found[at : at + len(w)]
                    share = np.full(len(w), WINDOW, float)
                    share[-1] = n - WINDOW * (len(w) - 1)
                    mean = (part * share[:, None]).sum(axis=0) / n
                    best = int(mean.argmax())
                    predictions[i], scores[i] = network.languages[best], min(1.0, float(mean[best]))
                    at += len(w)

            for i, text in enumerate(frame["text"]):
                if not network or not _has_letter(text):
                    continue
                raw = text.encode("utf-8", "replace")
                held.append((i, windows_of(raw), len(raw)))
                size += len(held[-1][1])
                if size >= 1024:
                    judge(held)
                    held, size = [], 0
            if held:
                judge(held)
            return pd.DataFrame({"lang_pred": predictions, "score": scores})

        return compute

    return make


def predict(docs: DataFrame, network: Network | None, columns: list[str]) -> DataFrame:
    """`columns` of each row, lang_pred and score (its mean probability), row by row.

    Null texts and texts without a letter are UNKNOWN with score 0, and so is everything without a network.
    """
    bounded_batches(docs.sparkSession)
    return computed(docs, columns, ["text"], _predicted(network), "lang_pred string, score double")
