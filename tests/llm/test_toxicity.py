"""Class-conditional models against sums over dictionaries, and held-out labels."""

import math
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import toxicity

PART = "crc32(cast(doc_id as string)) % 4 <> 2"


def tokens(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")]


class Plain:
    """The same models, word by word."""

    def __init__(self, texts, toxic, least_previous, least_pair):
        triples, after, previous = [set(), set()], [defaultdict(set), defaultdict(set)], defaultdict(set)
        for text, c in zip(texts, toxic, strict=True):
            ws = tokens(text)
            for i, w in enumerate(ws):
                before = ws[i - 1] if i else None
                triples[c].add((ws[i - 2] if i > 1 else ("^" if i == 1 else "^^"), before, w))
                after[c][w].add(before)
                previous[w].add(before)
        total = sum(map(len, previous.values()))
        n = len(previous)
        self.base = lambda w: (max(len(previous[w]) - 0.75, 0) / total if w in previous else 0) + 0.75 * n / total / (n + 1)
        self.known = {w for w, p in previous.items() if len(p) >= least_previous}
        self.lower, self.left, self.pair = [], [], []
        for c in (0, 1):
            counts = {w: len(p) for w, p in after[c].items()}
            self.lower.append(self.order(counts, sum(counts.values())))
            pair, uses = defaultdict(int), defaultdict(int)
            for _, before, w in triples[c]:
                pair[before, w] += 1
                uses[before] += 1
            d = self.off(pair.values())
            taken = defaultdict(float)
            for (before, _), k in pair.items():
                taken[before] += d[min(k, 3)]
            self.left.append({b: taken[b] / u for b, u in uses.items()})
            self.pair.append({p: (k, (k - d[min(k, 3)]) / uses[p[0]]) for p, k in pair.items()})
        met = defaultdict(int)
        for c in (0, 1):
            for p, (k, _) in self.pair[c].items():
                met[p] += k
        self.kept = {p for p, k in met.items() if k >= least_pair}

    @staticmethod
    def off(counts):
        n = [sum(k == j for k in counts) for j in range(6)]
        share = n[1] / max(n[1] + 2 * n[2], 1)
        raw = [k - (k + 1) * share * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        return [0, *(min(max(x, 0.1 * k), (0.95, 1.9, 2.8)[k - 1]) for k, x in enumerate(raw, 1))]

    def order(self, counts, total):
        d = self.off(counts.values())
        rest = sum(d[min(k, 3)] for k in counts.values()) / total
        return lambda w: (counts.get(w, 0) - d[min(counts.get(w, 0), 3)]) / total + rest * self.base(w)

    def ratios(self, text):
        ws, out = tokens(text), []
        for i, w in enumerate(ws):
            before = ws[i - 1] if i else None
            if (before, w) in self.kept:
                p = [self.pair[c].get((before, w), (0, 0))[1] + self.left[c].get(before, 1) * self.lower[c](w) for c in (0, 1)]
                out.append(math.log(p[1] / p[0]))
                continue
            word = w if w in self.known else "not in any text"
            back = [self.left[c].get(before, 1) for c in (0, 1)] if before in self.known else [1, 1]
            out.append(math.log(back[1] / back[0]) + math.log(self.lower[1](word) / self.lower[0](word)))
        return out


@pytest.mark.parametrize("least", [(1, 1), (2, 3), (5, 10)])
def test_models(stored, least, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_PREVIOUS", least[0])
    monkeypatch.setattr(toxicity, "LEAST_PAIR", least[1])
    rng = random.Random(6)
    texts = ["", None, "it is", *(t for _, t in stored[:80])]
    toxic = [rng.random() < 0.3 for _ in texts]
    plain = Plain(texts, toxic, *least)
    model = toxicity.fit(*toxicity.words(texts), np.array(toxic))
    others = [t for _, t in stored[70:110]] + ["one", "", "Ünïcode it IS", None]
    keys, bounds = toxicity.words(others)
    want = [x for t in others for x in plain.ratios(t)]
    assert len(keys) == len(want) and np.allclose(model.ratios(keys, bounds), want, atol=1e-4)
    for x, t in zip(toxicity.features(model, keys, bounds), others, strict=True):
        r = plain.ratios(t)
        runs = [max((sum(r[i : i + n]) / n for i in range(len(r) - n + 1)), default=sum(r) / max(len(r), 1)) for n in toxicity.RUNS]
        assert np.allclose(x, [*runs, sum(r) / max(len(r), 1), math.log1p(len(r))], atol=1e-4)


def test_logistic_has_no_slope_left():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5] - 0.7)))).astype(float)
    weight = np.where(y == 1, 0.3, 1.2)

    def loss(w):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-3 * ((w[:-1] * x.std(axis=0)) ** 2).sum()

    w = toxicity.logistic(x, y, weight, ridge=1e-3)
    for i in range(4):
        step = np.eye(4)[i] * 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-2


def test_held_out(spark):
    """Toxic documents that were not learned from are found, and clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score(docs, toxicity.learn(docs, labels, F.expr(PART)), ["doc_id"])
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    true = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    caught = [found[i].predicted for i, t in true.items() if t]
    wrong = [found[i].predicted for i, t in true.items() if not t]
    assert len(caught) > 100 and sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_edges(spark, edges):
    rows = [(i, t, "s", 0.5, k) for k, (i, t) in enumerate(edges)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double, key int")
    marks = [(6, 1), (7, 0), (8, 0), (10, 1), (3, 0), (2, None), (1, 1), (None, 1), (99, 1), (6, 1), (6, 0)]
    labels = spark.createDataFrame([(i, t, 1, "x") for i, t in marks], "doc_id long, toxic int, quality int, text string")
    judge = toxicity.learn(docs, labels, F.lit(True))
    assert judge.model is not None
    got = toxicity.score(docs, judge, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    again = toxicity.score(docs, toxicity.learn(docs, labels, F.lit(True)), ["doc_id"]).collect()
    assert sorted((r.score, str(r.doc_id)) for r in got) == sorted((r.score, str(r.doc_id)) for r in again)
    one = toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, one, ["doc_id"]).collect()} == {0.0}
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), judge, ["doc_id"]).collect() == []


def test_sample_is_bounded(spark, monkeypatch):
    """Copies count once, and about as many texts as the bound says are drawn."""
    monkeypatch.setattr(toxicity, "ORDINARY", (100, 1 << 20))
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same words again' ELSE concat('text number n', id % 1000, 'x') END AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 3 = 1 AND id % 1000 < 50 AS INT) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda keys, bounds, toxic, rate: seen.append((len(toxic), toxic.sum(), rate)))
    toxicity.learn(docs, labels, F.lit(True))
    n, toxic, rate = seen[0]
    assert 40 <= toxic <= 50 and 70 <= n - toxic <= 140 and abs(rate - toxic / 1001) < 0.01


def test_learns_from_all(spark, stored, monkeypatch):
    """The distributed counts give the models of `fit` over all different texts; no bound of the sample matters."""
    monkeypatch.setattr(toxicity, "ORDINARY", (1, 1))
    monkeypatch.setattr(toxicity, "LONGEST", 10)
    monkeypatch.setattr(toxicity, "LEAST_PREVIOUS", 2)
    monkeypatch.setattr(toxicity, "LEAST_PAIR", 3)
    texts = list(dict.fromkeys(["", "it is", *(t for _, t in stored[:60] if t is not None)]))
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxic = [i % 3 == 0 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    keys, bounds = toxicity.words(texts)
    want = toxicity.fit(keys >> np.uint64(toxicity.SHORT), bounds, np.array(toxic))
    judge = toxicity.learn_all(docs, labels, F.lit(True))
    got = judge.model
    assert np.array_equal(got.words, want.words) and np.array_equal(got.pairs, want.pairs) and len(want.pairs) > 20
    for name in ("lower", "backoff", "higher"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-5)
    assert toxicity.learn_all(docs, labels.where("toxic = 0"), F.lit(True)).model is None


def test_curve_from_sums(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -1] + 0.2)))).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, y int")
    assert np.allclose(toxicity.logistic_of(rows, ["a", "b"], "y"), toxicity.logistic(x, y.astype(float), np.ones(300)), atol=1e-4)


def _labelled(spark, stored):
    texts = list(dict.fromkeys(t for _, t in stored[:60] if t is not None))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, toxic int")


def test_model_of_any_size(spark, stored, monkeypatch):
    """No number of words or pairs raises the bounds, and a model in many files, of which a worker holds few, judges as one in memory."""
    for name, value in (("LEAST_PREVIOUS", 2), ("LEAST_PAIR", 3), ("FILE", 20), ("BLOCK", 2), ("HELD", 500), ("GATHERED", 3000)):
        monkeypatch.setattr(toxicity, name, value)
    monkeypatch.setattr(toxicity, "MODEL_WORDS", 3, raising=False)
    monkeypatch.setattr(toxicity, "MODEL_PAIRS", 3, raising=False)
    texts, docs, labels = _labelled(spark, stored)
    keys, bounds = toxicity.words(texts)
    want = toxicity.fit(keys >> np.uint64(toxicity.SHORT), bounds, np.arange(len(texts)) % 3 == 0)
    want.short = toxicity.SHORT
    judge = toxicity.learn_all(docs, labels, F.lit(True))
    got = judge.model
    assert np.array_equal(got.words, want.words) and np.array_equal(got.pairs, want.pairs) and len(got.files["pairs"]) > 4 and got.gathered
    others = [*(t for _, t in stored[50:90]), "", None, "Ünïcode it IS"]
    keys, bounds = toxicity.words(others)
    assert np.allclose(got.ratios(keys, bounds), want.ratios(keys, bounds), atol=1e-5)
    asked = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string").coalesce(2)
    found = {r.doc_id: r.score for r in toxicity.score(asked, judge, ["doc_id"]).collect()}
    assert np.allclose([found[i] for i in range(len(others))], toxicity.Judge(want, judge.weights).scores(others), atol=1e-4)


def test_model_stays_out_of_the_driver(spark, stored, monkeypatch):
    """What tasks are given are names of files; where Python cannot open these, Spark hands the model out."""
    texts, docs, labels = _labelled(spark, stored)
    judge = toxicity.learn_all(docs, labels, F.lit(True))
    assert len(pickle.dumps(judge)) < 4000
    monkeypatch.setattr(toxicity, "_file_system", lambda path: (_ for _ in ()).throw(OSError("no such store")))
    other = toxicity.learn_all(docs.limit(0), labels, F.lit(True))
    assert other.model is None
    scratch = toxicity.Scratch(spark)
    pairs = spark.range(400).selectExpr("id % 20 AS before", "id AS word", "cast(id % 3 as int) AS t0", "cast(9 + id % 5 as int) AS t1")
    plain = toxicity.fit_counts(pairs, scratch, "plain")
    monkeypatch.undo()
    stored_one = toxicity.fit_counts(pairs, scratch, "stored")
    assert isinstance(plain, toxicity.Model) and isinstance(stored_one, toxicity.Stored) and len(plain.pairs) > 100
    for name in ("words", "pairs", "lower", "backoff", "higher"):
        assert np.array_equal(getattr(plain, name), getattr(stored_one, name))
