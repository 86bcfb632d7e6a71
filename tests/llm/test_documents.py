"""Operators on documents against plain versions, and on degenerate rows."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from postmill.llm import langid, licenses, lmscore, minhash, packing, spm, spotsigs, suffix, wavelet, words


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows_of(df)}


# 1 fingerprints


def test_spotsigs_edits(frame, stored):
    got = by_id(spotsigs.edited(frame(stored)))
    assert len(got) == len(stored)
    near, far, by_text = [], [], {}
    for k, (i, text) in enumerate(stored):
        following, n = stored[(k + 1) % len(stored)][1], len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(text, set()).add(r["fingerprint"])
        near.append(r["near_edited"])
        far.append(r["near_next"])
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean(near) > 0.5 and np.mean(far) < 0.05


def test_spotsigs_edges(frame, edges):
    got = rows_of(spotsigs.edited(frame(edges)))
    assert len(got) == len(edges)
    assert {r["doc_id"] for r in got} == {i for i, _ in edges}
    assert all(0 <= r["near_edited"] <= 1 and r["fingerprint"] and r["edited_sha256"] for r in got)
    assert rows_of(spotsigs.edited(frame([]))) == []
    assert rows_of(spotsigs.edited(frame([(1, "alone in the world")])))[0]["near_next"] == 1.0


def test_spotsigs_same_spots_at_every_length(frame):
    """Of a text with 39 content words, and of its copies with some more, all but the chains at the end are the same."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghklmn") for _ in range(6))
    rows, more = [], (0, 1, 2, 20)
    for k in range(40):
        text = " ".join(rng.choice(("", "", "the ", "of ")) + word() for _ in range(39))
        rows += [(10 * k + j, " ".join([text, *(word() for _ in range(n))])) for j, n in enumerate(more)]
    got = by_id(spotsigs.fingerprints(frame(rows)))
    for k in range(40):
        sets = [set(got[10 * k + j]["signatures"]) for j in range(len(more))]
        assert all(len(sets[0] - s) <= 1 and len(s - sets[0]) <= n + 1 for s, n in zip(sets, more, strict=True))
    members, links = spotsigs.similar(frame([r for r in rows if r[0] % 10 < 3]), 0.8)
    of = {r["doc_id"]: r["fingerprint"] for r in rows_of(members)}
    linked = {(r["a"], r["b"]) for r in rows_of(links)}
    near = [of[10 * k] == of[10 * k + 1] or tuple(sorted((of[10 * k], of[10 * k + 1]))) in linked for k in range(40)]
    assert sum(near) >= 36


def test_spotsigs_similar(frame, passages):
    rows = passages + [(10_000 + i, t) for i, t in passages[:5]]
    members, links = spotsigs.similar(frame(rows), 0.6)
    signed = by_id(spotsigs.fingerprints(frame(rows)))
    sets = {r["fingerprint"]: set(r["signatures"]) for r in signed.values()}
    want = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                want.add((a, b))
    got = rows_of(links)
    assert want and {(r["a"], r["b"]) for r in got} == want
    assert {(r["fingerprint"], r["doc_id"]) for r in rows_of(members)} == {(r["fingerprint"], i) for i, r in signed.items()}


# 2 packing


def test_packing_index_forgets_used_rests():
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 90, rng.integers(1, 60)).astype("<u2") for _ in range(80)]
    idf = rng.random(90)
    index, whole = packing.Shard(rests, idf, 30.0), packing.Shard(rests, idf, 30.0)
    unused = rng.random(80) < 0.4
    index.only(unused)
    assert len(index.doc) < 0.6 * len(whole.doc) and set(index.doc) == set(np.flatnonzero(unused))
    for i in range(80):
        assert (index.scores(index.terms[i])[unused] == whole.scores(whole.terms[i])[unused]).all()
        assert index.terms[i].tolist() == np.unique(rests[i]).tolist()


def test_packing(frame, stored):
    brute.check_packed(rows_of(packing.pack(frame(stored), brute.WORDS)), brute.word_ids(stored))


def test_packing_small_window_and_shards(frame, stored, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    brute.check_packed(rows_of(packing.pack(frame(stored), brute.WORDS, window=64)), brute.word_ids(stored), 64)


def test_packing_edges(frame, edges):
    got = rows_of(packing.pack(frame(edges), brute.WORDS))
    tokens = sum(r["length"] for r in got)
    assert tokens == sum(len(v) for i, v in brute.word_ids(list(enumerate(t for _, t in edges))).items())
    assert {r["doc_id"] for r in got} == {i for i, _ in edges}
    assert rows_of(packing.pack(frame([]), brute.WORDS)) == []


def test_neighbours_come_first():
    """A seed's window takes the rest that shares its rare tokens before others."""
    rests = [np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4]), np.array([1, 2, 9, 9]), np.array([5, 6, 7, 9])]
    sequences = packing.fill(rests, np.ones(16), 4.0, 8)
    assert [[i for i, _, _ in s] for s in sequences] == [[0, 3], [1, 2]]


def test_bm25_scores():
    rests = [np.array([1, 1, 2]), np.array([2, 3]), np.array([4])]
    idf = np.arange(6) / 2
    index = packing.Shard(rests, idf, 2.0)

    def score(q, d):
        out = 0.0
        for t in set(q.tolist()):
            f = (d == t).sum()
            out += idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / 2.0))
        return out

    for q in rests:
        assert np.allclose(index.scores(np.unique(q)), [score(q, d) for d in rests])


# 3 near-duplicates


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(frame, stored, passages, n):
    for rows in (stored, passages):
        want = brute.groups(rows, n)
        got = by_id(minhash.near_duplicates(frame(rows), words=n))
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["n_shingles"] == len(brute.shingles(t, n)) for (i, t) in rows for r in [got[i]])
        assert all(r["kept"] == (want[i] == i) for i, r in got.items())


def test_minhash_edges(frame, edges):
    got = rows_of(minhash.near_duplicates(frame(edges), words=2))
    assert len(got) == len(edges)
    assert {r["component_id"] for r in got if r["doc_id"] == 6} == {6}
    assert all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 8, 9, 10, 11))
    assert sum(r["kept"] for r in got if r["doc_id"] == 7) == 1  # one row of each text; "same text" belongs to 6
    assert rows_of(minhash.near_duplicates(frame([]), words=2)) == []


def test_minhash_chain(frame):
    """Links of a chain reach from end to end, though its ends are unlike."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"n{k}" for k in range(6 * i)] + base[6 * i :])) for i in range(20)]
    want = brute.groups(rows, 2)
    assert set(want.values()) == {0}
    assert {i: r["component_id"] for i, r in by_id(minhash.near_duplicates(frame(rows), words=2)).items()} == want


def test_signature_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 1800 / 2200) < 0.12


# 4 pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=brute.PIECES)


def test_pieces_of_documents(frame, stored, edges, library):
    got = by_id(spm.round_trip(frame(stored), brute.PIECES))
    for i, text in stored:
        ids = library.encode(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    plain = rows_of(spm.encode(frame(edges), brute.PIECES))
    assert len(plain) == len(edges)
    assert sorted((r["ids"], r["decoded"]) for r in plain) == sorted((library.encode(t or ""), library.decode(library.encode(t or ""))) for _, t in edges)
    assert rows_of(spm.round_trip(frame([]), brute.PIECES)) == []


ODD = ["a", "e", "th", " ", "  ", "▁", "\n", "é", "ﬁ", "!", "'s", "́", "<|endoftext|>", "<0x41>", "</s>", "😀", "\x1c", "\x85", "İ", "Σ", "99", "ﷺ", "中", "\x00", "\t", "K"]


def odd_texts(n):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    texts += ["".join(rng.choice("abcehilnorst") for _ in range(rng.randint(1, 25))) for _ in range(n)]
    return texts + [" " * k for k in range(50)] + ["a" * k for k in range(50)]


def test_pieces_of_odd_texts(library):
    model = spm.Pieces(brute.PIECES)
    for text in odd_texts(1500):
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_words_of_odd_texts():
    from tokenizers import Tokenizer

    texts, own = odd_texts(1500), words.WordEncoder(brute.WORDS)
    want = [e.ids for e in Tokenizer.from_file(brute.WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode(texts)] == want


# 5 licences


def test_licenses(frame, edges):
    notice = licenses.TEMPLATES["MIT"][1]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."),
        (2, notice),
        (3, "x " * 500 + "\n" + notice.upper()),
        (4, "released, UNDER the mit -- licence"),
        (5, "Licensed under CC BY-NC 4.0."),
        (6, "This is no licence at all"),
    ]
    got = by_id(licenses.scan(frame(rows)))
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "CC-BY-NC-4.0", 6: None}
    assert got[2]["dice"] == 1.0 and got[1]["n_units"] == 4
    assert len(rows_of(licenses.scan(frame(edges)))) == len(edges)
    assert rows_of(licenses.scan(frame([]))) == []
    assert rows_of(licenses.scan(frame([(1, "word")]), {"own": ("Word!",)}))[0]["license"] == "own"
    assert rows_of(licenses.scan(frame([(1, "word")]), {}))[0]["license"] is None


# 6 repeats


def test_repeats(frame, stored, passages, monkeypatch):
    for rows, share, block in ((stored, 4000, 1 << 20), (passages, 3, 1 << 11)):
        monkeypatch.setattr(suffix, "SHARE", share)
        monkeypatch.setattr(suffix, "BLOCK", block)
        got = by_id(suffix.remove_repeats(frame(rows)))
        want = brute.repeats(rows)
        assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
        assert sum(w[1] for w in want.values())


def test_repeats_edges(frame, edges):
    got = rows_of(suffix.remove_repeats(frame(edges)))
    assert len(got) == len(edges)
    assert sum(r["n_bytes"] - r["n_removed"] for r in got if r["doc_id"] == 9) == 1  # every later byte of a letter run is in a repeat
    # a period of 31 bytes stays of the first of two equal texts; the third text is document 6's
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 7) == [248, 279, 320]
    assert rows_of(suffix.remove_repeats(frame([]))) == []


def test_repeats_keep_characters(frame):
    text = "é" * 100
    got = by_id(suffix.remove_repeats(frame([(1, "a" + text), (2, "b" + text + "ü")]), keep_text=True))
    assert got[2]["kept_text"] == "bü"


def test_refined_buckets_are_a_suffix_order():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    bucket = suffix.refine(data, np.full(len(data), len(data)), 40)
    raw = data.tobytes()
    whole = [raw[i : i + 40] for i in range(len(raw) - 40)]
    rank = {w: k for k, w in enumerate(sorted(set(whole)))}
    order = sorted({int(b) for b in bucket[: len(whole)]})
    assert [order.index(int(b)) for b in bucket[: len(whole)]] == [rank[w] for w in whole]


# 7 language


def test_language(spark, sf, frame):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    network = langid.learn(docs, ~held)
    got = rows_of(langid.predict(docs.withColumn("held", held), network, ["doc_id", "lang", "held"]))
    judged = [r for r in got if r["held"]]
    assert len(judged) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in judged]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    # gradients: training lowers the loss of a network that starts at random
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_sample_with_a_hot_id(frame, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "PER_LANGUAGE", 10)
    monkeypatch.setattr(langid, "train", lambda windows, which, languages: (windows, which, languages))
    rows = [(7, f"hot number {i} " * 20) for i in range(30)] + [(100 + i, f"cold number {i} " * 20) for i in range(30)]
    windows, which, languages = langid.learn(frame(rows).withColumn("lang", F.lit("en")), F.lit(True))
    assert languages == ["en"] and len(which) == 10 * langid.PER_DOCUMENT
    hot = sum(b"hot" in bytes(w) for w in windows)
    assert 0 < hot < len(windows)
    # one id alone
    windows, _, _ = langid.learn(frame(rows[:30]).withColumn("lang", F.lit("en")), F.lit(True))
    assert len(windows) == 10 * langid.PER_DOCUMENT


def test_language_edges(spark, frame, edges):
    labelled = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in [(1, "alpha beta"), (2, "delta"), (3, None)]], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    network = langid.learn(labelled, F.lit(True))
    assert network.languages == ["xx", "yy"]
    got = rows_of(langid.predict(frame(edges), network, ["doc_id"]))
    assert len(got) == len(edges)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 11)} == {"und"}
    assert (1 << 62) + 1 in {r["doc_id"] for r in got}
    assert langid.learn(labelled.where("doc_id > 5"), F.lit(True)) is None
    assert {r["lang_pred"] for r in rows_of(langid.predict(frame(edges), None, ["doc_id"]))} == {"und"}


# 9 language-model scores


def test_scores(frame, spark):
    """Against models made anew for each document, from the texts of all others."""
    from collections import Counter
    from math import log2

    rows = [(1, "the cat sat on the mat"), (2, "the cat ran"), (3, "Buy now buy cheap"), (4, ""), (5, None), (6, "now the mat the cat")]
    got = by_id(lmscore.score(frame(rows), frame([(1, None), (2, None), (2, None), (None, None), (99, None)])))
    tokens = {i: (t or "").lower().split() for i, t in rows}
    size = {i: len(t) for i, t in tokens.items()}
    scale = (size[1] + size[2]) / sum(size.values())

    def loss(i, ids, weight):
        ids = [k for k in ids if k != i]
        words = Counter(w for k in ids for w in tokens[k])
        pairs = Counter(p for k in ids for p in zip(["<s>", *tokens[k]], tokens[k], strict=False))
        n = sum(words.values()) * weight
        losses = []
        for a, b in zip(["<s>", *tokens[i]], tokens[i], strict=False):
            anywhere = (words[b] * weight + 1000 / 2**17) / (n + 1000)
            behind = sum(c for (x, _), c in pairs.items() if x == a) * weight
            losses.append(-log2((pairs[a, b] * weight + 20 * anywhere) / (behind + 20)))
        return sum(losses) / len(losses)

    for i in (1, 2, 3, 6):
        target, background = loss(i, [1, 2], 1), loss(i, list(tokens), scale)
        assert got[i]["target_loss"] == pytest.approx(target, abs=1e-9)
        assert got[i]["background_loss"] == pytest.approx(background, abs=1e-9)
        assert got[i]["score"] == pytest.approx(target - background, abs=1e-9)
    assert got[3]["score"] > got[2]["score"]
    assert got[4]["score"] is None and got[5]["n_words"] == 0


def test_scores_without_target(frame):
    rows = [(1, "a b c"), (2, "a b"), (3, None)]
    got = by_id(lmscore.score(frame(rows), frame([])))
    assert got[1]["score"] == got[2]["score"] == 0 and got[1]["target_loss"] == pytest.approx(17)
    alone = by_id(lmscore.score(frame(rows[:1]), frame([(1, None)])))
    assert alone[1]["target_loss"] == alone[1]["background_loss"] == pytest.approx(17)


def test_scores_are_matched(frame):
    """Where target and corpus are prose of one kind, being in the target is no merit, whatever its share of the corpus."""
    import random

    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, range(1, 301), k=60))) for i in range(1000)]
    for step in (2, 10):
        got = by_id(lmscore.score(frame(rows), frame([(i, None) for i in range(0, 1000, step)])))
        inside, outside = ([r["score"] for i, r in got.items() if (i % step == 0) == own] for own in (True, False))
        assert abs(np.mean(inside) - np.mean(outside)) < 0.05


def test_scores_of_held_out_texts(frame, spark, sf):
    """Learned from half of the good texts, the others score below the bad ones, and about as those learned from."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    times = {}
    for t in texts.values():
        times[t] = times.get(t, 0) + 1
    good = [i for i, q in sorted(quality.items()) if q == 1 and i in texts and times[texts[i]] == 1]
    got = by_id(lmscore.score(docs, frame([(i, None) for i in good[::2]])))
    mean = lambda ids: np.mean([got[i]["score"] for i in ids if got[i]["score"] is not None])
    bad = [i for i, q in quality.items() if q == 0 and i in texts]
    scores = learned, held_out, worst = mean(good[::2]), mean(good[1::2]), mean(bad)
    assert held_out < worst, scores
    assert abs(learned - held_out) < (worst - held_out) / 2, scores
    pairs = [(got[g]["score"], got[b]["score"]) for g in good[1::2] for b in bad if got[g]["score"] is not None and got[b]["score"] is not None]
    assert np.mean([g < b for g, b in pairs]) > 0.7, (np.mean([g < b for g, b in pairs]), scores)


def test_scores_of_many_words(frame, monkeypatch):
    """More pairs than any fixed table has cells, in several chunks: rare words keep the counts of their own."""
    monkeypatch.setattr(lmscore, "CHUNK_WORDS", 1 << 17, raising=False)
    n = 1_000_000
    rows = [(i, " ".join(f"w{k}" for k in range(i * n // 20, (i + 1) * n // 20))) for i in range(20)]
    rows += [(20, "rare words mark this"), (21, "rare words mark this"), (22, "other words fill that")]
    got = by_id(lmscore.score(frame(rows), frame([(20, None), (21, None)])))

    def loss(pairs, behind, words, total):
        share = (np.array(words) + 1000 / 2**17) / (total + 1000)
        return -np.log2((np.array(pairs) + 20 * share) / (np.array(behind) + 20)).mean()

    # without its own words, the target of 20 is 21
    assert got[20]["target_loss"] == pytest.approx(loss([1] * 4, [1] * 4, [1] * 4, 4), abs=1e-9)
    by = 8 / (n + 12)
    rest = by * (n + 8)
    background = loss([by] * 4, [22 * by, by, 2 * by, by], [by, 2 * by, by, by], rest)
    assert got[20]["background_loss"] == pytest.approx(background, abs=1e-9)
    # no word of these is in another text, but texts have starts
    size = n // 20
    assert got[3]["n_words"] == size
    share = 1000 / 2**17 / (8 + 1000)
    first, other = -np.log2(20 * share / (2 + 20)), -np.log2(share)
    assert got[3]["target_loss"] == pytest.approx((first + (size - 1) * other) / size, abs=1e-9)


def test_scores_edges(frame, edges):
    assert len(rows_of(lmscore.score(frame(edges), frame([])))) == len(edges)
    assert rows_of(lmscore.score(frame([]), frame([(1, None)]))) == []


def test_scores_move_no_texts(frame, spark, monkeypatch):
    """Texts are cut where they are read, whatever the size of the target, and keys go through the shuffle in turns."""
    plans, keep = {}, lmscore.Scratch.keep

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(lmscore.Scratch, "keep", seen)
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(200)] + [(None, "w1 w2"), (3, "w3"), (900, "")]
    target = frame([(i, None) for i in (*range(0, 200, 3), None, 900)])
    want = rows_of(lmscore.score(frame(rows), target))
    most = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(most)
    spark.conf.set(most, -1)
    try:
        plans.clear()
        got = rows_of(lmscore.score(frame(rows), target))
    finally:
        spark.conf.set(most, before)
    assert "Exchange" not in plans["chunks"] and "Exchange" in plans["marks"]
    order = lambda rows: sorted(map(repr, rows))
    assert order(got) == order(want) and len(got) == len(rows)
    keys = np.sort(lmscore.mix(np.arange(1, 4097)))
    chunk = {"chunk": 5, "ids": [1], "sizes": [len(keys)], "words": lmscore._gaps(keys), "at": lmscore._planes(np.arange(len(keys)), 4), "chosen": b"\x80"}
    made = [pa.Table.from_batches(lmscore._asked(8, t)([pa.RecordBatch.from_pylist([chunk])])) for t in range(lmscore.TURNS)]
    buckets = [b for t in made for b in t.column("bucket").to_pylist()]
    assert sorted(buckets) == sorted(set(buckets)) == list(range(256)) and max(t.num_rows for t in made) <= 86
    asked = [lmscore._keys(raw) for t in made for raw in t.column("keys").to_pylist()]
    every = sum(int(lmscore._numbers(raw, 4).sum()) for t in made for raw in t.column("every").to_pylist())
    assert len(np.unique(np.concatenate(asked))) == sum(map(len, asked)) == every == 3 * len(keys)


# 10 wavelet files


def test_wavelet_file_lookups():
    import io

    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 50, 5000).astype(np.uint32)
    raw = wavelet.pack(tokens, np.array([2000, 0, 3000]), np.array([7, 8, 0]), np.array([True, True, False]), 16)
    file = wavelet.WaveletFile(io.BytesIO(raw))
    assert (file.tokens() == tokens).all()
    assert file.column("lengths").tolist() == [2000, 0, 3000] and file.column("known").tolist() == [1, 1, 0]
    for i in (0, 1, 777, 4999):
        assert file.access(i) == tokens[i]
    for value in (0, 7, 49, 50, 70_000):
        where = np.flatnonzero(tokens == value)
        assert file.rank(value, 5000) == len(where)
        assert file.rank(value, 1234) == (where < 1234).sum()
        for k in (0, len(where) - 1):
            if len(where):
                assert file.select(value, k) == where[k]
    for bad in (lambda: file.access(5000), lambda: file.select(50, 0)):
        with pytest.raises(IndexError):
            bad()
    empty = wavelet.WaveletFile(io.BytesIO(wavelet.pack(tokens[:0], tokens[:0], tokens[:0], tokens[:0], 16)))
    assert len(empty.tokens()) == 0 and empty.rank(3, 9) == 0


def test_wavelet_blocks(monkeypatch):
    import io

    monkeypatch.setattr(wavelet, "BLOCK_BITS", 64)
    tokens = np.random.default_rng(5).integers(0, 9, 1000).astype(np.uint32)
    file = wavelet.WaveletFile(io.BytesIO(wavelet.pack(tokens, tokens[:0], tokens[:0], tokens[:0], 4)))
    assert [file.access(i) for i in range(1000)] == tokens.tolist()
    for value in range(9):
        where = np.flatnonzero(tokens == value)
        assert [file.select(value, k) for k in range(len(where))] == where.tolist()
        assert [file.rank(value, e) for e in range(0, 1001, 50)] == [(where < e).sum() for e in range(0, 1001, 50)]


def test_wavelet_round_trip(spark, frame, stored, edges, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 20_000)
    ids, start = brute.word_ids(stored), 0
    got = by_id(wavelet.round_trip(spark, frame(stored), brute.WORDS))
    for i, _ in stored:
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids[i]), brute.crc(ids[i]))
        start += len(ids[i])
    odd = rows_of(wavelet.round_trip(spark, frame(edges), brute.WORDS))
    assert sorted((r["doc_id"] or -1) for r in odd) == sorted((i or -1) for i, _ in edges)
    assert rows_of(wavelet.round_trip(spark, frame([]), brute.WORDS)) == []
