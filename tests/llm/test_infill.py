"""Fill-in-the-middle rewriting against a cut by a list of units."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import infill


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, seed=1):
    text = text or ""
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df, rows):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in df.collect())
    want = []
    for i, text in rows:
        n, form, p, m, out = plain(i, text)
        want.append((i is not None, i or 0, n, form, str(p), str(m), sha(out), sha(text or "")))
    assert got == sorted(want)


def test_documents(frame, stored):
    rows = stored + [(10_000 + i, t[:k]) for i, t in stored[:60] for k in (1, 7, 60)]
    check(infill.digests(frame(rows)), rows)
    forms = {r.form for r in infill.digests(frame(rows)).select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_odd_texts(frame, edges):
    rng = random.Random(4)
    parts = ["a", "Zq", "<", "P>", "<P", ">", "<S", "<P>", "<S>", "<M>", "é", "😀", "\n", "\r", " ", "\x00", "$1", "\\", "{2}", " ", "́", "ﬁ", "[", "日本"]
    rows = edges + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(-5, "negative id"), (20_001, "é" * 200_000), (20_002, "\n" * 200_000), (20_003, "😀x" * 100_000), (20_004, "a b" * 300_000)]
    check(infill.digests(frame(rows)), rows)
    check(infill.digests(frame([])), [])


def test_outputs_and_extra_columns(spark):
    rows = [(7, "one two three", 1, "x", "o", None), (7, "one two three", 2, None, "p", 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string, text_ int")
    out = infill.transform(docs, seed=3, plain=0, spm=100)
    got = sorted((r.doc.n or 0, r.doc.output, r.doc.text_, r.n, r.form, r.output) for r in out.collect())
    want = plain(7, "one two three", 3)
    assert want[0] == 5 and all(r[3] == 5 and r[4] == "spm" and r[5].startswith("<S>") for r in got[1:])
    assert got[0] == (0, None, None, 0, "plain", "") and [r[:3] for r in got[1:]] == [(1, "o", None), (2, "p", 3)]
    restored = out.select(infill.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in restored) == ["", "one two three", "one two three"]


@pytest.mark.parametrize("plain_share, spm_share, want", [(100, 0, {"plain"}), (0, 0, {"psm"}), (0, 100, {"spm"})])
def test_shares(frame, plain_share, spm_share, want):
    out = infill.transform(frame([(i, "some text") for i in range(50)]), plain=plain_share, spm=spm_share)
    assert {r.form for r in out.collect()} == want


def test_no_python_and_no_shuffle(frame, capsys):
    infill.digests(frame([(1, "a b")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
