"""Dictionary blocks: only those that may hold a matching term are read, and no match is lost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from postmill.operators import search as S


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_no_near_term_is_lost():
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("abcé") for _ in range(rng.randint(0, most)))
    skipped = 0
    for _ in range(3000):
        terms = sorted({word(7) for _ in range(rng.randint(1, 8))})
        wanted, distance = word(6), rng.randint(0, 2)
        may = S.near_between(wanted, distance, terms[0], terms[-1])
        skipped += not may
        assert may or all(edits(wanted, t) > distance for t in terms)
    assert skipped > 300
    assert S.near_between("there", 1, "zaa", "zzz") and not S.near_between("there", 1, "zzaa", "zzzz")
    assert S.near_between("there", 2, "xxthere", "xxthere") and not S.near_between("there", 2, "xxxthere", "xxxtherf")


def test_blocks_are_pruned(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}{k}" for a in "abcdefgh" for b in "mnop" for k in range(10)]
    posts = spark.createDataFrame([(i, " ".join(rng.sample(words, 40))) for i in range(50)], "id long, body string")
    built = S.build_index(posts.withColumn("created", F.timestamp_seconds(F.lit(0))))
    path = str(tmp_path / "index")
    S.write_index(built, path, buckets=4, block=20)
    index = S.read_index(spark, path)
    terms = {r.term for r in built.postings.select("term").distinct().collect()}
    assert len(index.blocks) == -(-len(terms) // 20)
    ordered = sorted(index.blocks)
    assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:], strict=False))
    for clause, most, right in [
        (S.prefix("cn"), 2, lambda t: t.startswith("cn")),
        (S.term_range("dm3", "dn2"), 2, lambda t: "dm3" <= t <= "dn2"),
        (S.wildcard("f?1"), 3, lambda t: t[0] == "f" and t[2:] == "1"),
        (S.wildcard("*7"), len(ordered), lambda t: t.endswith("7")),
        (S.fuzzy("go5", 1), len(ordered) - 1, lambda t: edits(t, "go5") <= 1),
        (S.prefix("zz"), 0, lambda t: False),
    ]:
        found = S.dictionary_of(index, [], [clause])
        assert {r.term for r in found.collect()} == {t for t in terms if right(t)}, clause.label
        read = [b for b in index.blocks if clause.between(b[1], b[2])]
        assert len(read) <= most, (clause.label, len(read))
        hits = {(r.id, r.score) for r in S.matches(index, must=[clause]).collect()}
        assert hits == {(r.id, r.score) for r in S.matches(built, must=[clause]).collect()}
    execution = S.dictionary_of(index, [], [S.prefix("cn")])._jdf.queryExecution()
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "block" in filters, filters

