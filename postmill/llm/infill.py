"""Fill-in-the-middle rewriting of documents by one counted-quantifier match per text.

A text is a sequence of units (a run of A-Z letters, or any other code point). Two numbers drawn from a hash of doc_id
cut it after so many units. The cut is a pattern of the row's own: a possessive group of `a` units, a possessive
group of `b - a` units, the rest. Matching units is never ambiguous, so nothing backtracks, and one
replacement with that pattern writes prefix, middle and suffix in the order of the row's form.

Everything is a built-in function on the row itself: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the unit and the three marks
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARK = 3  # length of each mark


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 from the hash of `seed:doc_id`; without an id, of `seed:` alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def cut_pattern(first: Column, second: Column) -> Column:
    """Pattern whose groups are the first `first` units, those up to `second`, and the rest."""
    unit = f"(?:{UNIT})"
    parts = [F.lit(rf"\A({unit}{{"), first, F.lit(rf"}}+)({unit}{{"), second - first, F.lit(r"}+)([\s\S]*)\z")]
    return F.concat(*(p.cast("string") for p in parts))


def written(form: Column) -> Column:
    """How a form writes the groups of its cut."""
    spm = F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    return F.when(form == SPM, spm).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """The columns of `docs` under `doc`, then n (units), form, output, prefix_chars and middle_chars of each row.

    `plain` per cent of the texts stay as they are, and so do empty and null ones (output '') and those that hold a
    mark; of the others `spm` per cent put the suffix first. Lengths count code points and are null where the
    form is plain. Rows are judged one by one: repeated ids draw the same numbers, rows without an id those of
    an empty one. Extra columns cannot clash, since the row is kept in one struct.

    Memory: a text's units are listed once for counting, some 80 bytes each.
    """
    text, h = F.col("text_"), [F.col(f"h{i}") for i in range(1, 5)]
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.coalesce(docs["text"], F.lit("")).alias("text_"),
        *(x.alias(f"h{i}") for i, x in enumerate(draws(docs["doc_id"], seed), 1)),
    ).withColumn("n", F.regexp_count(text, F.lit(UNIT)).cast("bigint"))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    stays = (text == "") | marked | (h[2] % 100 >= 100 - plain)
    form = F.when(stays, PLAIN).when(h[3] % 100 < spm, SPM).otherwise(PSM)
    cuts = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.select("doc", "text_", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    moved = F.regexp_replace(text, cut_pattern(F.col("a"), F.col("b")), written(F.col("form")))
    rows = rows.select("doc", "n", "form", F.when(F.col("form") == PLAIN, text).otherwise(moved).alias("output"))
    return rows.select("doc", "n", "form", "output", *lengths(F.col("output"), F.col("form")))


def _places(output: Column) -> dict[str, Column]:
    """Where each mark starts, from 1. No text with a mark is cut, and no mark can straddle another one's edge."""
    return {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}


def lengths(output: Column, form: Column) -> list[Column]:
    at = _places(output)
    prefix = F.when(form == PSM, at[SUFFIX]).when(form == SPM, at[MIDDLE]) - at[PREFIX] - _MARK
    middle = F.when(form != PLAIN, F.char_length(output) - at[MIDDLE] - (_MARK - 1))
    return [prefix.cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars")]


def restore(output: Column, form: Column) -> Column:
    """The text that `transform` started from."""
    at = _places(output)

    def between(start: str, end: str) -> Column:
        return F.substring(output, at[start] + _MARK, at[end] - at[start] - _MARK)

    middle = F.substring(output, at[MIDDLE] + _MARK, F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, lengths, and SHA-256 of the output and of the text rebuilt from it."""
    out = transform(docs, seed)
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
