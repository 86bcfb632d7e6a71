"""Text rules on string columns; everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that decide what counts as a link, mention, tag and word
LINK = r"""https?://(?:www\.)?([^\s]+[^\s.,!?:;'"()\[\]{}*])"""
MENTION = r"(?<=^|[> ])([@#])([A-Za-z0-9_\-</>]+)"
FIRST_MENTION = r"(?:^|[> ])@([A-Za-z0-9_]+)"
TAG = r"</?[a-z]+>"
WORD = r"[\p{L}\p{M}\p{N}_]"
LETTER, DIGIT = r"[\p{L}\p{M}]", r"\p{N}"
# fixed values: signs that keep a word together between two letters, and between two digits
BETWEEN_LETTERS, BETWEEN_DIGITS = "['‘’.:·]", "['‘’.,;]"
# possessive, so that the matcher needs no stack however long a word is
WORDS = f"(?:{LETTER}++(?:{BETWEEN_LETTERS}{LETTER}++)*+|{DIGIT}++(?:{BETWEEN_DIGITS}{DIGIT}++)*+|_++)++"
# fixed values: ordered alphabet of the 6-bit text code
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
# what a JavaScript-style trim removes
UNICODE_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def replace_matches(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Replace every match of `pattern` by a function of the match.

    `split` yields one gap more than there are matches, so gaps and replaced matches interleave.
    `text` is evaluated twice; pass a lambda variable or a plain column.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replacement)
    pieces = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.array_join(pieces, "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def encode_uri_component(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def build_url(path: Column | str, params: dict[str, Column]) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    pairs = [F.concat(F.lit(f"{key}="), encode_uri_component(v)) for key, v in params.items()]
    return F.concat(path, F.lit("?"), F.concat_ws("&", *pairs))


def _link(match: Column) -> Column:
    path = F.regexp_extract(match, LINK, 1)
    label = F.regexp_replace(F.regexp_extract(path, "[^#]+", 0), r"/\z", "")
    return F.concat(
        F.lit('<a href="'), strip_tags(match), F.lit('" target="_blank">'), label, F.lit("</a>")
    )


def _search_link(match: Column) -> Column:
    href = build_url("/search", {"q": strip_tags(match)})
    return F.concat(F.lit('<a href="'), href, F.lit('">'), match, F.lit("</a>"))


def format_text(text: Column) -> Column:
    """Plain text to HTML: a paragraph per line, links, and mentions and hashtags as search links."""
    paragraphs = F.split(F.regexp_replace(text, r"[\r\n]+\z", ""), r"[\r\n]+", -1)
    linked = F.transform(paragraphs, lambda p: replace_matches(p, LINK, _link))
    tagged = F.transform(linked, lambda p: replace_matches(p, MENTION, _search_link))
    wrapped = F.transform(tagged, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))
    only_breaks = text.rlike(r"^[\r\n]+\z")
    return F.when(only_breaks, "").otherwise(F.array_join(wrapped, ""))


def first_mention(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FIRST_MENTION, 1), F.lit(""))


def file_extension(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?s)^.*\.([^.]+)\z", 1), F.lit(""))


def clean_query(query: Column) -> Column:
    return F.regexp_replace(query, "[!*?]", "")


def clean_handle(handle: Column) -> Column:
    return F.lower(F.trim(handle))


def is_publishable(body: Column) -> Column:
    """True when something is left after trimming all Unicode space."""
    return ~body.rlike(rf"^{UNICODE_SPACE}*\z")


def encode_number(number: Column, length: int) -> Column:
    """Fixed-width text code, 6 bits per character, most significant first; keeps numeric order."""
    chars = [
        F.substring(F.lit(ALPHABET), (F.shiftright(number, 6 * i).bitwiseAND(63) + 1).cast("int"), F.lit(1))
        for i in range(length - 1, -1, -1)
    ]
    return F.concat(*chars)


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, marks, digits and underscores.

    Apostrophes and full stops between two letters or two digits belong to the word, as do colons between letters and
    commas and semicolons between digits: `don't`, `3.14` and `1,000` are one word each.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
