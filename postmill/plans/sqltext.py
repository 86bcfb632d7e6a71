"""SQL renderings of text rules, for the cross-checks only."""

from __future__ import annotations

from postmill.functions import text as X

_LINK = X.LINK.replace("'", "''")
# the text before a mention is part of the match here, as this engine cannot look back
_MENTION = r"(^|[> ])([@#])([A-Za-z0-9_\-</>]+)"

# one rule on both sides; this engine never backtracks, so it needs and knows no possessive forms
WORDS = X.WORDS.replace("++", "+").replace("*+", "*").replace("'", "''")


def interleave_sql(text: str, pattern: str, replacement: str, var: str = "z") -> str:
    """Gaps and replaced matches joined; `replacement` refers to the match as {m}."""
    match = replacement.replace("{m}", f"{var}[2]")
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), "
        f"regexp_extract_all({text}, '{pattern}')), lambda {var}: {var}[1] || coalesce({match}, '')), '')"
    )


def strip_tags_sql(text: str) -> str:
    return f"regexp_replace({text}, '{X.TAG}', '', 'g')"


def format_text_sql(text: str) -> str:
    link = (
        f"""'<a href="' || {strip_tags_sql('{m}')} || '" target="_blank">' || """
        f"""regexp_replace(regexp_extract(regexp_extract({{m}}, '{_LINK}', 1), '[^#]+'), '/$', '') || '</a>'"""
    )
    symbol = f"(regexp_extract({{m}}, '{_MENTION}', 2) || regexp_extract({{m}}, '{_MENTION}', 3))"
    tag = (
        f"""regexp_extract({{m}}, '{_MENTION}', 1) || '<a href="/search?q=' || url_encode({strip_tags_sql(symbol)}) || '">' """
        f"""|| {symbol} || '</a>'"""
    )
    linked = f"list_transform(regexp_split_to_array(regexp_replace({text}, '[\\r\\n]+$', ''), '[\\r\\n]+'), lambda p: {interleave_sql('p', _LINK, link, 'y')})"
    tagged = f"list_transform({linked}, lambda p: '<p>' || {interleave_sql('p', _MENTION, tag, 'z')} || '</p>')"
    return f"array_to_string({tagged}, '')"


def highlight_sql(body: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    marked = interleave_sql(body, WORDS, f"CASE WHEN lower({{m}}) IN ({listed}) THEN '<em>' || {{m}} || '</em>' ELSE {{m}} END", "h")
    return f"nullif({marked}, {body})"
