"""XML text templates on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    # the ampersand first, so that later entities are not escaped again
    for char, entity in [("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def open_tag(name: str, attrs: dict[str, Column | str], depth: int) -> Column:
    parts = [F.lit("  " * depth + "<" + name)]
    for key, value in attrs.items():
        value = F.coalesce(_text(value), F.lit(""))
        parts += [F.lit(f' {key}="'), escape(value), F.lit('"')]
    return F.concat(*parts, F.lit(">"))


def leaf(name: str, attrs: dict[str, Column | str], text: Column | str | None, depth: int) -> Column:
    """An element on one line, with escaped text or nothing inside."""
    inner = [] if text is None else [escape(_text(text))]
    return F.concat(open_tag(name, attrs, depth), *inner, F.lit(f"</{name}>\n"))


def branch(name: str, attrs: dict[str, Column | str], children: list[Column], depth: int) -> Column:
    """An element whose children, already rendered at depth + 1, stand on lines of their own."""
    kids = [F.coalesce(child, F.lit("")) for child in children]
    return F.concat(
        open_tag(name, attrs, depth), F.lit("\n"), *kids, F.lit("  " * depth + f"</{name}>\n")
    )
