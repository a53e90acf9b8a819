"""Plain text, title and description of HTML as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_BLOCK = r"(?i)</?(?:p|div|br|h[1-6]|li|tr|article|section|header|footer|nav|ul|ol|table|blockquote)\b[^>]*>"


def unescaped(text: Column) -> Column:
    """The entities of ENTITIES, the ampersand last."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _closed(text: Column, begin: str, end: str, sign: str) -> Column:
    """Puts a sign before each `begin` that an `end` follows: from there a search for the end succeeds, so all of them take one pass."""
    mark = lambda t, n: F.concat(F.regexp_replace(F.left(t, n), f"(?i){begin}", f"{sign}$0"), F.substr(t, n + 1))
    head = lambda t: F.length(F.regexp_extract(t, f"(?is)^(.*{end})", 1))
    return let(text, lambda t: let(head(t), lambda n: F.when(n == 0, t).otherwise(mark(t, n))))


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; one line for each block; no blank lines. Linear in the length."""
    text = F.translate(html, "\x02\x03\x04", "")
    text = _closed(_closed(text, "<!--", "-->", "\x02"), "<(?:script|style)", "</(?:script|style)>", "\x03")
    text = F.regexp_replace(text, r"(?is)\x03<(?:script|style)[^<>]*+>.*?</(?:script|style)>|\x02<!--.*?-->", "")
    text = F.regexp_replace(_closed(text, "<title", "</title>", "\x04"), r"(?is)\x04<title[^<>]*+>.*?</title>", "")
    text = F.translate(text, "\x02\x03\x04", "")
    # behind the last > there is no tag
    bare = lambda t, n: F.concat(F.regexp_replace(F.regexp_replace(F.left(t, n), _BLOCK, "\n"), r"<[^>]+>", ""), F.substr(t, n + 1))
    text = let(text, lambda t: let(F.length(t) - F.length(F.substring_index(t, ">", -1)), lambda n: bare(t, n)))
    return F.array_join(F.filter(F.transform(F.split(unescaped(text), "\n"), stripped), lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    marked = _closed(F.translate(html, "\x04", ""), "<title", "</title *>", "\x04")
    found = F.regexp_extract(marked, r"(?is)\x04<title[^<>]*+>(.*?)</title *>", 1)
    return F.nullif(stripped(unescaped(F.translate(found, "\x04", ""))), F.lit(""))


def meta_description(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)", 1), F.lit(""))


def heading_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<h[1-6][\s>]"))
