"""Markup as arrays of tag tokens: one array per page, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.text import decode_entities

# Bodies of script and style are not markup; their tags stay for src and type.
_NOT_MARKUP = (
    r"(?is)<!--.*?-->"
    r"|(<script\b[^>]*>).*?(</script\s*>)"
    r"|(<style\b[^>]*>).*?(</style\s*>)"
)
_TOKEN = (
    r"<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)"
    r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>([^<]*+)"""
)
_TOKEN_HEAD = r"(?s)^</?([a-zA-Z][a-zA-Z0-9:\-]*)"
_TOKEN_ATTRS = (
    r"""(?s)^</?[a-zA-Z][a-zA-Z0-9:\-]*((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>"""
)
_TOKEN_TEXT = (
    r"""(?s)^</?[a-zA-Z][a-zA-Z0-9:\-]*(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>(.*)$"""
)
_ATTRIBUTE = r"""[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_ATTRIBUTE_VALUE = r"""(?s)^[^=]+=\s*["']?(.*?)["']?$"""

# Elements that never have content.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)


def markup_only(html: Column) -> Column:
    """The page without comments and without the bodies of script and style."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _NOT_MARKUP, "$1$2$3$4")


def attribute_list(raw: Column) -> Column:
    """Attributes of one tag as ``array<struct<name,value>>``, names lower-cased, values decoded."""
    pairs = F.regexp_extract_all(raw, F.lit(_ATTRIBUTE), F.lit(0))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)).alias("name"),
            decode_entities(F.regexp_extract(p, _ATTRIBUTE_VALUE, 1)).alias("value"),
        ),
    )


def tokens(html: Column) -> Column:
    """Tags of a page in order, each with its attributes and the text that follows it."""
    found = F.regexp_extract_all(markup_only(html), F.lit(_TOKEN), F.lit(0))
    return F.transform(
        found,
        lambda t: F.struct(
            F.startswith(t, F.lit("</")).alias("is_close"),
            F.lower(F.regexp_extract(t, _TOKEN_HEAD, 1)).alias("tag"),
            attribute_list(F.regexp_extract(t, _TOKEN_ATTRS, 1)).alias("attrs"),
            F.regexp_extract(t, _TOKEN_TEXT, 1).alias("text"),
        ),
    )


def attr(token: Column, name: str) -> Column:
    """Value of the first attribute called ``name``; null when the tag has none."""
    match = F.filter(token.getField("attrs"), lambda a: a.getField("name") == name)
    return F.get(match, F.lit(0)).getField("value")


def opens(token: Column, *tags: str) -> Column:
    return ~token.getField("is_close") & token.getField("tag").isin(*tags)


def filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))
