"""Text helpers as column expressions."""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.binding import let

RAW_TEXT_ELEMENTS = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
)
# Possessive, so a page with unbalanced quotes cannot make the matcher backtrack.
ANY_TAG = r"""</?[a-zA-Z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|<[!?][^>]*+>"""


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space (Unicode-wide) become one blank; ends are stripped; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def truncate(text: Column, limit: int = 500) -> Column:
    """Cut to ``limit`` characters, the last three being dots when something was cut."""
    value = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(value, 1, limit - 3), F.lit("..."))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def strip_control(text: Column) -> Column:
    """Drop control characters other than tab and line breaks."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 0 for blank text."""
    return let(normalize_whitespace(text), words_of_normalized)


def words_of_normalized(tidy: Column) -> Column:
    """Word count of text whose white space is already normalised."""
    blanks = F.length(tidy) - F.length(F.replace(tidy, F.lit(" "), F.lit("")))
    return F.when(tidy == "", F.lit(0)).otherwise(blanks + 1).cast("bigint")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase occurs; plain byte search, several times faster than one alternation."""
    out = F.contains(text, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        out = out | F.contains(text, F.lit(phrase))
    return out


# What stands behind the "&" of a character reference.
_REFERENCE = r"^([a-zA-Z][a-zA-Z0-9]{1,31}|#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7});"


@functools.cache
def _named_references() -> str:
    return "\u0001".join(f"{name[:-1]}\u0002{chars}" for name, chars in html5.items() if name.endswith(";"))


def _by_name(name: Column) -> Column:
    """What a named reference stands for, else null. The map is made from constants, so it is folded into one literal."""
    return F.try_element_at(F.str_to_map(F.lit(_named_references()), F.lit("\u0001"), F.lit("\u0002")), name)


@functools.cache
def _legacy() -> str:
    """Names that browsers also know without a semicolon, longest first, and numbers without one."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return rf"^({'|'.join(names)}|#[xX][0-9a-fA-F]{{1,6}}(?![0-9a-fA-F])|#[0-9]{{1,7}}(?![0-9]))"


def _code_point(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^#[xX]?([0-9a-fA-F]+)$", 1)
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("bigint")

    def to_char(n: Column) -> Column:
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")

    return let(number, to_char)


def _decode(text: Column, legacy: bool) -> Column:
    def piece(p: Column, i: Column) -> Column:
        def of(ref: Column, behind: int) -> Column:
            char = F.when(F.startswith(ref, F.lit("#")), _code_point(ref)).otherwise(_by_name(ref))
            return F.concat(char, F.substring(p, F.length(ref) + 1 + behind, F.length(p)))

        found = [let(F.regexp_extract(p, _REFERENCE, 1), lambda ref: of(ref, 1))]
        if legacy:
            found.append(let(F.regexp_extract(p, _legacy(), 1), lambda ref: of(ref, 0)))
        return F.when(i == 0, p).otherwise(F.coalesce(*found, F.concat(F.lit("&"), p)))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def decode_entities(text: Column, legacy: bool = False) -> Column:
    """Decode all named and numeric character references, each once, from left to right; unknown names stay.

    With ``legacy`` also those without a semicolon that browsers know in text (in attributes, ``?a=1&copy=2`` is a link).
    """
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), _decode(t, legacy)).otherwise(t))


def visible_text(html: Column) -> Column:
    """Readable text: raw-text elements, comments and tags out, entities decoded, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, RAW_TEXT_ELEMENTS, " "), ANY_TAG, " ")
    return normalize_whitespace(decode_entities(bare, legacy=True))
