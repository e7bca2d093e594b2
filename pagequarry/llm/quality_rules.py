"""Quality rules as a ledger of bits: every rule is evaluated once, policies are masks over the bits."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import per_row

WINDOW = 8
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_upper bigint, n_lines bigint, n_letters bigint, n_bang_words bigint"
)
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_UPPER = re.compile(rb"[A-Z]")
_NOT_LETTER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F\x80-\xBF]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a run of ``window`` words that the text has twice or more.

    Exact: words get numbers, then runs of 2, 4, 8 words get numbers by pairs of the numbers before.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return (
        len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words),
        len(_UPPER.findall(text)), len(lines), len(_NOT_LETTER.sub(b"", text)), sum(w.endswith(b"!!") for w in words),
    )


def measured(docs: DataFrame, body: str = "text") -> DataFrame:
    """All columns of ``docs`` and the measurements of its texts (null: no words)."""
    def compute(columns: list[list]) -> list[list]:
        return [list(c) for c in zip(*map(measure, columns[0]), strict=True)]

    return per_row(docs, [body], MEASURES, compute)


@dataclass(frozen=True)
class Rule:
    """A rule's place in the ledger, its name, and when it fails."""

    bit: int
    name: str
    fails: str


#: A bit is never given to another rule; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_runs", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "upper_case", "2 * n_upper > n_letters"),
    Rule(4, "repeated_lines", "n_lines > 2 and 2 * n_dup_lines > n_lines"),
    Rule(5, "short_or_long_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(6, "few_letters", "2 * n_letters < word_chars"),
    Rule(7, "shouting", "10 * n_bang_words > 3 * n_words"),
    Rule(8, "some_repeated_runs", "100 * n_repeat_words > 15 * n_words"),
)
#: Version of a policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_runs"),
    "v1": ("few_words", "repeated_runs", "symbols", "upper_case", "repeated_lines"),
    "v2": ("few_words", "repeated_runs", "symbols", "upper_case", "repeated_lines", "short_or_long_words", "few_letters", "shouting"),
}


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def ledger(measures: DataFrame) -> DataFrame:
    """The measurements and ``failures``: bit i is set if rule i fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measures.withColumn("failures", total.cast("bigint"))


def rejected(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Of each rule of a policy: rows that fail it, and rows that only it rejects (they return if it goes)."""
    used = [r for r in RULES if r.name in POLICIES[policy]]
    of_policy = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    sums = book.select(of_policy.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))  # at most one row for each set of rules
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in used]))
    per = sums.select("f", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"),
    )
    return per.withColumn("policy", F.lit(policy))


def rules_query(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, the base measurements, base_failed, kept and the ledger of every row. Null texts have no words and fail the base."""
    book = ledger(measured(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text"))
    base = rejected("base")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~rejected(policy)).alias("kept"), "failures", "n_upper", "n_lines", "n_letters", "n_bang_words",
    )


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS run FROM w),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM often) GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines,
    length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_letters,
    len(list_filter(words, lambda x: x LIKE '%!!')) AS n_bang_words
  FROM d LEFT JOIN covered ON covered.r = d.r),
f AS (SELECT *, {' | '.join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  failures & {mask("v2") | mask("base")} = 0 AS kept, failures, n_upper, n_lines, n_letters, n_bang_words
FROM f
"""
