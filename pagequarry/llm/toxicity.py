"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_list, bounded_labels, held_out, logistic, per_row, slices

#: Folded letters. Letters, digits and signs that are drawn alike become one letter; i, l and 1 are one class.
ALIKE = {
    "a": "4@αаɑ", "b": "8вЬβ", "c": "сϲ", "d": "ԁ", "e": "3еεё", "g": "9ɡ", "h": "һн", "i": "l1іιı|ӏ", "j": "ј", "k": "кκ",
    "m": "м", "n": "пη", "o": "0оοσø", "p": "рρ", "q": "ԛ", "s": "5ѕ", "t": "7тτ", "u": "υцμ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2",
}
#: Terms that count before anything is learned, by weight.
SEED_TERMS = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "loser": 2.5, "worthless": 2.0, "pathetic": 2.0, "imbecile": 3.0, "retard": 3.0, "bastard": 3.0}
THRESHOLD = 0.7


class _Fold(dict):
    """Code point to folded text; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Mn", "Cf", "Me"):
            out = ""
        else:
            base = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn").lower()
            out = "".join(self.letters.get(c, c) for c in base)
            if not out.isalnum():
                out = " "
        self[code] = out
        return out


def _folder() -> tuple[_Fold, re.Pattern]:
    table = _Fold()
    table.letters = {c: to for to, many in ALIKE.items() for c in many if c.isalnum()}
    return table, re.compile(r"(?<=[^\W_])[@$|](?=[^\W_])")


_TABLE, _SIGNS = _folder()


def fold(text: str) -> str:
    """Lower-case, without accents and zero-width characters, look-alikes and digit substitutions replaced, one blank
    or more between words."""
    if not text.isascii() or "@" in text or "$" in text or "|" in text:
        text = _SIGNS.sub(lambda m: {"@": "a", "$": "s", "|": "i"}[m[0]], text)
    return text.lower().translate(_TABLE)


@dataclass(frozen=True)
class Lexicon:
    """Terms (" word " whole, " prefix" at the start of words) with weights, phrases in which they don't count,
    and the logistic weights of (log of the total, log of the density, 1)."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.6, 1.2, -4.0)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.machine, self.curve = ahocorasick.Automaton(), lexicon.curve
        for term, weight in lexicon.terms:
            self.machine.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, padded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that count: of those that start at one word the heaviest, and none inside an exception."""
        if not len(self.machine):
            return []
        found: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(padded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif start not in found or weight > found[start][1]:
                found[start] = (end, weight)
        excused.sort()
        out, covered, at = [], -1, 0
        for start in sorted(found):
            while at < len(excused) and excused[at][0] <= start:
                covered = max(covered, excused[at][1])
                at += 1
            if start >= covered:
                out.append((start, *found[start]))
        return out

    def measure(self, text: bytes | None) -> tuple[int, int, float]:
        """Words, hits and total weight of a whole text."""
        padded = f" {' '.join(fold((text or b'').decode('utf-8', 'replace')).split())} "
        found = self.hits(padded)
        return max(0, padded.count(" ") - 1), len(found), sum(w for *_, w in found)

    def score(self, words: int, weight: float) -> float:
        x = features(words, weight)
        z = sum(a * b for a, b in zip(self.curve, [*x, 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(words: int, weight: float) -> tuple[float, float]:
    """The total weight and the weight per hundred words, both on a log scale; short texts are treated as 20 words."""
    return math.log1p(weight), math.log1p(100 * weight / max(20, words))


def _affixes(words: set[str], shortest: int = 4, longest: int = 8) -> Iterator[str]:
    for w in words:
        if len(w) >= 3:
            if len(w) <= 24:
                yield f" {w} "
            for n in range(shortest, min(longest, len(w) - 1) + 1):
                yield " " + w[:n]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = (Counter(), Counter())

    def rows():
        names = list(both[0].keys() | both[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in both)], ["term", "clean", "toxic"])

    for batch in batches:
        for part in slices(batch, ["body"]):
            for text, label in zip(as_list(part.column("body")), part.column("label").to_pylist(), strict=True):
                both[label].update(set(_affixes(set(fold((text or b"").decode("utf-8", "replace")).split()))))
        if len(both[0]) + len(both[1]) > 1_000_000:
            yield rows()
            both = (Counter(), Counter())
    if both[0] or both[1]:
        yield rows()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, most_terms: int = 2000) -> Lexicon:
    """Learn terms, exceptions and the curve from labelled documents.

    Bounds of the fit: ``per_class`` labelled ids of each class, drawn by the hash of the id, and ``most_terms`` terms.
    Rows with crc32(doc_id) mod 3 = 1 are never used. Terms are words or beginnings of words whose document
    counts differ between the classes by more than chance explains among all counted terms (G-test). Phrases of a
    term and its neighbour that only clean texts have become exceptions. Without labels of both classes the seed
    terms and the default curve hold.
    """
    seed = tuple((f" {fold(t)} ", w) for t, w in SEED_TERMS.items())
    ids = bounded_labels(labels, label, ~held_out("doc_id", 3, 1), per_class)
    sample = (
        docs.select("doc_id", F.col("text").cast("string").alias("body"))
        .join(F.broadcast(ids), "doc_id").select("body", "label")  # at most 2 * per_class ids
        .groupBy("body").agg(F.max("label").alias("label")).where("body is not null")
    )
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(seed)
    n0, n1 = sizes[0], sizes[1]
    counted = sample.mapInArrow(_counts, "term string, clean bigint, toxic bigint").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = n1 / (n0 + n1)
    total = F.col("clean") + F.col("toxic")

    def part(seen: str, of: float):
        return F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (total * of))).otherwise(0.0)

    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    scored = counted.withColumn("weight", odds).withColumn("g", 2 * (part("toxic", share) + part("clean", 1 - share)))
    many = max(10, scored.count())
    best = (
        scored.where((F.col("weight") > 1.5) & (F.col("g") > 2 * math.log(many)))
        .orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(most_terms).collect()
    )
    terms: dict[str, float] = {}
    for r in best:  # the strongest of a word's beginnings stands for the others
        if not any(r.term.startswith(t) or t.startswith(r.term) for t in (*(r.term[:n] for n in range(5, 10)), r.term) if t in terms) and not any(
            t.startswith(r.term) for t in terms
        ):
            terms[r.term] = round(float(r.weight), 6)
    for term, weight in seed:
        if not any(term.startswith(t) for t in terms):
            terms[term] = weight
    plain = Matcher(Lexicon(tuple(terms.items())))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(as_list(batch.column("body")), batch.column("label").to_pylist(), strict=True):
                words = fold((text or b"").decode("utf-8", "replace")).split()
                padded = f" {' '.join(words)} "
                phrases = set()
                for start, _, _ in plain.hits(padded):
                    i = padded.count(" ", 0, start)
                    phrases |= {" ".join(words[max(0, i - 1):i + 1]), " ".join(words[i:i + 2])}
                seen[y].update(p for p in phrases if " " in p)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["phrase", "clean", "toxic"])

    excused = (
        sample.mapInArrow(neighbours, "phrase string, clean bigint, toxic bigint").groupBy("phrase")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean >= 3 and toxic = 0")
        .orderBy(F.desc("clean"), "phrase").limit(most_terms).collect()
    )
    lexicon = Lexicon(tuple(sorted(terms.items())), tuple(sorted(r.phrase for r in excused)))
    got = _measured(sample, lexicon, "body").select("label", "n_words", "weight").collect()  # at most 2 * per_class rows
    x = np.array([features(r.n_words, r.weight) for r in got])
    curve = logistic(x, np.array([r.label for r in got]))
    return Lexicon(lexicon.terms, lexicon.exceptions, tuple(round(float(v), 9) for v in curve))


def _measured(df: DataFrame, lexicon: Lexicon, body: str) -> DataFrame:
    kept: list[Matcher] = []

    def compute(columns: list[list]) -> list[list]:
        if not kept:
            kept.append(Matcher(lexicon))
        rows = [kept[0].measure(t) for t in columns[0]]
        return [[r[0] for r in rows], [r[1] for r in rows], [float(r[2]) for r in rows], [kept[0].score(r[0], r[2]) for r in rows]]

    return per_row(df, [body], "n_words bigint, n_hits bigint, weight double, score double", compute)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, n_words, n_hits, weight, score, predicted) of every row, from its whole text.

    Null and empty texts have no words and no hits and get the curve's lowest score. Repeated rows stay.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("body"))
    got = _measured(rows, lexicon, "body")
    return got.select(F.col("id").alias(key), "n_words", "n_hits", "weight", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, body: str = "text") -> DataFrame:
    """The documents whose score stays under the threshold, with their columns as they were."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    marked = docs.select(row.alias("row"), F.col(body).cast("string").alias("body"))
    kept = _measured(marked, lexicon, "body").where(F.col("score") < THRESHOLD)
    return kept.select("row.*")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the hits of every document."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "n_words", "n_hits", "weight")
