"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

A task writes its documents as a shard: for each term the places of the documents that hold it, in compressed blocks of
128, and for each block the pairs (occurrences, length) that no other pair of the block beats. A score rises with
occurrences and falls with length, so these pairs give a block's largest score whatever the totals of the corpus are,
and the index is written in one pass.

A search takes a shard's lists of the terms asked for. Lists whose largest scores together can't lift a document into
the best found so far are non-essential: documents are drawn from the other lists alone, and a document whose score
there, with the block maxima of the non-essential lists, stays below the worst of the best is dropped before any of
these blocks is decompressed. The best of all shards are merged.

Documents without a term, and null texts, are not found. Rows with one id are documents of their own. Ids that are null
come last among equal scores. Items that are equal in id and text are searched once; items without a term find nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import LOWER, UPPER, as_list, ascii_lower, slices
from pagequarry.session import materialize

#: What a query returns for each item.
BEST = 50
BLOCK = 128
#: A shard holds so many documents or bytes of text at most (one document at least).
SHARD_DOCUMENTS, SHARD_BYTES = 1 << 16, 64 << 20
#: Documents of a shard that are scored at once: few at first, so that a worst of the best is known soon.
FIRST_SPAN, LAST_SPAN = 256, 16384
#: Terms of the items that are searched at once; more items are searched in further passes.
PASS_TERMS = 1 << 18
#: What is no part of a term, as bytes and as a pattern.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes.maketrans(_SEPARATORS + UPPER.encode(), b" " * len(_SEPARATORS) + LOWER.encode())
_WIDTHS = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))

INDEX = (
    "shard bigint, term binary, df bigint, words bigint, lasts binary, ends binary, best binary, best_ends binary, blocks binary, "
    "ids array<bigint>, lengths binary"
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _packed(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each block the width (as a number) that its values need, and all values in every width."""
    most = np.maximum.reduceat(values, edges[:-1])
    return np.where(most < 256, 0, np.where(most < 65536, 1, 2)), [values.astype(w).tobytes() for w in _WIDTHS]


def shard_rows(shard: int, ids: list[int | None], texts: list[bytes | None], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The index of some documents, numbered in the order of their ids: a row for the shard, then one for each term."""
    schema = pa.schema([
        ("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("words", pa.int64()),
        *[(c, pa.binary()) for c in ("lasts", "ends", "best", "best_ends", "blocks")], ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
    ])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    numbers: dict[bytes, int] = {}
    found, lengths = [], np.zeros(len(ids), np.int64)
    for place, i in enumerate(order):
        words = terms_of(texts[i])
        lengths[place] = len(words)
        if words:
            found.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) * len(ids) + place)
    own = {
        "shard": shard, "df": int((lengths > 0).sum()), "words": int(lengths.sum()), "ids": [ids[i] for i in order],
        "lengths": lengths.astype("<i8").tobytes(),
    }
    yield pa.RecordBatch.from_pylist([own], schema)
    if not found:
        return
    posted, tf = np.unique(np.concatenate(found), return_counts=True)
    del found
    term, place = posted // len(ids), posted % len(ids)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    within = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    edges = np.append(np.flatnonzero(within % BLOCK == 0), len(term))
    block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    gap = place.copy()
    gap[1:] -= np.where(within[1:] % BLOCK == 0, 0, place[:-1])  # the first of a block is written whole
    gap_width, gaps = _packed(gap, edges)
    tf_width, tfs = _packed(tf, edges)
    best_tf, best_n, best_edges = competitive(block, tf, lengths[place], len(edges) - 1)
    best = np.column_stack([best_tf, best_n]).astype("<u4")
    lasts = place[edges[1:] - 1].astype("<u4")
    blocks_of = np.append(np.searchsorted(edges[:-1], first), len(edges) - 1)
    e, gw, tw = edges.tolist(), gap_width.tolist(), tf_width.tolist()
    words = [b""] * len(numbers)
    for w, i in numbers.items():
        words[i] = w
    rows = []
    for t in range(len(first)):
        a, b = int(blocks_of[t]), int(blocks_of[t + 1])
        parts, ends, at = [], [], 0
        for k in range(a, b):
            x, y = 1 << gw[k], 1 << tw[k]
            parts.append(bytes([gw[k] * 4 + tw[k]]) + gaps[gw[k]][e[k] * x:e[k + 1] * x] + tfs[tw[k]][e[k] * y:e[k + 1] * y])
            at += len(parts[-1])
            ends.append(at)
        rows.append({
            "shard": shard, "term": words[int(term[e[a]])], "df": e[b] - e[a], "lasts": lasts[a:b].tobytes(), "ends": np.array(ends, "<u4").tobytes(),
            "best": best[best_edges[a]:best_edges[b]].tobytes(), "best_ends": (best_edges[a + 1:b + 1] - best_edges[a]).astype("<u4").tobytes(),
            "blocks": b"".join(parts),
        })
        if len(rows) == most:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def competitive(block: np.ndarray, tf: np.ndarray, n: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (tf, n) of each block that no pair with as many occurrences and at most that length beats, and each block's first."""
    order = np.lexsort((n, -tf, block))
    b, t, m = block[order], tf[order], n[order]
    least = np.minimum.accumulate(m - b * (int(m.max()) + 1))  # a later block's values are lower than all before
    kept = np.append(True, least[1:] < least[:-1])
    return t[kept], m[kept], np.searchsorted(b[kept], np.arange(blocks + 1))


def index(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """The index of all rows of ``docs``, written as a table (``INDEX``); a row without term describes its shard."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0
        for batch in batches:
            for part in slices(batch, ["body"]):
                for i, text in zip(part.column("key").to_pylist(), as_list(part.column("body")), strict=True):
                    if ids and (len(ids) >= SHARD_DOCUMENTS or size + len(text or b"") > SHARD_BYTES):
                        yield from shard_rows(shard, ids, texts)
                        shard, ids, texts, size = shard + 1, [], [], 0
                    ids.append(i)
                    texts.append(text)
                    size += len(text or b"")
        if ids:
            yield from shard_rows(shard, ids, texts)

    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{body}`").cast("string").alias("body"))
    return materialize(named.mapInArrow(build, INDEX), "search-index")


def decompressed(blocks: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of the block that lies between two ends."""
    gap, tf = _WIDTHS[blocks[start] >> 2], _WIDTHS[blocks[start] & 3]
    n = (end - start - 1) // (gap.itemsize + tf.itemsize)
    places = np.cumsum(np.frombuffer(blocks, gap, n, start + 1), dtype=np.int64)
    return places, np.frombuffer(blocks, tf, n, start + 1 + n * gap.itemsize).astype(np.int64)


def points(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight ``w`` adds to the score of documents."""
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class TermList:
    """A shard's list of a term with its block maxima."""

    def __init__(self, row: dict, documents: int, words: int) -> None:
        self.lasts = np.frombuffer(row["lasts"], "<u4").astype(np.int64)
        self.ends = [0, *np.frombuffer(row["ends"], "<u4").tolist()]
        self.data, self.w = row["blocks"], row["w"]
        pairs = np.frombuffer(row["best"], "<u4").reshape(-1, 2).astype(np.int64)
        first = np.concatenate([[0], np.frombuffer(row["best_ends"], "<u4")[:-1]]).astype(np.int64)
        self.block_most = np.maximum.reduceat(points(self.w, pairs[:, 0], middles(pairs[:, 1], documents, words)), first)
        self.most = int(self.block_most.max())
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """The largest score that the block of each document allows; 0 behind the last block."""
        block = np.searchsorted(self.lasts, places)
        return np.where(block < len(self.lasts), self.block_most[np.minimum(block, len(self.lasts) - 1)], 0)

    def block(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block, decompressed at its first use."""
        if k not in self.opened:
            places, tf = decompressed(self.data, self.ends[k], self.ends[k + 1])
            self.opened[k] = places, points(self.w, tf, m[places])
        return self.opened[k]

    def between(self, first: int, last: int, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents first to last (exclusive) and their scores."""
        a, b = np.searchsorted(self.lasts, [first, last]).tolist()
        for k in range(a, min(b + 1, len(self.lasts))):
            places, score = self.block(k, m)
            inside = slice(*np.searchsorted(places, [first, last]).tolist())
            yield places[inside], score[inside]

    def of(self, places: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The scores of some documents, from the blocks that may hold them."""
        got, block = np.zeros(len(places), np.int64), np.searchsorted(self.lasts, places)
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])[:len(block)]).tolist()
        for a, b in zip(edges, [*edges[1:], len(places)], strict=bool(edges)):
            if block[a] < len(self.lasts):
                held, score = self.block(int(block[a]), m)
                at = np.minimum(np.searchsorted(held, places[a:b]), len(held) - 1)
                got[a:b] = np.where(held[at] == places[a:b], score[at], 0)
        return got


def middles(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The length norm of documents with n words, in whole numbers of any size."""
    return np.array([50 + 50 * x * documents // words for x in n.tolist()], np.int64)


def search(lists: list[TermList], m: np.ndarray, best: int = BEST) -> list[tuple[int, int]]:
    """(score, document) of the best documents of a shard for one item: above 0, of equal scores the first ones.

    Documents go by in ascending spans, so a later one must beat the worst of the best.
    """
    lists = sorted((x for x in lists if x.most > 0), key=lambda x: x.most)
    reach = np.cumsum([x.most for x in lists]).tolist()
    heap: list[tuple[int, int]] = []  # (score, -document)
    least, end, span = 0, 0, FIRST_SPAN
    while end < len(m):
        start, end, span = end, min(end + span, len(m)), min(2 * span, LAST_SPAN)
        essential = next((i for i, r in enumerate(reach) if r > least), len(lists))
        if essential == len(lists):
            break
        total, seen = np.zeros(end - start, np.int64), np.zeros(end - start, bool)
        for x in lists[essential:]:
            for places, score in x.between(start, end, m):
                total[places - start] += score
                seen[places - start] = True
        places = np.flatnonzero(seen) + start
        score = total[places - start]
        if essential:
            bounds = [x.bounds(places) for x in lists[:essential]]
            rest = np.sum(bounds, axis=0)
            for i in range(essential - 1, -1, -1):
                alive = score + rest > least
                places, score, rest = places[alive], score[alive], rest[alive]
                bounds = [b[alive] for b in bounds[:i + 1]]
                score = score + lists[i].of(places, m)
                rest = rest - bounds[i]
        better = np.flatnonzero(score > least)
        if len(better) > best:  # the best of the span suffice, of equal ones the first
            better = np.sort(better[np.lexsort((places[better], -score[better]))[:best]])
        for s, p in zip(score[better].tolist(), places[better].tolist(), strict=True):
            if len(heap) < best:
                heapq.heappush(heap, (s, -p))
            elif s > heap[0][0]:
                heapq.heapreplace(heap, (s, -p))
        if len(heap) == best:
            least = heap[0][0]
    return [(s, -p) for s, p in heap]


def term_weights(book: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """(term, w) of the terms asked for that some document holds."""
    held = book.where(F.col("term").isNotNull()).join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double")
    return held.select("term", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("w"))


def items_of(items: DataFrame, key: str = "item_id", body: str = "text") -> DataFrame:
    """(item_id, terms, name) of the different items that have a term; ``name`` is a hash of id and text."""
    lowered = ascii_lower(F.col(f"`{body}`").cast("string"))
    found = items.select(F.col(f"`{key}`").alias("item_id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"), F.col(f"`{body}`").cast("string").alias("text"))
    return found.where(F.size("terms") > 0).dropDuplicates(["item_id", "text"]).withColumn("name", F.xxhash64("item_id", "text")).drop("text")


def ranked(book: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``best`` documents of each item, by an ``index`` of the documents."""
    totals = book.where(F.col("term").isNull()).agg(F.sum("df").alias("n"), F.sum("words").alias("l")).first()
    documents, words = int(totals["n"] or 0), int(totals["l"] or 0)
    kind = dict(items.dtypes)["item_id"]
    asked = materialize(items_of(items), "search-items")
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    out = None
    passes = max(1, -(-size // PASS_TERMS))
    for number in range(passes if words else 0):
        part = asked.where(F.pmod("name", F.lit(passes)) == number)
        heaps = materialize(_heaps(book, part, documents, words, best), "search-best")
        out = heaps if out is None else out.unionByName(heaps)
    if out is None:
        return book.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id", "name").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    numbered = out.join(asked.select("item_id", "name"), "name").withColumn("rank", F.row_number().over(order))
    return numbered.where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _heaps(book: DataFrame, part: DataFrame, documents: int, words: int, best: int) -> DataFrame:
    """(name, doc_id, score): the best of every shard for one pass of items. The items of a pass are bounded by ``PASS_TERMS``."""
    terms = part.select(F.explode("terms").alias("t")).distinct().select(F.col("t").cast("binary").alias("term"))
    weights = materialize(term_weights(book, terms, documents), "search-weights")
    wanted = [(r["name"], [t.encode() for t in r["terms"]]) for r in part.select("name", "terms").toLocalIterator()]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = next(r for r in rows if r["term"] is None)
        ids = shard["ids"]
        lengths = np.frombuffer(shard["lengths"], "<i8")
        m = middles(lengths, documents, words)
        lists = {r["term"]: TermList(r, documents, words) for r in rows if r["term"] is not None}
        found = [(name, ids[p], s) for name, own in wanted for s, p in search([lists[t] for t in own if t in lists], m, best)]
        return pa.table({
            "name": pa.array([x[0] for x in found], pa.int64()), "doc_id": pa.array([x[1] for x in found], pa.int64()),
            "score": pa.array([x[2] for x in found], pa.int64()),
        })

    lists = book.where(F.col("term").isNotNull()).join(weights, "term").select(*book.columns, "w")
    shards = book.where(F.col("term").isNull()).withColumn("w", F.lit(0).cast("bigint"))
    return lists.unionByName(shards).groupBy("shard").applyInArrow(run, "name bigint, doc_id bigint, score bigint")


def search_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best 50 of all documents for each item."""
    return ranked(index(docs), items)


def _lower(column: str) -> Column | str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower('text')}, '{TERM}') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, text FROM benchmark),
i AS (SELECT item_id, text, unnest(list_distinct(regexp_extract_all({_lower('text')}, '{TERM}'))) AS term FROM q),
f AS (
  SELECT i.item_id, i.text, p.r, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.t)::HUGEINT * n_docs) // n_terms)))) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN d ON d.r = p.r, s GROUP BY i.item_id, i.text, p.r),
k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, f.text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM f JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM k WHERE rank <= {BEST}
"""
