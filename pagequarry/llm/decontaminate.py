"""Benchmark decontamination: spaced seeds of test and training texts meet in a join, and overlaps around the hits are checked word by word."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import per_row, slices
from pagequarry.session import materialize, settle

#: Items of fewer words match everywhere and prove nothing; they are left out.
LEAST_WORDS = 5
#: An overlap counts with this share of equal words ...
SIMILAR = 0.75
#: ... of the whole item, or over at least so many words.
LEAST_OVERLAP = 12
#: The places that each mask looks at; those between are ignored. Wherever a quarter of 5 or more words is substituted,
#: one of these masks fits somewhere between the substitutions (a test counts this for every length).
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 3, 4, 5))
#: Bits that tell which seeds the benchmark may hold (4 MB), two for each seed. A larger benchmark sets more of them, so more
#: seeds go to the join; none is lost.
FILTER_BITS = 1 << 25
_SECOND = 25
_BUCKET = 1 << 15
#: Letters of scripts without blanks are words of their own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|(?!_)\w")
_hash = functools.partial(xxhash.xxh64_intdigest, seed=5)


def words_of(text: bytes | None) -> np.ndarray:
    """Hashes of the lower-case words, without punctuation."""
    words = _WORD.findall((text or b"").decode("utf-8", "replace").lower())
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def seeds(words: np.ndarray, number: int) -> np.ndarray:
    """A hash of the words under a mask, for each place where the mask fits."""
    mask = MASKS[number]
    windows = max(0, len(words) - mask[-1])
    total = np.full(windows, (number + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for p in mask:
        total = (total ^ words[p:p + windows]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


def overlap(own: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int] | None:
    """(first word of the text, words, equal words) of the overlap of an item laid at ``offset``, or null if too few agree.

    ``own`` are the words of the text from ``max(0, offset)`` on.
    """
    low = max(0, -offset)
    length = min(len(own), len(item) - low)
    equal = own[:length] == item[low:low + length]
    total = int(equal.sum())
    if total >= SIMILAR * len(item):
        return low + offset, length, total
    start, stretch, same = _best_stretch(equal)
    if stretch >= min(LEAST_OVERLAP, len(item)) and same >= SIMILAR * stretch:
        return low + offset + start, stretch, same
    return None


def _best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the stretch with the largest sum, an equal word counting 1 and another -3."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    start = int(np.flatnonzero(sums[:end + 1] == lowest[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def _benchmark(items: DataFrame, key: str, body: str) -> DataFrame:
    """(item, item_id, n, words) of the different items with an id and enough words, written once."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("item_id"), F.col(body).cast("string").alias("body")).distinct()
    worded = per_row(rows, ["body"], "words binary", lambda columns: [[words_of(t).tobytes() for t in columns[0]]])
    long_enough = worded.select("item_id", F.floor(F.length("words") / 8).alias("n"), "words").where(F.col("n") >= LEAST_WORDS)
    return materialize(long_enough.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", "words"), "benchmark-words")


def _benchmark_seeds(items: DataFrame) -> DataFrame:
    """(item, n, seed, place) of every item under every mask, written once."""
    def compute(columns: list[list]) -> list[list]:
        out = []
        for raw in columns[0]:
            words = np.frombuffer(raw, np.uint64)
            found = [seeds(words, m) for m in range(len(MASKS))]
            out.append([{"seed": s, "place": p} for own in found for p, s in enumerate(own.tolist())])
        return [out]

    dealt = per_row(items.select("item", "n", "words"), ["words"], "seeds array<struct<seed:bigint,place:bigint>>", compute, 1 << 20)
    return materialize(dealt.select("item", "n", F.inline("seeds")), "benchmark-seeds")


def _filter(dealt: DataFrame) -> np.ndarray:
    """The bits of all seeds; ``FILTER_BITS`` at most come to the driver, whatever the benchmark's size."""
    slots = F.transform(F.array(F.col("seed"), F.shiftright("seed", _SECOND)), lambda s: s.bitwiseAND(FILTER_BITS - 1))
    slot = F.col("slot")
    buckets = dealt.select(F.explode(slots).alias("slot")).groupBy(F.floor(slot / _BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(slot % _BUCKET).alias("bits"))
    bits = np.zeros((FILTER_BITS // _BUCKET, _BUCKET // 8), np.uint8)
    for row in buckets.collect():
        bits[row.bucket] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits.ravel()


def _set(bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The bit of each seed's low part."""
    slot = seed & (FILTER_BITS - 1)
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1


def _hit_texts(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """(row, id, words, seed places) of the texts with a seed that the filter lets through, written once."""
    sent = rows.sparkSession.sparkContext.broadcast(_filter(dealt))

    def compute(columns: list[list]) -> list[list]:
        bits, texts = sent.value, [words_of(t) for t in columns[0]]
        # All texts of the batch at once; seeds that run over the end of a text are left out.
        words, ends = np.concatenate(texts), np.cumsum([len(w) for w in texts])
        hits: list[list[dict]] = [[] for _ in texts]
        for number, mask in enumerate(MASKS):
            mine = seeds(words, number)
            at = np.flatnonzero(_set(bits, mine))
            at = at[_set(bits, mine[at] >> _SECOND).astype(bool)]
            text = np.searchsorted(ends, at, "right")
            inside = at + mask[-1] < ends[text]
            at, text = at[inside], text[inside]
            first = ends[text] - np.array([len(w) for w in texts])[text]
            for seed, t, place in zip(mine[at].tolist(), text.tolist(), (at - first).tolist(), strict=True):
                hits[t].append({"seed": seed, "at": place})
        return [[w.tobytes() if h else None for w, h in zip(texts, hits, strict=True)], hits]

    passed = per_row(rows, ["body"], "words binary, hits array<struct<seed:bigint,at:bigint>>", compute, 4 << 20).where("words is not null")
    return materialize(passed.select(F.monotonically_increasing_id().alias("row"), "id", "words", "hits"), "seed-hits")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, ["own", "theirs"]):
            pairs = zip(batch.column("own").to_pylist(), batch.column("theirs").to_pylist(), batch.column("place").to_pylist(), strict=True)
            found = [overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), o) for a, b, o in pairs]
            kept = pa.array([f is not None for f in found], pa.bool_())
            out = pa.array([f and dict(zip(("first_word", "n_words", "n_equal"), f, strict=True)) for f in found], _OVERLAP)
            names = ["row", "id", "item", "item_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out], [*names, "found"]).filter(kept)


_OVERLAP = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])


def _best_overlaps(rows: DataFrame, benchmark: DataFrame, item_key: str, item_body: str) -> DataFrame:
    items = _benchmark(benchmark, item_key, item_body)
    dealt = _benchmark_seeds(items)
    texts = _hit_texts(rows, dealt)
    hits = texts.select("row", F.inline("hits"))
    # The same item at the same place is hit by many seeds and checked once.
    laid = hits.join(dealt, "seed").select("row", "item", "n", (F.col("at") - F.col("place")).alias("place")).distinct()
    first = F.greatest(F.lit(0), F.col("place"))
    own = F.substring("words", (8 * first + 1).cast("int"), (8 * (F.col("n") - first + F.col("place"))).cast("int"))
    cut = laid.join(texts.select("row", "id", "words"), "row").select("row", "id", "item", "place", own.alias("own"))
    pairs = cut.join(items.select("item", "item_id", F.col("words").alias("theirs")), "item")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, item bigint, item_id bigint, found struct<first_word:bigint,n_words:bigint,n_equal:bigint>"
    checked = pairs.mapInArrow(_check, schema)
    order = F.struct("found.n_equal", -F.col("found.first_word"), -F.col("found.n_words"))
    best = checked.groupBy("row", "item_id").agg(F.first("id").alias("id"), F.max_by("found", order).alias("found"))
    return best.select("id", "item_id", "found.*")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", body: str = "text", item_key: str = "item_id", item_body: str = "text") -> DataFrame:
    """(key, item_id, first_word, n_words, n_equal): each document's best overlap with each benchmark item that it repeats.

    The best overlap has the most equal words, then the first place. Texts are read whole and once. Null and empty texts
    and items, and items of fewer than five words, match nothing. Repeated rows give repeated results; an id with several
    texts as benchmark item is one item of which the best counts.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("body"))
    return settle(lambda: _best_overlaps(rows, benchmark, item_key, item_body), "overlaps").withColumnRenamed("id", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, body: str = "text") -> DataFrame:
    """The documents that repeat no benchmark item, with their columns as they were; texts are known by their SHA-256."""
    digest = F.sha2(F.col(f"`{body}`").cast("string"), 256)
    found = contamination(docs.select(digest.alias("digest"), F.col(f"`{body}`").alias("text")), benchmark, "digest")
    gone = found.select(F.col("digest").alias("gone_digest")).distinct()
    return docs.join(gone, digest == gone["gone_digest"], "left_anti")
