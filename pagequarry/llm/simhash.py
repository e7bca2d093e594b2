"""SimHash near-duplicates: fingerprints, Hamming links found in BK-trees, components."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import SMALL_BLOCK, connected_components, links_of_blocks, per_row, shared_blocks, slices
from pagequarry.session import materialize, settle

SEED = 42
BITS = 64
#: Fingerprints that one BK-tree holds at most; larger shards are split by more bits.
TREE_NODES = 1024
ALL = (1 << BITS) - 1
#: Counters of how many texts have a shingle, and the share of texts they are taken from.
COUNTERS, SAMPLE = 1 << 16, 16
#: Passes in which pairs of texts are compared at most; fewer passes take more disk, none loses a pair.
MOST_PASSES = 16
#: Sets of 64 parities by which texts are told apart before their shingles are compared; texts of over LONG shingles have MORE_PARITIES, too.
PARITIES, MORE_PARITIES, LONG = 16, 256, 1000
_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (repeats included); the whole text if it has fewer words, none if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = max(1, len(words) - size + 1)
    return np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:i + runs] for i in range(min(size, len(words))))))), np.uint64, runs)


def _bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), block):
        counts += _bit_rows(hashes[start:start + block]).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = 3) -> DataFrame:
    """(key, fp bigint) of every row: the majority fingerprint of its word shingles."""
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("body"))
    got = per_row(rows, ["body"], "fp bigint", lambda c: [[_signed(majority(shingle_hashes(t, size))) for t in c[0]]])
    return got.select(F.col("id").alias(key), "fp")


class Tree:
    """A BK-tree over integers: children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at < new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of all nodes within the radius; only edges that can lead to one are followed."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    open_nodes.append(child)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int, int]]:
    """(node, node, distance) links that join whatever is within the radius: to each group that a value
    touches when it enters the tree, the nearest link. At most one link fewer than values."""
    tree, parent, links = Tree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for new, value in enumerate(values):
        nearest: dict[int, tuple[int, int]] = {}
        for hit in tree.near(value, radius):
            group = root(hit[1])
            if group not in nearest or hit < nearest[group]:
                nearest[group] = hit
        for group, (d, old) in nearest.items():
            links.append((new, old, d))
            parent[group] = new
        tree.add(value)
    return links


def pigeonhole_masks(radius: int, blocks: int, fixed: int = 0) -> list[int]:
    """Bit masks of which two values within the radius agree on at least one: the free bits are cut into
    ``blocks`` blocks, and each choice of ``blocks - radius`` of them, with the fixed bits, is a mask."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    blocks = min(blocks, len(free))
    parts = [sum(1 << i for i in free[k * len(free) // blocks:(k + 1) * len(free) // blocks]) for k in range(blocks)]
    return [fixed | sum(some) for some in itertools.combinations(parts, max(1, blocks - radius))]


def _links_of_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                key, fp, node = rest
                done = len(key)
            else:
                key, fp, node = (
                    np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for old, c in zip(rest, ("shard", "fp", "id"), strict=True)
                )
                done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last shard may go on in the next batch
            rest = [key[done:], fp[done:], node[done:]]
            starts = np.flatnonzero(np.r_[True, key[1:done] != key[:done - 1]]) if done else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, done])
            out: list[tuple[int, int, int]] = []
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                ids = node[start:start + size].tolist()
                values = fp[start:start + size].view(np.uint64).tolist()
                out += [(ids[i], ids[j], d) for i, j, d in forest(values, radius)]
            if out:
                a, b, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], ["a", "b", "distance"])

    return run


def hamming_links(nodes: DataFrame, radius: int, masks: list[int], most: int = TREE_NODES) -> DataFrame:
    """(a, b, distance) links between ``nodes`` (id bigint, fp bigint, each fp once) that join all nodes which
    share a mask and lie within the radius; ``a`` and ``b`` are ids.

    A shard is a mask and the bits under it. A task reads its shards in sorted order and keeps one BK-tree
    at a time. Shards of over ``most`` nodes don't get a larger tree: they are split by
    ``radius + 1`` blocks of their free bits, of which two near values share at least one, until they are small
    enough; with all but a few bits fixed no more than ``most`` different values are left.
    """
    spark = nodes.sparkSession
    every = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = nodes.select("id", "fp", F.explode(every).alias("mask"))
    levels, found = list(masks), None
    while True:
        keyed = rows.select("id", "fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
        large = materialize(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("shard"), "large-shards")
        split = bool(large.take(1))
        small = keyed.join(large, "shard", "left_anti") if split else keyed
        dealt = small.select("shard", "fp", "id").repartition("shard").sortWithinPartitions("shard", "id")
        links = dealt.mapInArrow(_links_of_shards(radius), "a bigint, b bigint, distance int")
        found = links if found is None else found.unionByName(links)
        if not split:
            return found
        finer = {m: pigeonhole_masks(radius, radius + 1, m) for m in levels}
        pairs = spark.createDataFrame([(_signed(m), [_signed(x) for x in finer[m]]) for m in levels], "mask bigint, finer array<bigint>")
        hot = keyed.join(large, "shard", "left_semi").join(F.broadcast(pairs), "mask")  # one row for each mask of this level
        rows = materialize(hot.select("id", "fp", F.explode("finer").alias("mask")).distinct(), "split-shards")
        levels = sorted({x for some in finer.values() for x in some})


def components(prints: DataFrame, radius: int = 3, blocks: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): rows whose fingerprints can reach one another by steps of at most ``radius`` bits
    share the smallest key among them.

    Equal fingerprints are one node, so copies cost one row each. Rows with a null key take part and get
    the component's smallest key (null if it has none). No row gives no row.
    """
    prints = materialize(prints.select(F.col(key).alias("key"), "fp"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    links = hamming_links(nodes.select(F.col("fp").alias("id"), "fp"), radius, pigeonhole_masks(radius, blocks))
    roots = connected_components(links.select("a", "b"), "simhash").select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    got = components(fingerprints(docs))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def parities(hashes: np.ndarray, sets: int = PARITIES) -> list[int]:
    """For each of 64 * ``sets`` values of a hash, whether an odd number of the hashes has it. Two sets of hashes that differ
    in d members differ in at most d of these."""
    odd = np.bincount((hashes >> np.uint64(16)).astype(np.int64) % (BITS * sets), minlength=BITS * sets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _text_key(body: str) -> list:
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _shingle_levels(rows: DataFrame, size: int) -> np.ndarray:
    """Roughly the logarithm of how many texts of a sample have a shingle of each counter; any values give the same links."""
    sample = rows.where(F.pmod("t1", F.lit(SAMPLE)) == 0)
    hits = per_row(sample, ["body"], "hits array<int>", lambda c: [[np.unique(shingle_hashes(t, size) % COUNTERS).tolist() for t in c[0]]])
    levels = np.zeros(COUNTERS, np.uint8)
    for row in hits.select(F.explode("hits").alias("c")).groupBy("c").count().toLocalIterator():  # COUNTERS rows at most
        levels[row["c"]] = 2 * (1 + row["count"]).bit_length()
    return levels


def near_copies(
    docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = 5, similarity: float = 0.8, small: int = SMALL_BLOCK, radius: int = 3,
) -> DataFrame:
    """(t1, t2, key, group_id) of every text: linked texts share the smallest key among them. Two texts are linked by
    SimHash fingerprints of their ``size``-word shingles that differ in at most ``radius`` bits, or by a Jaccard similarity
    of their shingle sets of at least ``similarity``.

    Fingerprints are linked first, in BK-trees. An exact search follows for similar texts whose fingerprints lie further
    apart: of n shingles, rare ones first, the first n - ceil(similarity * n) + 1 hold one that a similar text has among
    its first, so texts that share one of these are compared, unless fingerprints joined them: first by their lengths and the
    parities of their shingles, which leave no similar text out, then in full shingle sets.
    Texts of fewer than ``size`` words have one shingle, the whole text. Texts without a word (null, empty or
    blank) and rows without a key are left out. (t1, t2) is the hash of the text, so equal texts are one row; links go by t1.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"), *_text_key(body))
    levels = docs.sparkSession.sparkContext.broadcast(_shingle_levels(rows, size))

    def facts_of(text: bytes | None) -> tuple:
        every = shingle_hashes(text, size)
        hashes = np.unique(every)
        rare = hashes[np.argsort(levels.value[(hashes % COUNTERS).astype(np.int64)], kind="stable")]
        firsts = rare[:len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]
        return _signed(majority(every)), len(hashes), firsts.view(np.int64).tolist(), parities(hashes), parities(hashes, MORE_PARITIES) if len(hashes) > LONG else None

    dealt = per_row(rows, ["body"], "fp bigint, shingles int, blocks array<bigint>, odd array<bigint>, more array<bigint>", lambda c: list(zip(*map(facts_of, c[0]), strict=True))).where("shingles > 0")
    texts = materialize(
        dealt.groupBy("t1", "t2").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("fp", "shingles", "blocks", "odd", "more")]), "texts")
    facts = texts.select(F.col("t1").alias("h"), F.lit(1).alias("n"), "shingles", *[F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(PARITIES)])
    least, most = F.least("x.shingles", "y.shingles"), F.greatest("x.shingles", "y.shingles")
    # Sets of m and n shingles, alike to ``similarity``, differ in at most (m + n) * (1 - similarity) / (1 + similarity) of them.
    unlike = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.o{i}").bitwiseXOR(F.col(f"y.o{i}"))) for i in range(PARITIES)])
    share = F.lit((1 - similarity) / (1 + similarity))
    fits = (least >= F.lit(similarity) * most - 1e-9) & (unlike <= share * (least + most) + 1e-9)
    long = [texts.where("more is not null").select(F.col("t1").alias(end), F.struct("shingles", "more").alias(f"long_{end}")) for end in ("a", "b")]
    unlike_long = F.aggregate(F.zip_with("long_a.more", "long_b.more", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
    fit_long = unlike_long <= share * (F.col("long_a.shingles") + F.col("long_b.shingles")) + 1e-9

    def joined() -> DataFrame:
        """(t1, lead): each text with the first one of those that fingerprints join it to."""
        of_print = components(texts.select("t1", "fp"), radius, key="t1")
        return of_print.select("t1", F.col("component_id").alias("lead"))

    near = settle(joined, "text-prints")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [near.select(F.col("t1").alias(end), F.col("lead").alias(f"lead_{end}")) for end in ("a", "b")]
        asked = materialize(pairs.join(sides[0], "a").join(sides[1], "b"), "text-pairs")
        found = asked.where("lead_a = lead_b").select("a", "b")
        pairs = asked.where("lead_a <> lead_b").select("a", "b").join(long[0], "a", "left").join(long[1], "b", "left")
        pairs = materialize(pairs.where(F.coalesce(fit_long, F.lit(True))).select("a", "b"), "text-alike")
        if not pairs.take(1):
            return found
        ends = pairs.select(F.explode(F.array("a", "b")).alias("t1")).distinct()
        wanted = texts.join(ends, "t1", "left_semi").select("t1", "t2", "key")
        bodies = rows.join(wanted, ["t1", "t2", "key"], "left_semi")
        sets = materialize(
            per_row(bodies, ["body"], "s array<bigint>", lambda c: [[np.unique(shingle_hashes(t, size)).view(np.int64).tolist() for t in c[0]]])
            .select("t1", "s").dropDuplicates(["t1"]), "shingles")
        # A pass carries about a quarter as many sets to their partners as there are texts; its shuffle files go before the next.
        passes = min(MOST_PASSES, max(1, math.ceil(4 * pairs.count() / max(1, texts.count()))))
        for k in range(passes):
            some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == k)
            mine = sets.where(F.pmod(F.xxhash64("t1"), F.lit(passes)) == k).select(F.col("t1").alias("a"), "s")
            both = some.join(mine, "a").join(sets.select(F.col("t1").alias("b"), F.col("s").alias("r")), "b")
            similar = both.where(F.size(F.array_intersect("s", "r")) >= F.lit(similarity) * F.size(F.array_union("s", "r")) - 1e-9)
            found = found.unionByName(materialize(similar.select("a", "b"), "text-verified"))
        return found

    def similar() -> DataFrame:
        shared = shared_blocks(texts.select(F.col("t1").alias("h"), F.explode("blocks").alias("block")), "text")
        return links_of_blocks(shared, facts, fits, verified, "text", small)

    links = settle(similar, "text-similar").unionByName(near.where("t1 <> lead").select(F.col("t1").alias("a"), F.col("lead").alias("b")))
    roots = connected_components(links, "near-copies").select(F.col("node").alias("t1"), "root")
    placed = materialize(texts.select("t1", "t2", "key").join(roots, "t1", "left").withColumn("root", F.coalesce("root", "t1")), "near-groups")
    smallest = placed.groupBy("root").agg(F.min("key").alias("group_id"))
    return placed.join(smallest, "root").select("t1", "t2", F.col("key").alias(key), "group_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", body: str = "text", **how) -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest key.

    All columns stay as they are. Rows without a key and texts without a word stay. Repeated rows (same key
    and text) count as copies: one stays.
    """
    kept = near_copies(docs, key, body, **how).where(F.col(key) == F.col("group_id")).select(
        "t1", "t2", F.col(key).alias("k"))
    t1, t2 = _text_key(body)
    free = F.col(key).isNull() | ~F.coalesce(F.col(body).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), t1, t2, F.col(key).alias("k"), free.alias("free"))
    counted = docs.where(~free).select(F.col(key).alias("k"), *_text_key(body)).groupBy("k", "t1", "t2").count()
    once = kept.join(counted, ["k", "t1", "t2"])
    match = ["k", "t1", "t2"]
    single = marked.where(~F.col("free")).join(once.where("count = 1"), match, "left_semi")
    repeated = marked.where(~F.col("free")).join(once.where("count > 1"), match, "left_semi").dropDuplicates(match)
    return marked.where("free").unionByName(single).unionByName(repeated).select("row.*")
