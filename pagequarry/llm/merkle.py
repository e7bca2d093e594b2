"""Merkle manifest of a data set: append logs of nodes in the order of their completion, and proofs for every row.

Each group (language) has a tree of its rows' digests, eight to a node, and the groups' roots form one more such tree.
Builders take aligned stretches of 4,096 nodes, so that each subtree has one builder; a builder writes its nodes in
postorder, the order in which they are completed. Where a node stands in that log follows from the sizes of the
subtrees before it, so proofs are read from the logs by position, without an index.

Rows with a null key come first in their group, the null group comes first. Rows with one key are ordered by their
digest; equal rows are leaves of their own and have proofs of their own. Empty tables have no rows, a single row is
its own root. Columns that are not named play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import LOWER, UPPER, as_list, per_row
from pagequarry.session import materialize

ARITY = 8
#: Levels that one builder completes, and the nodes it starts from.
BUILT = 4
STRETCH = ARITY**BUILT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 32


def node_digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 over the hex texts of the parts."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def row_digest(values: Iterable[int | bytes | None]) -> bytes:
    """SHA-256 of a row: '-' for null, else byte count, colon and value."""
    taken = hashlib.sha256()
    for v in values:
        if v is None:
            taken.update(b"-")
        else:
            plain = v if isinstance(v, bytes) else str(v).encode()
            taken.update(b"%d:" % len(plain))
            taken.update(plain)
    return taken.digest()


def height_of(width: int) -> int:
    """Levels above ``width`` nodes until one remains."""
    levels = 0
    while width > 1:
        width, levels = -(-width // ARITY), levels + 1
    return levels


def position(level: int, index: np.ndarray, width: int, height: int) -> np.ndarray:
    """Where the nodes number ``index`` of a level stand in the log of a tree of ``width`` leaves.

    All nodes up to the level that cover leaves up to the node's last one are complete by then; of the levels above,
    those that end before its first one.
    """
    first = index * ARITY**level
    last = np.minimum(first + ARITY**level, width)
    below = sum(-(-last // ARITY**j) for j in range(level + 1))
    above = sum((first // ARITY**j for j in range(level + 1, height + 1)), np.zeros_like(first))
    return below + above - 1


def completed(leaves: list[bytes], height: int) -> bytes:
    """The nodes over ``leaves`` in the order of completion, up to ``height`` levels; the last runs may be short."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        runs[level].append(digest)
        if level < height and len(runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        digest = node_digest(runs[level])
        runs[level].clear()
        put(level + 1, digest)

    for leaf in leaves:
        put(0, leaf)
    for level in range(height):
        if runs[level]:
            close(level)
    return b"".join(log)


def siblings(log: bytes, width: int, height: int) -> list[list[tuple[bytes, bytes]]]:
    """Of each level below the top, of each node: its run's nodes before and after it, read from the log by position."""
    found = []
    for level in range(height):
        count = -(-width // ARITY**level)
        at = position(level, np.arange(count), width, height).tolist()
        nodes = [log[_HEX * p:_HEX * (p + 1)] for p in at]
        runs = [nodes[i:i + ARITY] for i in range(0, count, ARITY)]
        found.append([(b"".join(run[:k]), b"".join(run[k + 1:])) for run in runs for k in range(len(run))])
    return found


def folded(digest: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the siblings along its path give."""
    for left, right in path:
        digest = node_digest((left, digest, right))
    return digest


@dataclass(frozen=True)
class Manifest:
    """Log segments by round: ``trees`` of the groups, ``top`` over the groups' roots.

    A segment row has the tree ``g``, the ``stretch`` it covers, the ``width`` of the tree at the segment's lowest level,
    and its ``log``; the first round also has the ``keys`` and ``others`` of its leaves. ``roots`` has each tree's root.
    """

    trees: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    top_roots: DataFrame


def leaf_rows(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """(g, key, leaf, other): ``other`` is the digest of the row as it came back, null where it came back as it was.

    A row is altered where 3 divides crc32(key as text): the letters A-Z of ``text`` are then in lower case.
    """
    body, keyed = fields.index("text"), fields.index(key)

    def compute(columns: list[list]) -> list[list]:
        leaves, others = [], []
        for values in zip(*columns, strict=True):
            leaves.append(row_digest(values))
            k, text = values[keyed], values[body]
            named = k if isinstance(k, bytes) else str(k).encode()
            altered = k is not None and text is not None and zlib.crc32(named) % 3 == 0 and text.lower() != text
            others.append(row_digest([*values[:body], text.lower(), *values[body + 1:]]) if altered else None)
        return [leaves, others]

    plain = [f"c{i}" for i in range(len(fields))]
    rows = per_row(docs.select(*[F.col(f"`{c}`") for c in fields]).toDF(*plain), plain, "leaf binary, other binary", compute)
    tree = F.col(plain[fields.index(group)])
    g = F.when(tree.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), tree))  # null first, then by bytes
    return rows.select(g.alias("g"), F.col(plain[keyed]).alias("key"), "leaf", "other", F.monotonically_increasing_id().alias("row"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with g) with their place ``i`` among the rows of their tree, by ``order``, and the tree's ``width``.

    Rows are dealt by ranges of (g, order) and numbered where they lie; what a range must add comes from the counts of
    the ranges before it, one row for each range and tree.
    """
    sorted_ = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("width"))
    return placed.join(shifts, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _built(rows: DataFrame, key_type: str | None) -> DataFrame:
    """One log segment for each stretch of ``rows`` (g, i, width, digest and perhaps key and other)."""
    carried = "" if key_type is None else f", keys array<{key_type}>, others array<binary>"

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        width = table["width"][0].as_py()
        log = completed(table["digest"].to_pylist(), min(BUILT, height_of(width)))
        row = {"g": table["g"][0].as_py(), "stretch": table["stretch"][0].as_py(), "width": width, "log": log}
        if key_type is not None:
            row |= {"keys": table["key"].to_pylist(), "others": table["other"].to_pylist()}
        return pa.Table.from_pylist([row], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema_text = f"g string, stretch bigint, width bigint, log binary{carried}"
    schema = to_arrow_schema(_parse_datatype_string(schema_text))
    stretched = rows.withColumn("stretch", F.shiftright("i", 3 * BUILT))
    return materialize(stretched.groupBy("g", "stretch").applyInArrow(build, schema_text), "merkle-log")


def _grown(rows: DataFrame, key_type: str | None) -> tuple[list[DataFrame], DataFrame]:
    """Segments of all rounds over ``rows``, and (g, root)."""
    segments, whole = [_built(rows, key_type)], F.col("width") <= STRETCH
    roots = []
    while True:
        top = segments[-1].select("g", F.col("stretch").alias("i"), "width", F.expr(f"substr(log, length(log) - {_HEX - 1})").alias("digest"))
        roots.append(top.where(whole).select("g", F.col("digest").alias("root")))
        higher = top.where(~whole).withColumn("width", F.expr(f"(width + {STRETCH - 1}) div {STRETCH}"))
        if higher.isEmpty():
            break
        segments.append(_built(higher, None))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return segments, found


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang") -> Manifest:
    """Logs of the trees over ``docs`` and of the tree over their roots."""
    leaves = materialize(leaf_rows(docs, fields, key, group), "merkle-leaves")
    rows = numbered(leaves, ["key", "leaf", "row"]).withColumnRenamed("leaf", "digest")
    trees, roots = _grown(rows, dict(leaves.dtypes)["key"])
    above = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "root"), ["key"])
    top, top_roots = _grown(above.select("g", "i", "width", F.col("root").alias("digest"), "key", F.lit(None).cast("binary").alias("other")), "string")
    return Manifest(trees, top, roots, top_roots)


def log_nodes(segments: list[DataFrame]) -> DataFrame:
    """The whole append logs as rows: tree ``g``, ``position`` from 0 in the order of completion, ``level``, ``index``, ``digest``."""
    def of_round(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, stretch, wide, log in zip(*(as_list(batch.column(c)) for c in ("g", "stretch", "width", "log")), strict=True):
                    width = min(STRETCH, wide - stretch * STRETCH)
                    height = min(BUILT, height_of(wide))
                    for level in range(1 if base else 0, height + 1):
                        index = np.arange(-(-width // ARITY**level))
                        local = position(level, index, width, height).tolist()
                        index += stretch * ARITY**(BUILT - level)
                        total = height_of(wide)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([g.decode()] * len(index)), pa.array([base + level] * len(index), pa.int32()), pa.array(index, pa.int64()),
                            pa.array(position(level, index, wide, total), pa.int64()), pa.array([log[_HEX * p:_HEX * (p + 1)] for p in local], pa.binary()),
                        ], ["g", "level", "index", "in_round", "digest"])

        return nodes

    found = None
    for r, s in enumerate(segments):
        rows = s.select("g", "stretch", "width", "log").mapInArrow(of_round(r * BUILT), "g string, level int, index bigint, in_round bigint, digest binary")
        found = rows if found is None else found.unionByName(rows)
    width = segments[0].groupBy("g").agg(F.max("width").alias("leaves"))
    first = F.expr(f"index * cast(power({ARITY}, level) as bigint)")
    last = F.least(first + F.expr(f"cast(power({ARITY}, level) as bigint)"), F.col("leaves"))
    powers = [F.lit(ARITY**j) for j in range(20)]
    below = sum((F.when(F.col("level") >= j, F.ceil(last / p)).otherwise(0) for j, p in enumerate(powers)), F.lit(0))
    # Levels above the root are never complete before it: their quotient is 0.
    above = sum((F.when(F.col("level") < j, F.floor(first / p)).otherwise(0) for j, p in enumerate(powers)), F.lit(0))
    return found.join(width, "g").select("g", (below + above - 1).cast("bigint").alias("position"), "level", "index", "digest")


_PATH = "path array<struct<left:binary,right:binary>>, subroot binary, root binary"


def _descended(segments: list[DataFrame], starts: DataFrame, leaf_type: str, leaf: Callable[..., dict]) -> DataFrame:
    """What ``leaf`` makes of each leaf and the siblings on its way up.

    ``starts`` has, for each tree, the path above its root. Paths go down one round of segments at a time.
    """
    paths = starts.withColumn("stretch", F.lit(0).cast("bigint"))
    for r in range(len(segments) - 1, -1, -1):
        own = segments[r]
        if r < len(segments) - 1:  # trees of this round that higher rounds continue have paths already
            paths = paths.unionByName(starts.withColumn("stretch", F.lit(0).cast("bigint")).join(own.where(F.col("width") <= STRETCH).select("g"), "g", "left_semi"))
        else:
            paths = paths.join(own.select("g").distinct(), "g", "left_semi")
        joined = own.join(paths, ["g", "stretch"])
        if r:
            paths = materialize(joined.mapInArrow(_spread(None), f"g string, stretch bigint, {_PATH}"), "merkle-paths")
        else:
            return joined.mapInArrow(_spread(leaf), leaf_type)
    raise AssertionError("a manifest has a round at least")


def _spread(leaf: Callable[..., dict] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                width = min(STRETCH, row["width"] - row["stretch"] * STRETCH)
                levels = siblings(row["log"], width, min(BUILT, height_of(row["width"])))
                above = [(p["left"], p["right"]) for p in row["path"]]
                places = position(0, np.arange(width), width, len(levels)).tolist()

                def way(i: int) -> list[tuple[bytes, bytes]]:
                    return [*(levels[j][i // ARITY**j] for j in range(len(levels))), *above]  # noqa: B023

                if leaf is None:
                    out = [{
                        "g": row["g"], "stretch": row["stretch"] * STRETCH + i, "path": [{"left": a, "right": b} for a, b in way(i)],
                        "subroot": row["subroot"], "root": row["root"],
                    } for i in range(width)]
                else:
                    out = [leaf(row, i, row["log"][_HEX * p:_HEX * (p + 1)], way(i)) for i, p in enumerate(places)]
                yield from pa.Table.from_pylist(out).to_batches()

    return spread


def proofs(book: Manifest, key_type: str = "bigint") -> DataFrame:
    """Of each row: key, leaf, subroot, root, proof_sha256, folded_root, verified."""
    def of_group(row: dict, i: int, digest: bytes, path: list[tuple[bytes, bytes]]) -> dict:
        return {"g": row["keys"][i], "path": [{"left": a, "right": b} for a, b in path], "subroot": digest, "root": row["root"]}

    def of_row(row: dict, i: int, digest: bytes, path: list[tuple[bytes, bytes]]) -> dict:
        shown = row["others"][i]
        got = folded(digest if shown is None else shown, path)
        return {
            "key": row["keys"][i], "leaf": digest.hex(), "subroot": row["subroot"].hex(), "root": row["root"].hex(),
            "proof_sha256": node_digest(x for pair in path for x in pair).hex(), "folded_root": got.hex(), "verified": got == row["root"],
        }

    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    starts = book.top_roots.select("g", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
    groups = materialize(_descended(book.top, starts, f"g string, {_PATH}", of_group), "merkle-groups")
    fields = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _descended(book.trees, groups, fields, of_row)


def merkle_query(docs: DataFrame) -> DataFrame:
    """doc_id and the other columns of ``proofs`` for every row."""
    kind = next(k for c, k in docs.dtypes if c == "doc_id")
    return proofs(manifest(docs), kind).withColumnRenamed("key", "doc_id")


def _oracle(levels: int = 8) -> str:
    """SQL over ``documents`` for trees of at most 8 ** ``levels`` rows."""
    def value(column: str, shown: str = "") -> str:
        text = f"CAST({shown or column} AS VARCHAR)"
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"

    def hashed(shown: str) -> str:
        return f"sha256({' || '.join([*(value(c) for c in FIELDS[:-1]), value('text', shown)])})"

    def climb(name: str, first: str, tag: str) -> list[str]:
        """Levels of the trees of ``first`` (g, i, d): name_j (g, i, d, n) and side_j (g, i, l, r, n)."""
        parts, own = [f"{tag}0 AS MATERIALIZED (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {first})"], f"ORDER BY i ROWS BETWEEN"
        for j in range(levels):
            parts.append(
                f"{tag}s{j} AS MATERIALIZED (SELECT g, i, n, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 {own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 {own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tag}{j})")
            parts.append(
                f"{tag}{j + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d, "
                f"(max(n) + 7) // 8 AS n FROM {tag}{j} GROUP BY g, i // 8)")
        return parts

    def fold(first: str, tag: str, out: str) -> list[str]:
        """Up the levels: rows of ``first`` (r, g, i, f, proof) with f folded and proof extended."""
        parts, last = [], first
        for j in range(levels):
            s = f"{tag}s{j}"
            parts.append(
                f"{out}{j} AS MATERIALIZED (SELECT a.r, a.g, a.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(s.l || a.f || s.r) ELSE a.f END AS f, "
                f"CASE WHEN s.n > 1 THEN a.proof || s.l || s.r ELSE a.proof END AS proof FROM {last} a JOIN {s} s ON s.g = a.g AND s.i = a.i)")
            last = f"{out}{j}"
        return parts

    own = [
        "bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) "
        "ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))",
        "crc AS (SELECT row_number() OVER () AS r, documents.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split("
        "CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, bits)",
        f"leaf AS (SELECT r, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, {hashed('text')} AS d, "
        f"CASE WHEN crc % 3 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {hashed('text')} END AS shown FROM crc)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d, r) - 1 AS i FROM leaf)",
        *climb("tree", "placed", "a"),
        f"sub AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS tree FROM a{levels})",
        *climb("top", "sub", "b"),
        "up AS (SELECT r, g, i, shown AS f, '' AS proof FROM placed)",
        *fold("up", "a", "u"),
        f"over AS (SELECT u.r, sub.g, sub.i, u.f, u.proof FROM u{levels - 1} u JOIN sub ON sub.tree = u.g)",
        *fold("over", "b", "v"),
    ]
    return (
        f"WITH {', '.join(own)} SELECT p.doc_id, p.d AS leaf, sub.d AS subroot, b.d AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, "
        f"v.f = b.d AS verified FROM placed p JOIN sub ON sub.tree = p.g JOIN v{levels - 1} v ON v.r = p.r CROSS JOIN b{levels} b"
    )


ORACLE = _oracle()
