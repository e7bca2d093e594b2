"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.session import materialize, settle

#: A word is a run of anything but blank, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Members of a block that are compared in pairs at once; larger blocks go by leaders first (the heaviest member and some drawn ones)
#: and are then compared in pieces.
SMALL_BLOCK = 8
DRAWN = 2
PIECE = 1024
#: Blocks before the present one that tell whether two members have met already.
MET = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def share_of_ids(key: str, parts: int) -> Column:
    """The remainder of crc32(key as text); null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, part: int) -> Column:
    """Rows that no fit may see. A row without an id counts as not held out, but no label can refer to it."""
    return F.coalesce(share_of_ids(key, parts) == part, F.lit(False))


def per_row(
    df: DataFrame, inputs: list[str], outputs: str, compute: Callable[[list[list]], list[list]], most: int = 16 << 20,
) -> DataFrame:
    """Add columns computed in Python from ``inputs``, one Arrow batch at a time.

    ``compute`` gets the input columns of a batch as lists (strings as bytes) and returns
    the output columns as lists. Columns of ``df`` with the name of an output are replaced.
    ``most`` bounds the bytes of input that it gets at once.
    """
    added = T._parse_datatype_string(outputs)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    schema = T.StructType([*kept, *added.fields])
    names, types = [f.name for f in kept], [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inputs, most):
                got = compute([as_list(part.column(c)) for c in inputs])
                new = [pa.array(values, kind) for values, kind in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], [*names, *added.names])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, columns: list[str], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of the given columns, so that long texts don't fill a task's memory."""
    if not batch.num_rows:
        return
    rows = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, sum(batch.column(c).nbytes for c in columns)))))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def as_list(column: pa.Array) -> list:
    """Python values; strings as their UTF-8 bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bounded_labels(labels: DataFrame, label: str, train: Column, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` ids of each class, drawn by the hash of the id: (key, label).

    An id with several labels has the largest; null ids and labels are left out.
    """
    one = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
        .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    order = [F.xxhash64(F.col(key), F.lit(7)), F.col(key)]
    sides = [one.where(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    return sides[0].unionByName(sides[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with both classes given the same total weight; intercept last."""
    a = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    penalty = np.diag([*[ridge] * x.shape[1], 1e-6]) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``component_rounds``, written; the tables of the rounds are deleted."""
    return settle(lambda: component_rounds(edges, label), label)


def component_rounds(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each round is a few aggregates and joins and is
    written to the stage folder, so lost executors cost one round. Edges of a node with very many
    neighbours are pre-aggregated, and adaptive execution splits their join. Self loops and nulls
    are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct()
    now = materialize(now, label)
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen.n:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.distinct(), label)


def shared_blocks(dealt: DataFrame, label: str) -> DataFrame:
    """(h, block, size) of the blocks of ``dealt`` (h, block) that have several members."""
    sized = dealt.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("block")))
    return materialize(sized.where("size > 1"), f"{label}-blocks")


def links_of_blocks(
    shared: DataFrame, facts: DataFrame, fits: Column, verified: Callable[[DataFrame], DataFrame], label: str,
    small: int = SMALL_BLOCK, piece: int = PIECE, closer: tuple[DataFrame, Column] | None = None,
) -> DataFrame:
    """Links (a, b) between members (by ``h``) that share a block and are ``verified``, enough of them to join all that are.

    ``facts`` has h, a weight n and the columns that ``fits`` (a condition on the structs x and y) reads. Blocks of up to
    ``small`` members are compared in pairs. In a larger one each member is first compared with a few leaders, the heaviest
    member and ``DRAWN`` that each block draws for itself. After that only members that no links join are compared, in pieces
    of about ``piece`` members. Both ways join the same members, and a group of similar ones costs no square. ``closer`` has
    other facts for these (h and columns) and a condition on them: many members may share a passage and little else.
    """
    blocked = shared.join(facts, "h")
    member = F.struct(*[c for c in facts.columns if c != "n"])
    few = blocked.where(F.col("size") <= small).groupBy("block").agg(F.sort_array(F.collect_list(member)).alias("all"))  # ``small`` members at most
    each = few.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(small))).alias("y"))
    a_b = [F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")]
    links = settle(lambda: verified(each.where(fits).select(*a_b).distinct()), f"{label}-links")

    crowded = materialize(blocked.where(F.col("size") > small).select("block", "size", "n", member.alias("x")), f"{label}-crowded")
    if not crowded.take(1):
        return links
    drawn = [F.max(F.struct(F.xxhash64("x.h", "block", F.lit(k)).alias("n"), "x"))["x"] for k in range(DRAWN)]
    leaders = crowded.groupBy("block").agg(F.array_distinct(F.array(F.max(F.struct("n", "x"))["x"], *drawn)).alias("leaders"))
    star = crowded.join(leaders, "block").select("x", F.explode("leaders").alias("y")).where("x.h <> y.h")
    led = settle(lambda: verified(star.where(fits).select(*a_b).distinct()), f"{label}-leaders")
    links = links.unionByName(led)

    roots = connected_components(links, f"{label}-joined").select(F.col("node").alias("h"), "root")
    placed = crowded.withColumn("h", F.col("x.h")).join(roots, "h", "left").select("block", "size", "n", "h", "x", F.coalesce("root", "h").alias("root"))
    # The largest group that links have made in a block, roughly: that of its heaviest member. The rest is compared with all.
    main = placed.groupBy("block").agg(F.max(F.struct("n", "x", "root"))["root"].alias("main"), F.min("root").alias("least"), F.max("root").alias("most"))
    several = placed.join(main.where("least <> most").select("block", "main"), "block")
    if closer is not None:
        several = several.join(closer[0], "h").withColumn("x", F.struct(*closer[0].columns))
        fits = closer[1]
    # Members that share many blocks would meet in each of them.
    before = F.collect_list("block").over(Window.partitionBy("h").orderBy("block").rowsBetween(-MET, -1)).alias("before")
    apart = materialize(several.select("block", "size", "x", "root", "main", before), f"{label}-apart")
    met = meetings(apart, fits, piece).select(*a_b).distinct()
    return links.unionByName(settle(lambda: verified(met), f"{label}-others"))


def meetings(apart: DataFrame, fits: Column, piece: int) -> DataFrame:
    """(x, y) of the members of ``apart`` (block, size, x, root, main, before) that share a block, have different roots and fit.
    Members that share one of the blocks before, too, have met there."""
    pieces = F.ceil(F.col("size") / piece).cast("int")
    others = apart.where("root <> main").select("block", "x", "root", "before", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    all_of = apart.select(
        "block", F.col("x").alias("y"), F.col("root").alias("other"), F.col("before").alias("met"), (F.col("root") == F.col("main")).alias("in_main"),
        F.pmod(F.col("x.h"), pieces.cast("bigint")).cast("int").alias("piece"))
    met = others.join(all_of, ["block", "piece"]).where("root <> other and (in_main or x.h < y.h)").where(fits)
    return met.where(~F.coalesce(F.arrays_overlap("before", "met"), F.lit(False))).select("x", "y")
