"""Mixing sources to target weights: a min-cost flow from groups of documents to the quotas of sources."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import WORD
from pagequarry.session import materialize

REPEATS = 3
SEED = "mix-1"
#: Groups of documents (sets of sources they belong to) that the flow is solved for on the driver.
MOST_GROUPS = 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of all words by weight; what is above ``repeats`` times a source's size goes to the others by weight, until none is above."""
    total, open_sources, done = sum(sizes.values()), set(sizes), {}
    while open_sources:
        rest, weight = total - sum(done.values()), sum(weights[s] for s in open_sources)
        full = {s for s in open_sources if weights[s] * rest > repeats * sizes[s] * weight}
        if not full:
            return done | {s: weights[s] * rest / weight for s in open_sources}
        done |= {s: repeats * sizes[s] for s in full}
        open_sources -= full
    return done


def cheapest_flow(groups: list[tuple[int, list[int]]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """For each group (size, its sources) the words it gives to each source.

    A group offers its size once at cost 0, again at cost 1, and so on up to ``repeats`` times, so nothing is
    repeated while unused words of a fitting group are left; as much as possible flows, at the least cost.
    Successive shortest augmenting paths on (start, groups, sources, end).
    """
    n_groups, end = len(groups), 1 + len(groups) + len(quotas)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, left, cost = [], [], []

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
        return len(to) - 2

    routes: list[dict[int, int]] = []
    for g, (size, sources) in enumerate(groups):
        for price in range(repeats):
            edge(0, 1 + g, size, price)
        routes.append({s: edge(1 + g, 1 + n_groups + s, sum(quotas), 0) for s in sources})
    for s, quota in enumerate(quotas):
        edge(1 + n_groups + s, end, quota, 0)
    while True:
        best, via, queue, queued = [None] * (end + 1), [-1] * (end + 1), deque([0]), {0}
        best[0] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if left[e] and (best[to[e]] is None or best[a] + cost[e] < best[to[e]]):
                    best[to[e]], via[to[e]] = best[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if best[end] is None:
            return [{s: left[e ^ 1] for s, e in own.items()} for own in routes]
        path, node = [], end
        while node:
            path.append(via[node])
            node = to[via[node] ^ 1]
        most = min(left[e] for e in path)
        for e in path:
            left[e] -= most
            left[e ^ 1] += most


def mix(sized: DataFrame, sources: str, size: str, key: str, weights: dict, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Add ``target`` (of the document's first source) and ``taken`` to documents with an array of sources.

    Documents are summed up by their set of sources (an array, null source allowed; at most ``MOST_GROUPS`` sets,
    else an error), the flow gives each set its words, and within a set all documents are taken as often
    as the words suffice for, and once more in the seeded order of ``key`` until the words are used up; the
    last document is cut. Places in the seeded order come from sums over hash buckets, then within a bucket, so
    a large source is spread over tasks. Repeated rows are separate documents in a fixed order.
    """
    spark = sized.sparkSession
    every = F.array_sort(F.array_distinct(F.transform(F.col(sources), lambda s: F.struct(s.isNull().alias("n"), s.alias("s")))))
    rows = sized.withColumn("group_key", F.to_json(every)).withColumn("order_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.substring("order_key", 1, 4))
    sums = materialize(rows.groupBy("group_key", "bucket").agg(F.first(every).alias("every"), F.sum(size).alias("words")), "mix-sums")
    groups = sums.groupBy("group_key").agg(F.first("every").alias("every"), F.sum("words").alias("words")).orderBy("group_key").limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} sets of sources")
    members = [[x.s for x in g.every] for g in groups]
    sizes = {s: sum(g.words for g, own in zip(groups, members, strict=True) if s in own) for s in {s for own in members for s in own}}
    wanted = targets(sizes, {s: weights[s] for s in sizes}, repeats)
    # Each word of an overlap counts for several sources' sizes; shares are of the words there are.
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    flow = cheapest_flow([(g.words, [place[s] for s in own]) for g, own in zip(groups, members, strict=True)], [round(wanted[s]) for s in names], repeats)
    plan = [
        (g.group_key, min(own, key=lambda s: place[s]), sizes[min(own, key=lambda s: place[s])], float(wanted[min(own, key=lambda s: place[s])]),
         sum(f.values()) // g.words if g.words else 0, sum(f.values()) % g.words if g.words else 0)
        for g, own, f in zip(groups, members, flow, strict=True) if own
    ]
    planned = spark.createDataFrame(plan, "group_key string, first_source string, source_size bigint, target double, times bigint, extra bigint")
    by_bucket = Window.partitionBy("group_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 buckets at most
    before = sums.select("group_key", "bucket", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("before"), "words")
    cut = before.join(F.broadcast(planned), "group_key")  # MOST_GROUPS rows at most
    edge = cut.where("before < extra and before + words > extra").select("group_key", F.col("bucket").alias("edge_bucket"), F.col("before").alias("edge_before"))
    per_group = planned.join(edge, "group_key", "left")
    placed = rows.join(F.broadcast(per_group), "group_key")
    # Only one bucket of each group needs an order within it.
    is_edge = F.col("bucket") == F.col("edge_bucket")
    whole = F.when(is_edge.eqNullSafe(True), F.lit(None)).when(F.col("edge_bucket").isNotNull(), F.col("bucket") < F.col("edge_bucket")).otherwise(F.col("extra") > 0)
    plain = placed.where(~is_edge.eqNullSafe(True)).withColumn("more", F.when(whole, F.col(size)).otherwise(0))
    within = Window.partitionBy("group_key").orderBy("order_key", F.col(key), F.col(size)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("edge_before") + F.coalesce(F.sum(size).over(within), F.lit(0))
    edges = placed.where(is_edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col(size), F.col("extra") - ahead)))
    both = plain.unionByName(edges)
    return both.withColumn("taken", (F.col(size) * F.col("times") + F.col("more")).cast("bigint")).drop(
        "group_key", "order_key", "bucket", "first_source", "times", "extra", "edge_bucket", "edge_before", "more")


def mix_documents(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: sources by code point, null last, weigh 1, 2, 3, 1, ..."""
    sized = materialize(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text").cast("string")).alias("size")), "mix-sizes")
    names = [r.source for r in sized.select("source").distinct().limit(MOST_GROUPS + 1).collect()]
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}
    mixed = mix(sized.withColumn("sources", F.array("source")), "sources", "size", "doc_id", weights, repeats)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({REPEATS} * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth
  FROM s),
first_open AS (SELECT min(nth) AS nth FROM r WHERE weight * (total - capped) <= {REPEATS} * source_size * open_weight),
level AS (SELECT r.total - r.capped AS rest, r.open_weight, r.nth FROM r JOIN first_open USING (nth)),
t AS (
  SELECT r.source, r.source_size, CASE WHEN r.nth < level.nth THEN {REPEATS}.0 * r.source_size
    ELSE (r.weight * level.rest)::DOUBLE / level.open_weight::DOUBLE END AS target FROM r, level),
q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round_even(target, 0)::BIGINT // source_size END AS times,
    CASE WHEN source_size = 0 THEN 0 ELSE round_even(target, 0)::BIGINT % source_size END AS extra FROM t),
o AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.times, q.extra,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * times + greatest(0, least(size, extra - ahead)))::BIGINT AS taken FROM o
"""


def mix_rows(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The documents that the mix takes, with their columns and size, source_size, target, taken (replacing columns of those names)."""
    named = [r.source for r in docs.select(F.col("source").cast("string").alias("source")).distinct().limit(MOST_GROUPS + 1).collect()]
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(named, key=lambda s: (s is None, s or "")))}
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.array(F.col("source").cast("string")).alias("sources"),
        words_in(F.col("text").cast("string")).alias("size"))
    mixed = mix(rows, "sources", "size", "id", weights, repeats).where("taken > 0")
    new = ["size", "source_size", "target", "taken"]
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)
