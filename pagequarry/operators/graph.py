"""Site graphs, layering and crawl reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.urls import hostname_of
from pagequarry.operators.reports import scan_by_id
from pagequarry.session import materialize


def _base_hosts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("scan_id").agg(F.min_by("url", "seq").alias("base_url")).select(
        "scan_id", hostname_of(F.col("base_url")).alias("base_host")
    )


def graph_nodes(
    pages: DataFrame, resources: DataFrame, technologies: DataFrame, domains: int | None = None, per_page: int | None = None,
) -> DataFrame:
    """Nodes of every site graph: domain, pages, technologies, resource domains, resources.

    For a small picture, ``domains`` keeps a scan's most frequent resource domains and ``per_page`` the first resources
    of each page. A node seen more than once keeps the label and metadata of its last occurrence. ``metadata`` has the
    status and depth of pages, category and confidence of technologies, resources of a domain, type and size of resources.
    """
    hosts = _base_hosts(pages)
    domain = hosts.select("scan_id", F.lit("DOMAIN").alias("node_type"), F.col("base_host").alias("name"), F.lit("Site domain").alias("label"), _metadata())
    last = F.max_by(F.struct(F.coalesce(F.nullif("title", F.lit("")), "url").alias("label"), "status_code", "depth"), "seq").alias("last")
    page = pages.groupBy("scan_id", "url").agg(last).select(
        "scan_id", F.lit("PAGE").alias("node_type"), F.col("url").alias("name"), "last.label",
        _metadata(status_code=F.col("last.status_code"), depth=F.col("last.depth")),
    )
    percent = F.round(F.col("confidence") * 100).cast("int").cast("string")
    technology = technologies.select(
        "scan_id", F.lit("TECHNOLOGY").alias("node_type"), "name",
        F.concat("category", F.lit(" · "), percent, F.lit("%")).alias("label"),
        _metadata(category=F.col("category"), confidence=F.col("confidence")),
    )
    counted = resources.where(F.coalesce("domain", F.lit("")) != "").groupBy("scan_id", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "ord")).alias("first_seen")
    )
    order = Window.partitionBy("scan_id").orderBy(F.desc("n"), "first_seen")
    if domains is not None:
        counted = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= domains)
    third = (
        counted.join(hosts, "scan_id").where(F.col("domain") != F.col("base_host"))
        .select("scan_id", F.lit("THIRD_PARTY").alias("node_type"), F.col("domain").alias("name"), F.col("domain").alias("label"), _metadata(resource_count=F.col("n")))
    )
    shown = _first_of_page(resources, per_page).groupBy("scan_id", "url").agg(
        F.max_by(F.struct("resource_type", "size_bytes"), F.struct("seq", "ord")).alias("last")
    ).select(
        "scan_id", F.lit("RESOURCE").alias("node_type"), F.col("url").alias("name"),
        F.concat("last.resource_type", F.lit(": "), "url").alias("label"),
        _metadata(resource_type=F.col("last.resource_type"), size_bytes=F.col("last.size_bytes")),
    )
    return domain.unionByName(page).unionByName(technology).unionByName(third).unionByName(shown)


def _metadata(**facts: Column) -> Column:
    """What is known of a node besides its label, as texts by name; facts that are null are left out."""
    entries = F.array(*[F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")) for name, value in facts.items()]) if facts else (
        F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata")


def graph_of_scan(nodes: DataFrame, edges: DataFrame, scans: DataFrame, websites: DataFrame, user_id: int, scan_id: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of one stored scan, if it belongs to a website of the user; else none."""
    mine = scan_by_id(scans, websites, user_id, scan_id).select("scan_id")
    return tuple(rows.where(F.col("scan_id") == scan_id).join(mine, "scan_id", "left_semi") for rows in (nodes, edges))


def _first_of_page(resources: DataFrame, per_page: int | None) -> DataFrame:
    return resources if per_page is None else resources.where(F.col("ord") < per_page)


def graph_edges(pages: DataFrame, resources: DataFrame, per_page: int | None = None) -> DataFrame:
    """Edges before dangling ones are dropped: hosts, references, loaded from."""
    def edge(source_type: str, source, target_type: str, target, relationship: str):
        return F.struct(
            F.lit(source_type).alias("source_type"), source.alias("source"), F.lit(target_type).alias("target_type"),
            target.alias("target"), F.lit(relationship).alias("relationship"),
        )

    hosts = pages.select("scan_id", "url").distinct().join(_base_hosts(pages), "scan_id").select(
        "scan_id", F.inline(F.array(edge("DOMAIN", F.col("base_host"), "PAGE", F.col("url"), "HOSTS")))
    )
    loaded = F.col("is_external") & (F.coalesce("domain", F.lit("")) != "")
    of_resources = (
        _first_of_page(resources, per_page)
        .join(pages.select("scan_id", "seq", F.col("url").alias("page_url")), ["scan_id", "seq"])
        .select(
            "scan_id",
            F.inline(F.filter(
                F.array(
                    edge("PAGE", F.col("page_url"), "RESOURCE", F.col("url"), "REFERENCES"),
                    F.when(loaded, edge("RESOURCE", F.col("url"), "THIRD_PARTY", F.col("domain"), "LOADED_FROM")),
                ),
                lambda e: e.isNotNull(),
            )),
        )
    )
    return hosts.unionByName(of_resources).distinct()


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes.

    Only third-party ends can lack a node (domains that a limit left out), so only
    those edges meet the node table.
    """
    known = nodes.where(F.col("node_type") == "THIRD_PARTY").select("scan_id", F.col("name").alias("target"))
    to_third = F.col("target_type") == "THIRD_PARTY"
    return edges.where(~to_third).unionByName(edges.where(to_third).join(known, ["scan_id", "target"], "left_semi").select(*edges.columns))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows for the joins of rounds: shuffled, never collected and broadcast. The driver would get a copy of them each round."""
    return rows.hint("merge")


def strong_components(edges: DataFrame) -> DataFrame:
    """(scan_id, node_id, component) of every node on a cycle, and of some others; ``component`` is the smallest node of those that reach one another.

    Every node learns the smallest node that reaches it and the smallest one that it reaches. Where these are one node,
    it belongs to that node's component. A component can't lie across different pairs of them, so only edges between
    nodes of one pair go round again. Every round is written; rounds grow with the length of paths, not with the number
    of nodes.
    """
    scan, node = "scan_id", "node_id"
    rest = materialize(edges.where("source <> target").select(scan, "source", "target").distinct(), "cyclic")
    found = None
    while not rest.isEmpty():
        ends = rest.select(scan, F.explode(F.array("source", "target")).alias(node)).distinct()
        state = materialize(ends.select(scan, node, F.col(node).alias("from"), F.col(node).alias("to")), "cyclic-state")
        while True:
            down = rest.join(_sent(state.select(scan, F.col(node).alias("source"), "from")), [scan, "source"]).select(
                scan, F.col("target").alias(node), "from", F.lit(None).alias("to"))
            up = rest.join(_sent(state.select(scan, F.col(node).alias("target"), "to")), [scan, "target"]).select(
                scan, F.col("source").alias(node), F.lit(None).alias("from"), "to")
            told = down.unionByName(up).groupBy(scan, node).agg(F.min("from").alias("f"), F.min("to").alias("t"))
            new = state.join(_sent(told), [scan, node]).select(
                scan, node, F.least("from", "f").alias("from"), F.least("to", "t").alias("to"),
                (F.coalesce(F.col("f") < F.col("from"), F.lit(False)) | F.coalesce(F.col("t") < F.col("to"), F.lit(False))).alias("fell"),
            )
            state = materialize(new, "cyclic-state")
            done = state.where("fell").isEmpty()
            state = state.drop("fell")
            if done:
                break
        members = state.where("from = to").select(scan, node, F.col("from").alias("component"))
        found = members if found is None else found.unionByName(members)
        pair = F.struct("from", "to")
        a = state.where("from <> to").select(scan, F.col(node).alias("source"), pair.alias("pair"))
        b = state.where("from <> to").select(scan, F.col(node).alias("target"), pair.alias("pair"))
        rest = materialize(rest.join(_sent(a), [scan, "source"]).join(_sent(b), [scan, "target", "pair"]).select(scan, "source", "target"), "cyclic")
    if found is None:
        return edges.select(scan, F.col("source").alias(node), F.col("source").alias("component")).where("false")
    return found


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, node_id, layer, component): the longest path to each node, from edges (scan_id, source, target).

    Nodes on a common cycle are one component with one layer; any other node is its own component. Edges of a
    component within itself and edges with an end that is no node don't count. Each round keeps the edges that leave
    components which an edge kept so far still reaches, so work shrinks; a component's layer is the last round that
    reached it.
    """
    scan = "scan_id"
    ends = nodes.select(scan, "node_id").distinct()
    known = materialize(
        edges.join(_sent(ends.withColumnRenamed("node_id", "source")), [scan, "source"], "left_semi")
        .join(_sent(ends.withColumnRenamed("node_id", "target")), [scan, "target"], "left_semi").select(scan, "source", "target").distinct(),
        "layer-edges",
    )
    of_cycle = strong_components(known)
    member = materialize(
        ends.join(_sent(of_cycle), [scan, "node_id"], "left").select(scan, "node_id", F.coalesce("component", "node_id").alias("component")), "layer-members"
    )
    between = known.join(_sent(member.withColumnRenamed("node_id", "source").withColumnRenamed("component", "a")), [scan, "source"]).join(
        _sent(member.withColumnRenamed("node_id", "target").withColumnRenamed("component", "b")), [scan, "target"])
    rest = materialize(between.where("a <> b").select(scan, "a", "b").distinct(), "layer-edges")
    entered, layer = None, 0
    while not rest.isEmpty():
        layer += 1
        reached = rest.select(scan, F.col("b").alias("component"), F.lit(layer).cast("bigint").alias("layer"))
        entered = reached if entered is None else entered.unionByName(reached)
        rest = materialize(rest.join(_sent(reached.select(scan, F.col("component").alias("a")).distinct()), [scan, "a"], "left_semi"), "layer-edges")
    if entered is None:
        return member.select(scan, "node_id", F.lit(0).cast("bigint").alias("layer"), "component")
    last = entered.groupBy(scan, "component").agg(F.max("layer").alias("layer"))
    return member.join(_sent(last), [scan, "component"], "left").select(scan, "node_id", F.coalesce("layer", F.lit(0).cast("bigint")).alias("layer"), "component")


def index_in_layer(layered: DataFrame) -> DataFrame:
    """Position of each node in its layer.

    Numbered within sorted ranges first and shifted by the ranges before, so one
    huge layer is not sorted in one task.
    """
    keys = ["scan_id", "layer"]
    ranged = materialize(
        layered.repartitionByRange("scan_id", "layer", "node_id").withColumn("part", F.spark_partition_id()), "index"
    )
    local = ranged.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("node_id")) - 1)
    counts = ranged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return local.join(_sent(shifts), [*keys, "part"]).select(
        "scan_id", "node_id", "layer", (F.col("i") + F.col("shift")).cast("bigint").alias("index")
    )


def reachable(
    starts: DataFrame, links: DataFrame, fetchable: DataFrame, max_depth: int = 3, max_pages: int | None = None,
    refused: DataFrame | None = None,
) -> DataFrame:
    """Pages a breadth-first crawl reaches: (scan_id, url, depth, crawl_order).

    ``starts`` (scan_id, url), ``links`` (scan_id, from_url, to_url, pos),
    ``fetchable`` (scan_id, url) are the pages that answer; ``refused`` (scan_id,
    url) are never visited. The crawl order of a page is the path of link positions
    that led to it, so order within a level needs no global numbering; a page limit
    is a top-k per scan over that order, applied level by level.
    """
    path = F.array(F.lit(0).cast("bigint"))
    answering = fetchable.select("scan_id", "url").distinct()
    frontier = materialize(
        starts.join(answering, ["scan_id", "url"], "left_semi").select("scan_id", "url", F.lit(0).alias("depth"), path.alias("crawl_order")),
        "frontier",
    )
    visited = frontier
    for depth in range(1, max_depth + 1):
        found = (
            frontier.select("scan_id", F.col("url").alias("from_url"), "crawl_order")
            .join(links, ["scan_id", "from_url"])
            .select("scan_id", F.col("to_url").alias("url"), F.array_append("crawl_order", F.col("pos").cast("bigint")).alias("crawl_order"))
            .groupBy("scan_id", "url").agg(F.min("crawl_order").alias("crawl_order"))
            .join(visited.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
            .join(answering, ["scan_id", "url"], "left_semi")
        )
        if refused is not None:
            found = found.join(refused.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
        found = found.select("scan_id", "url", F.lit(depth).alias("depth"), "crawl_order")
        if max_pages is not None:
            found = _top_pages(found, max_pages)
        frontier = materialize(found, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited if max_pages is None else _top_pages(visited, max_pages)


def _top_pages(pages: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("scan_id").orderBy("depth", "crawl_order")
    return pages.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")
