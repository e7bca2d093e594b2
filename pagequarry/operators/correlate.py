"""From findings to root causes, recommendations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import scoring as S
from pagequarry.operators.templates import DEFAULT_GUIDANCE, TEMPLATES
from pagequarry.session import materialize

ORDER = ("rule_order", "key1", "key2")
#: Finding ids that a recommendation shows; ``recommendation_findings`` has them all.
LISTED_IDS = 10
SOURCED = ("URL", "RESOURCE", "SCRIPT")


def in_order() -> Column:
    return F.struct(*ORDER)


def _first_findings(findings: DataFrame, keep: int, *keys: str) -> DataFrame:
    """The first ``keep`` findings of each key; the limit also applies before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    return findings.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)


def cause_findings(findings: DataFrame) -> DataFrame:
    """Each finding with its root cause: the category and the host that its evidence names."""
    sourced = F.filter(
        "evidence", lambda e: e["evidence_type"].isin(*SOURCED) & (F.coalesce(e["source"], F.lit("")) != "")
    )
    source = F.get(sourced, F.lit(0))["source"]
    host = F.when(F.contains(source, F.lit("//")), F.get(F.split(source, "/"), F.lit(2))).otherwise(source)
    return findings.select(
        "scan_id", "category", F.coalesce(F.nullif(host, F.lit("")), F.lit("general")).alias("source_host"), "rule_id", "finding_id", *ORDER
    )


def root_causes(findings: DataFrame) -> DataFrame:
    """Findings that share a category and an evidence host, over all findings of a scan; in the order of their first finding.

    ``affected_findings`` lists the rules, each once, in the order of their first finding; ``cause_findings`` has the
    findings as rows.
    """
    group = ["scan_id", "category", "source_host"]
    rules = cause_findings(findings).groupBy(*group, "rule_id").agg(F.min(in_order()).alias("first"), F.count(F.lit(1)).alias("n"))
    grouped = rules.groupBy(*group).agg(
        F.min("first").alias("first"), F.sum("n").alias("finding_count"),
        F.sort_array(F.collect_list(F.struct("first", "rule_id"))).alias("rows"),  # as many as there are rules
    )
    return grouped.select(
        *group, F.row_number().over(Window.partitionBy("scan_id").orderBy("first")).cast("bigint").alias("position"), "finding_count",
        F.concat(F.initcap("category"), F.lit(" issues")).alias("title"),
        F.lit(0.6).cast("double").alias("confidence"),
        F.transform("rows", lambda r: r["rule_id"]).alias("affected_findings"),
    )


def _template(field: int) -> Column:
    pairs = [F.lit(x) for rule_id, row in TEMPLATES.items() for x in (rule_id, row[field])]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))


def preliminary_bucket(severity: Column, impact: Column) -> Column:
    combined = S.severity_points(severity) + S.points(impact, S.SEVERITY_POINTS, 0)
    return F.when(combined >= 6, "P0").when(combined >= 4, "P1").when(combined >= 2, "P2").otherwise("P3")


def recommendation_findings(findings: DataFrame) -> DataFrame:
    """The findings of every recommendation, as rows: (scan_id, rule_id, finding_id, affected_url) in the order of ``ORDER``."""
    return findings.select("scan_id", "rule_id", "finding_id", "affected_url", *ORDER)


def recommendations(findings: DataFrame, most: int | None = None) -> DataFrame:
    """One recommendation per rule of a scan, those of highest impact first; ``most`` keeps the first of them.

    Counts are over all findings of the rule; ``finding_ids`` shows the first ten.
    """
    strength = F.struct((-S.severity_points(F.col("severity"))).alias("s"), *ORDER)
    primary = F.struct("category", "title", "description", "severity", "impact", "effort", "confidence")
    groups = findings.groupBy("scan_id", "rule_id").agg(
        F.min_by(primary, strength).alias("p"), F.min(in_order()).alias("first"),
        F.min_by("severity", in_order()).alias("first_severity"), F.count(F.lit(1)).alias("finding_count"),
        F.greatest(F.lit(1), F.count_distinct("affected_url")).alias("affected_pages"),
    )
    listed = _first_findings(findings, LISTED_IDS, "scan_id", "rule_id").groupBy("scan_id", "rule_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "finding_id"))), lambda r: r["finding_id"]).alias("finding_ids"),
    )
    impact_rank = F.when(F.col("p.impact") == "CRITICAL", 0).when(F.col("p.impact") == "HIGH", 1).when(
        F.col("p.impact") == "MEDIUM", 2
    ).otherwise(3)
    order = Window.partitionBy("scan_id").orderBy("impact_rank", "first")
    kept = (
        groups.withColumn("impact_rank", impact_rank)
        .withColumn("position", F.row_number().over(order))
        .where(F.lit(True) if most is None else F.col("position") <= most)
        .join(listed, ["scan_id", "rule_id"])
    )
    generic = F.concat(F.lit("Address "), F.lower("p.category"), F.lit(" issue: "), F.col("p.title"))
    return kept.select(
        "scan_id", "rule_id", F.col("position").cast("bigint").alias("position"),
        F.coalesce(_template(0), generic).alias("title"),
        F.coalesce(_template(1), F.col("p.description")).alias("description"),
        F.coalesce(_template(2), F.lit(DEFAULT_GUIDANCE)).alias("implementation_guidance"),
        F.col("p.category").alias("category"),
        preliminary_bucket(F.col("p.severity"), F.col("p.impact")).alias("preliminary_priority"),
        F.col("p.impact").alias("impact"), F.col("p.effort").alias("effort"), F.col("p.confidence").alias("confidence"),
        F.col("p.title").alias("root_cause"), "finding_ids", F.col("first_severity").alias("severity"), "affected_pages",
        "finding_count",
    )


def resolve_references(recommendations: DataFrame, findings: DataFrame) -> DataFrame:
    """Check the finding ids of proposed recommendations against the scan's findings.

    Unknown ids are dropped; when none is left the category's first finding is
    linked. Adds severity (of the first linked finding) and affected_pages. A
    recommendation is identified by (scan_id, rec_id).
    """
    known = findings.select(
        F.col("scan_id"), F.col("finding_id"), F.col("severity").alias("f_severity"), F.col("affected_url").alias("f_url"),
        in_order().alias("f_order"),
    )
    asked = recommendations.select("scan_id", "rec_id", F.explode_outer("finding_ids").alias("finding_id")).distinct()
    linked = asked.join(known, ["scan_id", "finding_id"]).select("scan_id", "rec_id", "finding_id", "f_severity", "f_url", "f_order")
    first_of_category = findings.groupBy("scan_id", "category").agg(
        F.min_by(F.struct("finding_id", "severity", "affected_url"), in_order()).alias("f"),
    )
    unlinked = recommendations.select("scan_id", "rec_id", "category").join(
        linked.select("scan_id", "rec_id").distinct(), ["scan_id", "rec_id"], "left_anti"
    )
    fallback = unlinked.join(first_of_category, ["scan_id", "category"]).select(
        "scan_id", "rec_id", F.col("f.finding_id").alias("finding_id"), F.col("f.severity").alias("f_severity"),
        F.col("f.affected_url").alias("f_url"),
        F.struct(F.lit(0).alias("rule_order"), F.lit(0).cast("bigint").alias("key1"), F.lit(0).cast("bigint").alias("key2")).alias("f_order"),
    )
    per_rec = linked.unionByName(fallback).groupBy("scan_id", "rec_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("f_order", "finding_id"))), lambda r: r["finding_id"]).alias("finding_ids"),
        F.min_by("f_severity", "f_order").alias("severity"),
        F.greatest(F.lit(1), F.count_distinct("f_url")).alias("affected_pages"),
    )
    return recommendations.drop("finding_ids", "severity", "affected_pages").join(per_rec, ["scan_id", "rec_id"], "left").select(
        *[c for c in recommendations.columns if c not in ("finding_ids", "severity", "affected_pages")],
        F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("affected_pages", F.lit(1)).alias("affected_pages"),
    )


def ranked_recommendations(recommendations: DataFrame, facts: DataFrame) -> DataFrame:
    """Recommendations with priority score, bucket, explanation and rank within their scan."""
    totals = facts.select("scan_id", F.col("pages").alias("total_pages"))
    scored = recommendations.join(totals, "scan_id", "left").withColumn(
        "total_pages", F.greatest(F.lit(1), F.coalesce("total_pages", F.lit(1)))
    ).withColumn(
        "priority_score",
        S.priority_score(F.col("severity"), F.col("impact"), F.col("effort"), F.col("confidence"),
                         F.col("affected_pages"), F.col("total_pages")),
    )
    order = Window.partitionBy("scan_id").orderBy(F.desc("priority_score"), "position")
    return scored.select(
        "*", S.priority_bucket(F.col("priority_score")).alias("priority"),
        S.priority_explanation(F.col("severity"), F.col("impact"), F.col("effort"), F.col("confidence")).alias("priority_explanation"),
        F.row_number().over(order).cast("bigint").alias("rank"),
    )


def summaries(scores: DataFrame, findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Headline, executive summary, top risks, opportunities and roadmap of each scan with findings."""
    severe = findings.where(F.col("severity").isin("CRITICAL", "HIGH")).select("scan_id", "title", *ORDER)
    severe_count = severe.groupBy("scan_id").agg(F.count(F.lit(1)).alias("severe"))
    risks = _first_findings(severe, 4, "scan_id").groupBy("scan_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "title"))), lambda r: r["title"]).alias("risks")
    )
    recs = recommendations.where(F.col("position") <= 5).groupBy("scan_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "title", "impact"))).alias("recs")
    )
    measured = findings.select("scan_id").distinct()
    joined = measured.join(scores, "scan_id", "left").join(risks, "scan_id", "left").join(recs, "scan_id", "left").join(severe_count, "scan_id", "left")
    none = F.array().cast("array<string>")
    slots = F.array(*[
        F.struct(F.col(f"{c.lower()}_score").alias("score"), F.lit(i).alias("i"), F.lit(c).alias("name"))
        for i, c in enumerate(S.CATEGORIES)
    ])
    worst = F.slice(F.array_sort(F.filter(slots, lambda s: s["score"].isNotNull())), 1, 3)

    def whole(score: Column) -> Column:
        return F.round(score).cast("int").cast("string")

    worst_text = F.array_join(F.transform(worst, lambda s: F.concat(s["name"], F.lit(" "), whole(s["score"]))), ", ")
    staged = joined.select(
        "scan_id", "overall_score", worst_text.alias("worst"), F.coalesce("severe", F.lit(0)).alias("severe"), F.coalesce("risks", none).alias("risks"),
        F.coalesce(F.transform("recs", lambda r: r["title"]), none).alias("titles"),
        F.coalesce(
            F.transform(
                F.filter(F.slice("recs", 1, 3), lambda r: r["impact"].isin("HIGH", "MEDIUM")), lambda r: r["title"]
            ), none,
        ).alias("opportunities"),
    )
    overall = whole(F.col("overall_score"))
    unmeasured = F.col("overall_score").isNull()
    opening = F.when(unmeasured, F.lit("Health score not measured.")).otherwise(
        F.concat(F.lit("Health score "), overall, F.lit("/100."))
    )
    steps = F.array_join(F.slice("opportunities", 1, 2), ", ")
    return staged.select(
        "scan_id",
        F.when(unmeasured, F.lit("Overall health score could not be computed yet.")).otherwise(
            F.concat(F.lit("Overall health score is "), overall, F.lit("/100."))
        ).alias("headline"),
        F.concat(
            opening, F.lit(" Weakest areas: "),
            F.when(F.col("worst") == "", F.lit("all categories unmeasured")).otherwise(F.col("worst")),
            F.lit(". "), F.col("severe").cast("string"), F.lit(" critical/high issues identified. Highest-impact next steps: "),
            F.when(steps == "", F.lit("none recorded")).otherwise(steps), F.lit("."),
        ).alias("executive_summary"),
        F.when(F.size("risks") == 0, F.array(F.lit("No critical or high findings recorded."))).otherwise(F.col("risks")).alias("top_risks"),
        F.when(F.size("opportunities") == 0, F.array(F.lit("Not enough measured data to prioritize."))).otherwise(
            F.col("opportunities")
        ).alias("biggest_opportunities"),
        F.transform(F.slice("titles", 1, 5), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)).alias("roadmap"),
    )


def _context_entry(evidences: int | None) -> Column:
    """What a context says of a finding: short texts, and ``evidences`` pieces of evidence (all if None)."""
    shown = F.col("evidence") if evidences is None else F.slice("evidence", 1, evidences)
    return F.struct(
        "finding_id", "rule_id", "category", "title", F.substring("description", 1, 300).alias("description"),
        "severity", "impact", "effort", "confidence", "affected_url",
        F.transform(
            shown,
            lambda e: F.struct(
                e["evidence_type"].alias("type"), F.substring(F.coalesce(e["source"], F.lit("")), 1, 150).alias("source"),
                F.substring(F.coalesce(e["value"], F.lit("")), 1, 200).alias("value"),
            ),
        ).alias("evidence"),
    )


def evidence_context(findings: DataFrame, most: int = 80, evidences: int = 6, max_chars: int = 24_000) -> DataFrame:
    """One compact JSON text per scan: its first findings with short evidence. ``evidence_chunks`` has all of them."""
    listed = _first_findings(findings, most, "scan_id").groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("nth", _context_entry(evidences).alias("entry")))), lambda r: r["entry"]).alias("findings"),
    )
    body = F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("metrics"), F.col("findings")))
    with_text = listed.select("scan_id", "finding_count", body.alias("body"))
    cut = F.concat(F.substring("body", 1, max_chars), F.lit("\n[context truncated]"))
    return with_text.select(
        "scan_id", "finding_count", F.when(F.length("body") > max_chars, cut).otherwise(F.col("body")).alias("context")
    )


#: Findings of a rule within a scan are dealt to so many buckets; a running sum over a scan has one row for each rule and bucket.
BUCKETS = 1024
_OPEN, _CLOSE = '{"metrics":{},"findings":[', "]}"


def evidence_chunks(findings: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """(scan_id, chunk_start, finding_count, context): all findings of a scan as JSON texts of at most ``max_chars``
    characters, in the order of ``chunk_start``; each text is whole JSON and each finding stands in one of them.

    Findings are packed by the running sum of their lengths: those that begin in the same stretch of half a text go
    together, so a text is at least half full where more findings follow. A finding longer than half a text has a
    text of its own, which alone may be longer than ``max_chars``. Running sums go over (rule, bucket) first and then
    within a bucket, so a scan with very many findings is no task of its own. Scans without findings have no text.
    """
    room = (max_chars - len(_OPEN) - len(_CLOSE)) // 2
    if room <= 0:
        raise ValueError("max_chars leaves no room for findings")
    place = ["scan_id", "rule_order", "bucket"]
    bucket = F.pmod(F.xxhash64("finding_id"), F.lit(BUCKETS)).cast("int")
    entries = materialize(
        findings.select("scan_id", "rule_order", bucket.alias("bucket"), "finding_id", F.to_json(_context_entry(None)).alias("entry"))
        .withColumn("size", F.length("entry").cast("bigint") + 1), "context-entries")
    ahead = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = entries.groupBy(*place).agg(F.sum("size").alias("size"))
    before = sums.select(*place, ahead(Window.partitionBy("scan_id").orderBy("rule_order", "bucket")).alias("before"))
    placed = entries.join(before, place).withColumn("start", F.col("before") + ahead(Window.partitionBy(*place).orderBy("finding_id", "entry")))
    alone = F.col("size") > room
    packed = placed.withColumn("alone", F.when(alone, F.col("start"))).withColumn("stretch", F.floor(F.col("start") / room))
    return packed.groupBy("scan_id", "stretch", "alone").agg(
        F.min("start").alias("chunk_start"), F.count(F.lit(1)).alias("finding_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "entry"))), lambda r: r["entry"]), ",").alias("body"),  # ``max_chars`` bounds it
    ).select("scan_id", "chunk_start", "finding_count", F.concat(F.lit(_OPEN), "body", F.lit(_CLOSE)).alias("context"))
