"""Changes between scans. Every pair of consecutive scans of every site at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.scoring import CATEGORIES

TEXT_DIMENSIONS = ("overall", "SECURITY", "PERFORMANCE", "ACCESSIBILITY", "PRIVACY", "SEO")
PAIR = ("website_id", "base_scan_id", "compare_scan_id")


def consecutive_pairs(scans: DataFrame) -> DataFrame:
    """Each scan of a site with the one before it."""
    order = Window.partitionBy("website_id").orderBy("started_at", "scan_id")
    return scans.select("website_id", F.lag("scan_id").over(order).alias("base_scan_id"), F.col("scan_id").alias("compare_scan_id")).where(
        F.col("base_scan_id").isNotNull()
    )


def chosen_pairs(requested: DataFrame, scans: DataFrame) -> DataFrame:
    """Requested (website_id, base_scan_id, compare_scan_id) rows that are two different scans of that site."""
    def side(name: str) -> DataFrame:
        return scans.select("website_id", F.col("scan_id").alias(name))

    return (
        requested.where(F.col("base_scan_id") != F.col("compare_scan_id"))
        .join(side("base_scan_id"), ["website_id", "base_scan_id"], "left_semi")
        .join(side("compare_scan_id"), ["website_id", "compare_scan_id"], "left_semi")
        .select(*PAIR)
    )


def _sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both scans of each pair, marked by side; ``rows`` carry scan_id."""
    ends = pairs.select(
        *PAIR,
        F.explode(F.array(
            F.struct(F.col("base_scan_id").alias("scan_id"), F.lit(True).alias("before")),
            F.struct(F.col("compare_scan_id").alias("scan_id"), F.lit(False).alias("before")),
        )).alias("e"),
    ).select(*PAIR, "e.*")
    return rows.join(ends, "scan_id")


def labels(pages: DataFrame, resources: DataFrame, technologies: DataFrame) -> DataFrame:
    """Everything that is compared as a set: (scan_id, kind, label)."""
    external = F.col("is_external") & (F.coalesce("domain", F.lit("")) != "")
    of_resources = resources.select(
        "scan_id",
        F.explode(F.filter(
            F.array(
                F.struct(F.lit("resources").alias("kind"), F.col("url").alias("label")),
                F.when(external, F.struct(F.lit("third_party").alias("kind"), F.col("domain").alias("label"))),
            ),
            lambda x: x.isNotNull(),
        )).alias("x"),
    ).select("scan_id", "x.*")
    return (
        pages.select("scan_id", F.lit("pages").alias("kind"), F.col("url").alias("label"))
        .unionByName(of_resources)
        .unionByName(technologies.select("scan_id", F.lit("technologies").alias("kind"), F.col("name").alias("label")))
    )


def set_changes(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels that only one scan of a pair has.

    Both sides meet in one aggregate, which dedupes before the shuffle; there is no
    outer join and no sorted list per scan.
    """
    seen = _sides(labelled, pairs).groupBy(*PAIR, "kind", "label").agg(
        F.bool_or("before").alias("had"), F.bool_or(~F.col("before")).alias("has")
    )
    change = F.when(F.col("has") & ~F.col("had"), "added").when(F.col("had") & ~F.col("has"), "removed")
    return seen.select(*PAIR, F.col("kind").alias("category"), change.alias("type"), "label").where(F.col("type").isNotNull())


def header_changes(homes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Headers of the home page whose values differ, as 'old -> new', whole."""
    rows = homes.select("scan_id", F.explode("headers").alias("label", "value"))
    seen = _sides(rows, pairs).groupBy(*PAIR, "label").agg(
        F.max(F.when(F.col("before"), F.col("value"))).alias("old"), F.max(F.when(~F.col("before"), F.col("value"))).alias("new")
    )

    def shown(value: str) -> Column:
        return F.coalesce(F.col(value), F.lit("(removed)"))

    return seen.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        *PAIR, F.lit("header").alias("category"), F.lit("changed").alias("type"), "label",
        F.concat(shown("old"), F.lit(" -> "), shown("new")).alias("detail"),
    )


def unpivot_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """Nine score columns as (label, score) rows; unmeasured scores are left out."""
    slots = [F.struct(F.lit("overall").alias("label"), F.col("overall_score").alias("score"))] + [
        F.struct(F.lit(c).alias("label"), F.col(f"{c.lower()}_score").alias("score")) for c in CATEGORIES
    ]
    return scores.select(*(keys or ("scan_id",)), F.inline(F.array(*slots))).where(F.col("score").isNotNull())


def score_changes(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score before, after and difference for each dimension both scans measured."""
    rows = unpivot_scores(scores)
    both = _sides(rows, pairs).groupBy(*PAIR, "label").agg(
        F.max(F.when(F.col("before"), F.col("score"))).alias("before"),
        F.max(F.when(~F.col("before"), F.col("score"))).alias("after"),
    ).where(F.col("before").isNotNull() & F.col("after").isNotNull())
    exact = F.col("after").cast("decimal(5,1)") - F.col("before").cast("decimal(5,1)")
    return both.select(*PAIR, "label", "before", "after", exact.cast("double").alias("delta"))


def finding_changes(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rules found in only one scan of a pair: 'fixed' or 'new', with the last finding's title."""
    last = F.struct("rule_order", "key1", "key2")
    per_rule = findings.groupBy("scan_id", "rule_id").agg(F.max_by(F.struct("title", "severity"), last).alias("f"))
    seen = _sides(per_rule, pairs).groupBy(*PAIR, "rule_id").agg(
        F.max_by("f", "before").alias("f"), F.bool_or("before").alias("had"), F.bool_or(~F.col("before")).alias("has")
    )
    change = F.when(F.col("had") & ~F.col("has"), "fixed").when(F.col("has") & ~F.col("had"), "new")
    return seen.select(
        *PAIR, change.alias("type"), "rule_id", F.col("f.title").alias("title"), F.col("f.severity").alias("severity")
    ).where(F.col("type").isNotNull())


def all_changes(sets: DataFrame, headers: DataFrame, scores: DataFrame, findings: DataFrame) -> DataFrame:
    """One long table of changes of every kind."""
    blank = F.lit(None).cast("string")
    score_text = F.concat(F.col("before").cast("string"), F.lit(" -> "), F.col("after").cast("string"))
    return (
        sets.select(*PAIR, "category", "type", "label", blank.alias("detail"))
        .unionByName(headers.select(*PAIR, "category", "type", "label", "detail"))
        .unionByName(scores.select(*PAIR, F.lit("scores").alias("category"), F.lit("delta").alias("type"), "label", score_text.alias("detail")))
        .unionByName(findings.select(*PAIR, F.lit("findings").alias("category"), "type", F.col("rule_id").alias("label"), F.col("title").alias("detail")))
    )


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*PAIR, "category").agg(F.count(F.lit(1)).alias("changes"))


def change_texts(scores: DataFrame, changes: DataFrame, most: int = 10) -> DataFrame:
    """A short text per pair: six score lines, then the first changes."""
    def whole(c: str) -> Column:
        return F.round(c).cast("int").cast("string")

    delta = F.col("delta")
    arrow = F.when(delta > 0, "improved").when(delta < 0, "worsened").otherwise("unchanged")
    line = F.concat(
        F.lit("  "), F.col("label"), F.lit(": "), whole("before"), F.lit(" -> "), whole("after"), F.lit(" ("), arrow,
        F.lit(" by "), F.round(F.abs(delta)).cast("int").cast("string"), F.lit(")."),
    )
    place = F.array_position(F.array(*[F.lit(d) for d in TEXT_DIMENSIONS]), F.col("label"))
    score_lines = scores.select(*PAIR, place.alias("place"), line.alias("line")).where(F.col("place") > 0).groupBy(*PAIR).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda r: r["line"]).alias("score_lines")
    )
    order = Window.partitionBy(*PAIR).orderBy("category", "type", "label")
    listed = (
        changes.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
        .groupBy(*PAIR).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("nth", "type", "category", "label"))),
                lambda r: F.concat(F.lit("  ["), r["type"], F.lit("] "), r["category"], F.lit(": "), r["label"]),
            ).alias("change_lines")
        )
    )
    none = F.array().cast("array<string>")
    return score_lines.join(listed, list(PAIR), "full_outer").select(
        *PAIR,
        F.array_join(
            F.concat(F.array(F.lit("Change summary (deterministic):")), F.coalesce("score_lines", none), F.coalesce("change_lines", none)),
            "\n",
        ).alias("explanation"),
    )


def change_history(comparisons: DataFrame) -> DataFrame:
    """Comparisons of every site, newest first."""
    return comparisons.orderBy("website_id", F.desc("created_at"))


FINDING_STATUSES = ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS", "FIXED", "VERIFIED", "DISMISSED")


def apply_status_updates(rows: DataFrame, updates: DataFrame, key: str, allowed: tuple[str, ...] | None = FINDING_STATUSES) -> DataFrame:
    """Rows with the latest valid status of an updates table (key, status, updated_at)."""
    valid = updates if allowed is None else updates.where(F.col("status").isin(*allowed))
    latest = valid.groupBy(key).agg(F.max_by("status", F.struct("updated_at", "status")).alias("new_status"))
    base = rows if "status" in rows.columns else rows.withColumn("status", F.lit("OPEN"))
    return base.join(latest, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def rejected_updates(updates: DataFrame) -> DataFrame:
    return updates.where(~F.coalesce(F.col("status").isin(*FINDING_STATUSES), F.lit(False)))
