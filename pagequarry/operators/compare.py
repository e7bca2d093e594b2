"""Comparing sites: latest scans, competitor resolution, score gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.urls import bare_host
from pagequarry.operators.diff import unpivot_scores
from pagequarry.operators.scoring import CATEGORIES


def latest_scans(scans: DataFrame, *statuses: str) -> DataFrame:
    """The newest scan of each website among the given statuses; an aggregate, not a sort."""
    newest = F.max_by(F.struct("scan_id", "started_at", "status"), F.struct("started_at", "scan_id"))
    return (
        scans.where(F.col("status").isin(*statuses)).groupBy("website_id").agg(newest.alias("s"))
        .select("website_id", "s.scan_id", "s.started_at", "s.status")
    )


def latest_completed(scans: DataFrame) -> DataFrame:
    return latest_scans(scans, "COMPLETED")


def latest_finished(scans: DataFrame) -> DataFrame:
    return latest_scans(scans, "COMPLETED", "FAILED")


def resolve_competitors(competitors: DataFrame, websites: DataFrame, scans: DataFrame) -> DataFrame:
    """The scan standing for each competitor: the owner's website of the same URL first, then of the same host.

    ``competitors`` has competitor_id, website_id, normalized_url; matching is done
    among the websites of the user who owns ``website_id``.
    """
    owned = websites.select("user_id", "website_id", F.col("normalized_url").alias("site_url"), "created_at").join(
        latest_completed(scans).select("website_id", F.col("scan_id").alias("site_scan")), "website_id"
    )
    asked = competitors.join(websites.select("website_id", "user_id"), "website_id").select(
        "competitor_id", "website_id", "user_id", "normalized_url", bare_host(F.col("normalized_url")).alias("host")
    )
    # Newest website first, as the listing orders them.
    pick = F.min_by("site_scan", F.struct((-F.unix_micros("created_at")).alias("t"), "site_id"))
    exact = (
        asked.join(
            owned.select("user_id", F.col("site_url").alias("normalized_url"), "site_scan", "created_at", F.col("website_id").alias("site_id")),
            ["user_id", "normalized_url"],
        ).groupBy("competitor_id").agg(pick.alias("exact_scan"))
    )
    by_host = (
        asked.where(F.col("host") != "").join(
            owned.select("user_id", bare_host(F.col("site_url")).alias("host"), "site_scan", "created_at", F.col("website_id").alias("site_id")),
            ["user_id", "host"],
        ).groupBy("competitor_id").agg(pick.alias("host_scan"))
    )
    return (
        asked.join(exact, "competitor_id", "left").join(by_host, "competitor_id", "left")
        .select(
            "competitor_id", "website_id", F.coalesce("exact_scan", "host_scan").alias("scan_id"),
            F.when(F.col("exact_scan").isNotNull(), "exact").when(F.col("host_scan").isNotNull(), "host").alias("matched_by"),
        )
    )


def score_gaps(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per dimension both scans measured: own score, the other's, the gap and a sentence.

    ``pairs`` has pair_id, self_scan_id, other_scan_id.
    """
    rows = unpivot_scores(scores).where(F.col("label").isin(*CATEGORIES))
    mine = rows.select(F.col("scan_id").alias("self_scan_id"), F.col("label").alias("dimension"), F.col("score").alias("you"))
    theirs = rows.select(F.col("scan_id").alias("other_scan_id"), F.col("label").alias("dimension"), F.col("score").alias("competitor"))
    joined = pairs.join(mine, "self_scan_id").join(theirs, ["other_scan_id", "dimension"])
    gap = (F.col("you").cast("decimal(5,1)") - F.col("competitor").cast("decimal(5,1)")).cast("double")
    whole = F.round(F.abs(F.col("gap"))).cast("int").cast("string")
    sentence = (
        F.when(F.col("gap") < 0, F.concat("dimension", F.lit(" is "), whole, F.lit(" points behind the competitor.")))
        .when(F.col("gap") > 0, F.concat("dimension", F.lit(" is "), whole, F.lit(" points ahead of the competitor.")))
        .otherwise(F.concat("dimension", F.lit(" is level with the competitor.")))
    )
    return joined.withColumn("gap", gap).select("pair_id", "dimension", "you", "competitor", "gap", sentence.alias("explanation"))


def gap_summaries(pairs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per pair: where it is behind and ahead, and what to improve first."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("dimension"))

    def names(condition: Column) -> Column:
        listed = F.sort_array(F.collect_list(F.when(condition, F.struct(place.alias("p"), "dimension"))))
        return F.coalesce(F.nullif(F.array_join(F.transform(listed, lambda r: r["dimension"]), ", "), F.lit("")), F.lit("nothing"))

    grouped = gaps.groupBy("pair_id").agg(
        names(F.col("gap") < -1).alias("behind"), names(F.col("gap") > 1).alias("ahead"),
        F.min_by(F.struct("dimension", "gap"), F.struct("gap", place.alias("p"))).alias("first"),
    )
    first = F.concat(
        F.lit("Improve "), F.col("first.dimension"), F.lit(" first (gap "),
        F.round("first.gap").cast("int").cast("string"), F.lit(" points)."),
    )
    return pairs.select("pair_id").join(grouped, "pair_id", "left").select(
        "pair_id", F.coalesce("behind", F.lit("nothing")).alias("behind"), F.coalesce("ahead", F.lit("nothing")).alias("ahead"),
        F.coalesce(first, F.lit("Insufficient measured data to compare.")).alias("summary"),
    )


def compared_sites(requests: DataFrame, websites: DataFrame, scans: DataFrame, scores: DataFrame, resolved: DataFrame) -> DataFrame:
    """The sites of each comparison with their scores in long form.

    ``requests`` has comparison_id, website_id and either competitor_id or
    other_website_id. A site compared with itself and websites of other users are
    refused (no row).
    """
    owner = websites.select("website_id", "user_id")
    own = requests.select("comparison_id", "website_id").distinct().join(latest_completed(scans), "website_id", "left").select(
        "comparison_id", F.lit("you").alias("key"), "scan_id"
    )
    rivals = requests.where(F.col("competitor_id").isNotNull()).join(
        resolved.select("competitor_id", "website_id", "scan_id"), ["competitor_id", "website_id"]
    ).select("comparison_id", F.concat(F.lit("competitor_"), "competitor_id").alias("key"), "scan_id")
    others = (
        requests.where(F.col("other_website_id").isNotNull() & (F.col("other_website_id") != F.col("website_id")))
        .join(owner, "website_id")
        .join(owner.select(F.col("website_id").alias("other_website_id"), F.col("user_id").alias("other_user")), "other_website_id")
        .where(F.col("user_id") == F.col("other_user"))
        .join(latest_completed(scans).select(F.col("website_id").alias("other_website_id"), "scan_id"), "other_website_id", "left")
        .select("comparison_id", F.concat(F.lit("website_"), "other_website_id").alias("key"), "scan_id")
    )
    sites = own.unionByName(rivals).unionByName(others)
    return sites.join(unpivot_scores(scores), "scan_id", "left").select("comparison_id", "key", "scan_id", F.col("label").alias("dimension"), "score")
