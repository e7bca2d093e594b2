"""Page ingestion as a stream: the row-level stages unchanged, results per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators.extract import page_profiles, page_rows


def profile_stream(raw: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Profiles of a stream of raw pages, repeats of a page within the watermark dropped.

    ``raw`` also has ``fetched_at``; the state kept for it is one key per page.
    """
    deduped = raw.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["scan_id", "url"])
    return page_profiles(page_rows(deduped))


def start_profile_sink(profiles: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append profiles to a parquet folder; the batch rules read that folder."""
    writer = profiles.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
