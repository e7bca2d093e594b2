from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagequarry.operators import extract
from pagequarry.streaming.admission import admit_stream
from pagequarry.streaming.ingest import profile_stream, start_profile_sink

SCHEMA = "scan_id string, seq bigint, url string, html string, fetched_at timestamp"


def test_profiles_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("s", i, f"https://s.example/{i}", f"<h1>{i}</h1><a href=/x>x</a>", start + timedelta(seconds=i)) for i in range(20)]
    spark.createDataFrame(rows + rows[:5], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = start_profile_sink(profile_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    batch = extract.page_profiles(extract.page_rows(spark.createDataFrame(rows, SCHEMA)))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    columns = ["seq", "url", "title", "text", "h1_count", "word_count"]
    assert sorted(streamed.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_admission_keeps_state_between_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    schema = "key string, event_id bigint, ts timestamp"
    for batch in range(2):
        rows = [("k", batch * 8 + i, start + timedelta(seconds=batch * 8 + i)) for i in range(8)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        admit_stream(stream, limit=10).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 16 and out.where(F.col("admitted")).count() == 10
