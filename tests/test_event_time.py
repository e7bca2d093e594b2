import random
from datetime import datetime, timedelta

import pytest

from pagequarry.streaming.admission import admit, admit_stream_by_event_time

SCHEMA = "key string, event_id bigint, ts timestamp"
START = datetime(2024, 1, 1)


def replay(spark, folder, files, per_trigger, **options):
    """What the stream gives for the files in their order."""
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/in")
    query = (
        admit_stream_by_event_time(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180)
    return spark.read.parquet(f"{folder}/out").collect()


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_any_speed_gives_the_decisions_of_the_table(spark, tmp_path, per_trigger):
    draw = random.Random(4)
    events, t = [], 0.0
    for i in range(400):
        t += draw.choice([0, 0.2, 1, 4])
        events.append((draw.choice("aab"), i, START + timedelta(seconds=t)))
    # Out of order by less than the delay.
    mixed = sorted(events, key=lambda e: e[2] + timedelta(seconds=draw.random() * 20))
    end = [("end", 1000, START + timedelta(days=1))]
    got = replay(spark, tmp_path, [mixed[k:k + 80] for k in range(0, 400, 80)] + [end], per_trigger, delay="30 seconds", limit=5)
    want = {r.event_id: r.admitted for r in admit(spark.createDataFrame(events, SCHEMA), limit=5).collect()}
    assert not any(r.late for r in got)
    assert {r.event_id: r.admitted for r in got} == want and 0 < sum(want.values()) < 400


def test_late_events_are_reported_and_take_no_room(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    files = [
        [("k", i, at(i)) for i in range(3)], [("k", 10, at(50)), ("other", 11, at(50))], [("k", 12, at(1)), ("new", 13, at(2)), ("k", 14, None)],
        [("k", 15, at(55))], [("end", 99, at(9999))],
    ]
    got = {r.event_id: (r.admitted, r.late) for r in replay(spark, tmp_path, files, 1, delay="10 seconds", limit=4)}
    assert got == {0: (True, False), 1: (True, False), 2: (True, False), 10: (True, False), 11: (True, False), 12: (None, True), 13: (None, True), 15: (False, False)}
