"""What stage tables leave on disk beside themselves."""

import random

from pagequarry.llm import simhash
from pagequarry.session import FILE_CLEANUP, materialize


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = spark.range(0, 40_000, 1, 4).repartition(4, "id").groupBy("id").count()
    before, set_before = disk.getAllFiles().size(), spark.conf.get(FILE_CLEANUP, None)
    written = materialize(found, "counted")
    assert disk.getAllFiles().size() <= before
    assert written.count() == 40_000 and found.count() == 40_000 and spark.conf.get(FILE_CLEANUP, None) == set_before


def test_texts_are_compared_in_passes(spark, monkeypatch):
    """Many pairs of a few texts: several passes, the same groups as in one."""
    draw, rows = random.Random(3), []
    for group in range(3):
        words = [f"w{draw.randrange(9000)}" for _ in range(60)]
        for i in range(14):
            own = [*words[:-4], *[f"x{draw.randrange(10**6)}" for _ in range(4)]]
            rows.append((100 * group + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: written.append(label) or write(df, label))

    def groups():
        written.clear()
        got = {(r.doc_id, r.group_id) for r in simhash.near_copies(docs).collect()}
        return got, written.count("text-verified")

    several, passes = groups()
    monkeypatch.setattr(simhash, "MOST_PASSES", 1)
    once, one = groups()
    assert passes > one and several == once and {g for _, g in once} == {0, 100, 200}
