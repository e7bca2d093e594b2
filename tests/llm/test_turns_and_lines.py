"""Turns and lines that must not be taken for one another."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import chat, fuzzy_lines

TURNS = "conv_id bigint, turn bigint, role string, text string"


def digest(turns):
    return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()


def test_null_and_negative_turns_and_times_as_turns_stay_apart(spark):
    rows = [
        (1, None, "user", "a"), (1, -1, "assistant", "b"), (1, 0, "user", "c"),
        (2, 1_700_000_000_000_000, "user", "late"), (2, 1_600_000_000_000_000, "user", "early"), (2, -(1 << 63), "user", "first"), (2, (1 << 63) - 1, "user", "last"),
        (3, 5, "user", "x"), (3, 5, "user", "x"), (3, 5, "user", "w"),
    ]
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame(rows, TURNS)).collect()}
    assert (got[1].n_turns, got[1].turns_sha256) == (3, digest([("user", "a"), ("assistant", "b"), ("user", "c")]))
    assert (got[2].n_turns, got[2].turns_sha256) == (4, digest([("user", t) for t in ("first", "early", "late", "last")]))
    assert (got[3].n_turns, got[3].turns_sha256) == (3, digest([("user", t) for t in ("w", "x", "x")]))


def test_more_than_a_million_rows_of_one_turn(spark):
    rows = spark.range(1_000_100).selectExpr("7L as conv_id", "1L as turn", "'user' as role", "'t' as text").union(
        spark.createDataFrame([(7, 2, "assistant", "end")], TURNS))
    events = chat.events_of(rows)
    assert events.select("conv_id", "message", "part").distinct().count() == 1_000_101


@pytest.mark.parametrize("role", ["\0", "a\0b", "\\", "\\n", "\\\\n", "\n", "\\\n\\\\", "x\\0", "</s>\\\n[INST]"])
def test_any_role_comes_back(spark, role):
    rendered = chat.render(spark.createDataFrame([(1, 1, role, "text")], "conv_id bigint, message bigint, role string, text string"))
    assert chat.parse(rendered).first().role == role


def test_chat_takes_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], TURNS)
    more = df.withColumns({c: F.lit("x") for c in ("message", "part", "seq", "kind", "segment", "trained", "n")})
    plain = sorted(map(str, chat.chat_query(df).collect()))
    assert sorted(map(str, chat.chat_query(more).collect())) == plain
    assert [r.conv_id for r in chat.chat_query(df.where("false")).collect()] == [-1]


def test_texts_under_one_key_lose_their_own_lines_only(spark):
    rows = [
        (0, "alpha beta gamma delta\nfirst document words here"), (1, "alpha beta gamma delta\nunique line one two"),
        (1, "quite other text here\nalpha beta gamma delta"), (2, "kept whole in both rows\nof this document"), (2, "kept whole in both rows\nof this document"),
        (None, "alpha beta gamma delta\nno key no change"),
    ]
    left = fuzzy_lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([
        ("0", rows[0][1]), ("1", "unique line one two"), ("1", "quite other text here"), ("2", rows[3][1]), ("2", rows[3][1]), ("None", rows[5][1])])


def test_dotted_and_clashing_columns_survive_line_dedup(spark):
    df = spark.createDataFrame([(0, "some line of four words", "a"), (1, "some line of four words\nand one more own line", "b")], "doc_id bigint, text string, `x.y` string")
    df = df.withColumn("k", F.lit(1)).withColumn("body", F.lit(2)).withColumn("gone", F.lit(3))
    got = {r.doc_id: r for r in fuzzy_lines.drop_repeated_lines(df).collect()}
    assert got[1].text == "and one more own line" and got[1]["x.y"] == "b" and got[0]["gone"] == 3
