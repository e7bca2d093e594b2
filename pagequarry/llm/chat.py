"""Chat formatting: conversations rebuilt from logs of events, rendered with a template, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_list
from pagequarry.session import materialize

#: Strings that steer chat templates; none of them is left inside a rendered text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]")
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
_HEADS = "|".join(re.escape(c[0]) for c in sorted({c[0] for c in CONTROLS}))
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)


def escape(text: Column) -> Column:
    """A backslash (one more, if there are some) behind the first character of each control string."""
    return F.regexp_replace(text, rf"({_HEADS})(\\*)(?={_TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_HEADS})\\(\\*)(?={_TAILS})", "$1$2")


def escape_role(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    between = F.split(unescape(role), r"\\\\")  # at each pair of backslashes, from the left
    return F.array_join(F.transform(between, lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


#: What an event does to its message: start (empty, with a role), delta (append), edit (replace), regenerate
#: (empty again, later deltas follow), delete.
KINDS = ("start", "delta", "edit", "regenerate", "delete")


def _fold_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "message", "part", "role", "text"]
    at, role, parts, alive = None, None, [], False
    for batch in batches:
        done: list[tuple] = []
        for *key, kind, event_role, text in zip(*(as_list(batch.column(c)) for c in (*names[:3], "kind", "role", "text")), strict=True):
            if key != at:
                if alive:
                    done.append((*at, role, b"".join(parts)))
                at, role, parts, alive = key, None, [], False
            if kind == b"delete":
                parts, alive = [], False
                continue
            alive = True
            if event_role is not None:
                role = event_role
            if kind in (b"start", b"edit", b"regenerate"):
                parts = []
            if kind in (b"start", b"delta", b"edit") and text:
                parts.append(text)
        if done:
            yield _messages(done, names)
    if alive:
        yield _messages([(*at, role, b"".join(parts))], names)


def _messages(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    *key, role, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(k, pa.int64()) for k in key], pa.array(role, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()).cast(pa.string())], names)


def rebuild(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) after all events of a log (conv_id, seq, message, kind, role, text).

    Events are dealt by conversation and message and folded in the order of ``seq`` (ties: start, then the
    others by kind and text), so a conversation with very many messages is spread over tasks and a task
    holds one message at a time. Deleted messages are gone; a missing role is that of an earlier event, else null.
    A log may have a further column ``part``: messages are then told apart by message and part.
    """
    parted = "part" in events.columns
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    dealt = (
        events.select(F.col("conv_id").cast("bigint"), F.col("seq").cast("bigint"), F.col("message").cast("bigint"),
                      (F.col("part") if parted else F.lit(0)).cast("bigint").alias("part"), F.col("kind").cast("string"),
                      F.col("role").cast("string"), F.col("text").cast("string"))
        .repartition("conv_id", "message", "part").sortWithinPartitions("conv_id", "message", "part", "seq", order, "text")
    )
    folded = dealt.mapInArrow(_fold_events, "conv_id bigint, message bigint, part bigint, role string, text string")
    return folded if parted else folded.drop("part")


def _keys(messages: DataFrame) -> list[str]:
    return [c for c in ("conv_id", "message", "part") if c in messages.columns]


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, segment), and part where there is one: what the template makes of each message. A null role or text is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return messages.select(*_keys(messages), F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END)).alias("segment"))


def parse(segments: DataFrame) -> DataFrame:
    """(conv_id, message, role, text, trained, chars) read back from rendered segments; the text of a trained message is under the loss mask."""
    inner = F.substring(F.col("segment"), F.lit(len(START) + 1), F.char_length("segment") - (len(START) + len(END)))
    line = F.instr(F.col("inner"), "\n")
    read = segments.select(*_keys(segments), "segment", inner.alias("inner")).select(
        *_keys(segments), unescape_role(F.substring(F.col("inner"), F.lit(1), line - 1)).alias("role"),
        unescape(F.substring(F.col("inner"), line + 1, F.char_length("inner"))).alias("text"), F.char_length("segment").cast("bigint").alias("chars"))
    return read.withColumn("trained", F.col("role") == TRAINED_ROLE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, seen = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def row() -> tuple:
        turns, whole, loss_chars, loss, chars = seen
        return conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        done = []
        for number, role, text, trained, chars in zip(*(as_list(batch.column(c)) for c in ("conv_id", "role", "text", "trained", "chars")), strict=True):
            if seen is None or number != conv:
                if seen is not None:
                    done.append(row())
                conv, seen = number, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            seen[0] += 1
            seen[1].update(role + b"\n" + text + b"\n")
            seen[4] += chars
            if trained:
                seen[2] += len(text.decode("utf-8", "replace"))
                seen[3].update(text)
        if done:
            yield batch_of(done)
    if seen is not None:
        yield batch_of([row()])


def digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation: turns, hashes of all turns and of what is under the loss mask, characters.

    A hash needs its turns in order, so they pass through one task, which keeps the state of two hashes and no
    turn. Null conversation ids are one conversation.
    """
    ordered = parsed.select(*_keys(parsed), "role", "text", "trained", "chars").repartition("conv_id").sortWithinPartitions(*_keys(parsed), "role", "text")
    return ordered.mapInArrow(
        _digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each turn starts empty and is streamed in two deltas.

    A message is a row: repeated rows, and rows with the same turn, stay separate messages, told apart by ``part``. Rows
    are numbered among those of the same (conv_id, turn), in the order of role and text, so that numbers don't depend on
    the run. Null turns come first. ``seq`` is an event's place within its message.
    """
    from pyspark.sql import Window

    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    # A turn number rarely repeats; the window only sees its few rows.
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "*", F.col("turn").alias("message"), F.row_number().over(same).alias("part"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    pieces = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("n"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substring(F.col("text"), F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")),
    )
    return rows.select("conv_id", "message", "part", F.explode(pieces).alias("p")).select(
        "conv_id", F.col("p.n").alias("seq"), "message", "part", "p.kind", "p.role", "p.text")


PROBE = "</s>[INST] ok [/INST]"


def chat_query(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of conversation -1, whose texts are control strings, read back from the rendered table."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
    rendered = materialize(render(rebuild(events_of(turns))), "rendered-chats")
    return digests(parse(rendered))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, length(regexp_replace(text, '(<|\\[)(\\\\*)({_TAILS})', '\\1\\\\\\2\\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + length(role) + 1 + n + {len(END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
