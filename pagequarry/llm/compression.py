"""Quality by compression: a text is good if a dictionary of good text shortens it more than one of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import bounded_labels, held_out, logistic, per_row

CHUNK = 2000
LEVEL = 3
DICTIONARY = 64 << 10
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two zstandard dictionaries and the logistic weights of (size difference, compressed share, 1)."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float] = (0.0, 0.0, 2.0)


def pieces(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    for start in range(0, len(text), size):
        yield text[start:start + size]


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[:size] or b"\n" * 16


class Sizer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.both = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in (model.good, model.bad)
        ]

    def features(self, text: bytes | None) -> tuple[float, float]:
        """(bad - good) / larger, and smaller / raw, over all pieces of the whole text; zeros without text."""
        good = bad = raw = 0
        for part in pieces(text or b""):
            good += len(self.both[0].compress(part))
            bad += len(self.both[1].compress(part))
            raw += len(part)
        return ((bad - good) / max(good, bad), min(good, bad) / raw) if raw else (0.0, 0.0)

    def score(self, x: tuple[float, float]) -> float:
        z = sum(a * b for a, b in zip(self.model.curve, [*x, 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000) -> Model:
    """Dictionaries from one half of a sample of labelled texts, the curve from the other half.

    Bound of the fit: ``per_class`` labelled ids of each class, drawn by the hash of the id. Rows with
    crc32(doc_id) mod 5 = 0 are never used. Each dictionary is trained in a task of its own. Without labels
    of both classes every text gets the same high score.
    """
    ids = bounded_labels(labels, label, ~held_out("doc_id", 5, 0), per_class)
    sample = (
        docs.select("doc_id", F.col("text").cast("string").alias("body")).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
        .select("label", "body", (F.xxhash64("doc_id", F.lit(11)) % 2 == 0).alias("for_dictionary"))
        .where("length(body) > 0")
    )

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t.encode("utf-8", "replace") for t in rows["body"])
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "dictionary": [dictionary(texts)]})

    trained = {
        r.label: bytes(r.dictionary)
        for r in sample.where("for_dictionary").groupBy("label").applyInPandas(train, "label int, dictionary binary").collect()
    }
    if len(trained) < 2:
        return Model(b"\n" * 16, b"\n" * 16)
    got = _measured(sample.where("not for_dictionary"), Model(trained[1], trained[0]), "body").select("label", "difference", "share").collect()
    if len({r.label for r in got}) < 2:
        return Model(trained[1], trained[0], (10.0, 0.0, 0.0))
    curve = logistic(np.array([(r.difference, r.share) for r in got]), np.array([r.label for r in got]), ridge=1e-5)
    return Model(trained[1], trained[0], tuple(round(float(v), 9) for v in curve))


def _measured(df: DataFrame, model: Model, body: str) -> DataFrame:
    kept: list[Sizer] = []

    def compute(columns: list[list]) -> list[list]:
        if not kept:
            kept.append(Sizer(model))
        rows = [kept[0].features(t) for t in columns[0]]
        return [[r[0] for r in rows], [r[1] for r in rows], [kept[0].score(r) for r in rows]]

    return per_row(df, [body], "difference double, share double, score double", compute)


def score(docs: DataFrame, model: Model, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, difference, share, score, predicted) of every row, from its whole text. Null and empty texts have a
    difference and a share of zero and get the score that the curve gives for them."""
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("body"))
    got = _measured(rows, model, "body")
    return got.select(F.col("id").alias(key), "difference", "share", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the measured sizes of every document."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "difference", "share")
