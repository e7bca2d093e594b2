"""Spaced seeds against counting: the masks cover every placement of substitutions, and the query equals a plain search."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagequarry.llm import common, decontaminate

FOLDER = "/root/testdata/sf0.001"


def fewest_substitutions(n: int) -> int:
    """The fewest words of ``n`` to change so that no mask fits anywhere, by a run over all states of the last places."""
    span = max(m[-1] for m in decontaminate.MASKS) + 1
    seen = (1 << (span - 1)) - 1
    masks = [sum(1 << (m[-1] - p) for p in m) for m in decontaminate.MASKS]
    cost = {seen: 0}
    for _ in range(n):
        after = {}
        for state, c in cost.items():
            for changed in (0, 1):
                window = state << 1 | changed
                if all(window & m for m in masks):
                    after[window & seen] = min(after.get(window & seen, n), c + changed)
        cost = after
    return min(cost.values())


def test_masks_fit_wherever_a_quarter_is_substituted():
    # Longer items are made of parts of 12 to 23 words, one of which has no more than its quarter.
    assert all(fewest_substitutions(n) > n // 4 for n in range(decontaminate.LEAST_WORDS, 80))


def plain(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple]:
    """Every item at every offset with four equal words or more (fewer can't be three quarters of five)."""
    out = set()
    worded = [(i, decontaminate.words_of(t.encode())) for i, t in items]
    for doc, text in docs:
        words = decontaminate.words_of((text or "").encode())
        places = defaultdict(list)
        for p, w in enumerate(words.tolist()):
            places[w].append(p)
        for item, own in worded:
            if len(own) < decontaminate.LEAST_WORDS:
                continue
            offsets = Counter(p - q for q, w in enumerate(own.tolist()) for p in places.get(w, ()))
            found = [decontaminate.overlap(words[max(0, o):], own, o) for o, c in offsets.items() if c >= 4]
            best = max(((e, -f, -n) for f, n, e in filter(None, found)), default=None)
            if best:
                out.add((doc, item, -best[1], -best[2], best[0]))
    return out


def near_misses(texts: list[str]) -> tuple[list, list]:
    """Items out of the texts themselves, laid into other texts with a growing share of substituted words."""
    draw = random.Random(5)
    items, docs = [], []
    for k, text in enumerate(texts):
        words = (text or "").split()
        n = draw.randrange(5, 60)
        if len(words) < n + 5:
            continue
        at = draw.randrange(len(words) - n)
        items.append((k, " ".join(words[at:at + n])))
        for share in (0.0, 0.15, 0.25, 0.3, 0.5):
            edited = [w if draw.random() >= share else f"x{draw.randrange(99)}" for w in words[at:at + n]]
            cut = edited[draw.randrange(1 + n // 3):]
            docs.append((len(docs), " ".join([*words[-9:], *cut, *texts[k - 1].split()[:20]])))
    return docs, items


@pytest.mark.parametrize("planted", [False, True])
def test_query_equals_a_plain_search(spark, planted):
    docs = [(r.doc_id, r.text) for r in common.table(spark, FOLDER, "documents").collect()]
    items = [(r.item_id, r.text or "") for r in common.table(spark, FOLDER, "benchmark").collect()]
    if planted:
        docs, items = near_misses([t or "" for _, t in docs])
        assert len(items) > 100
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = {tuple(r) for r in got.select("doc_id", "item_id", "first_word", "n_words", "n_equal").collect()}
    assert rows == plain(docs, items) and rows


def test_a_full_filter_only_sends_more_seeds(spark, monkeypatch):
    docs, items = near_misses([r.text or "" for r in common.table(spark, FOLDER, "documents").limit(60).collect()])
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    first = sorted(map(str, decontaminate.contamination(*frames).collect()))
    monkeypatch.setattr(decontaminate, "_filter", lambda dealt: np.full(decontaminate.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(map(str, decontaminate.contamination(*frames).collect())) == first
