"""Merkle manifest, byte-level BPE and ranked search: awkward rows, and against plain versions on whole small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagequarry.llm import byte_pairs, merkle, queries, ranked_search
from testkit.check import compare, connect
from tests.llm.test_operators_llm import DOCS, FOLDER, LONG, odd

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_multi_50k.tiktoken")
ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(*byte_pairs._shipped(VOCABULARY))


@pytest.fixture(scope="module")
def other():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_ranked_search"])
def test_agrees_with_its_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], connect(FOLDER)) == ""


# --- Merkle ---

def plain_manifest(rows):
    """Rows of the query by the plainest way: lists of levels."""
    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            a = i - i % 8
            yield level[a:i], level[i + 1:a + 8]
            i //= 8

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(map(field, (doc_id, source, lang, n_chars, text)))
        shown = leaf
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            shown = h(map(field, (doc_id, source, lang, n_chars, re.sub("[A-Z]", lambda m: m[0].lower(), text))))
        trees.setdefault((lang is not None, (lang or "").encode()), []).append((doc_id is not None, doc_id or 0, leaf, shown, doc_id))
    groups = sorted(trees)
    built = {}
    for g in groups:
        trees[g].sort(key=lambda x: x[:3])
        built[g] = tree([x[2] for x in trees[g]])
    top = tree([built[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, (*_, leaf, shown, doc_id) in enumerate(trees[g]):
            path, at = [*way(built[g], i), *way(top, k)], shown
            for left, right in path:
                at = h([*left, at, *right])
            proof = h(x for pair in path for side in pair for x in side)
            out.append((doc_id, leaf, built[g][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return out


def key(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("built", [1, 2, 4])
def test_manifest_is_the_plain_one_whatever_a_builder_takes(spark, documents, monkeypatch, built):
    monkeypatch.setattr(merkle, "BUILT", built)
    monkeypatch.setattr(merkle, "STRETCH", 8**built)
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    # eleven more languages, so that the tree over the groups has two levels
    rows += [(10_000 + i, f"Text {i}", f"l{i % 11}", None, i) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    assert key(merkle.merkle_query(df).collect()) == key(plain_manifest(rows))


def test_manifest_of_odd_rows(spark):
    rows = [tuple(r) for r in odd(spark).collect()]
    want = key(plain_manifest(rows))
    assert key(merkle.merkle_query(odd(spark)).collect()) == want
    assert key(merkle.merkle_query(odd(spark, extra=True).withColumn("g", F.lit(1))).collect()) == want
    assert merkle.merkle_query(odd(spark).where("false")).collect() == []
    alone = merkle.merkle_query(odd(spark).where("doc_id = 6")).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_positions_are_the_places_of_nodes_in_the_order_of_completion():
    for width in [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 513, 4095, 4096]:
        height = merkle.height_of(width)
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(width)]
        log, nodes, seen = merkle.completed(leaves, height), leaves, []
        for level in range(height + 1):
            at = merkle.position(level, np.arange(len(nodes)), width, height).tolist()
            assert [log[32 * p:32 * p + 32] for p in at] == nodes
            seen += at
            nodes = [merkle.node_digest(nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        assert sorted(seen) == list(range(len(log) // 32))


def test_log_of_many_rounds_is_one_append_log(spark, documents, monkeypatch):
    monkeypatch.setattr(merkle, "BUILT", 1)
    monkeypatch.setattr(merkle, "STRETCH", 8)
    nodes = merkle.log_nodes(merkle.manifest(documents).trees).collect()
    for g in {n.g for n in nodes}:
        own = sorted((n for n in nodes if n.g == g), key=lambda n: n.position)
        assert [n.position for n in own] == list(range(len(own)))
        leaves = [bytes(n.digest) for n in own if n.level == 0]
        assert b"".join(bytes(n.digest) for n in own) == merkle.completed(leaves, merkle.height_of(len(leaves)))


# --- Byte-level BPE ---

def test_every_code_point_has_the_class_of_the_library():
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {x + bytes([i]): 256 * (k + 1) + i for k, x in enumerate((b"a", b"1", b"!")) for i in range(256)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    classes = byte_pairs.class_table()
    letters, numbers, symbols = byte_pairs.LETTER, byte_pairs.NUMBER, (byte_pairs.OTHER, byte_pairs.QUOTE)
    for c in (*range(0x30000), *range(0xE0000, 0xE1000), *range(0x10FF00, 0x110000)):
        if not 0xD800 <= c < 0xE000:
            joins = [other.encode_ordinary(x + chr(c))[0] >= 256 for x in "a1!"]
            assert joins == [classes[c] == letters, classes[c] == numbers, classes[c] in symbols], hex(c)


ALPHABET = ["'", "'s", "'re", "'ll", "'v", "re", " ", "  ", "\n", "\t", "a", "s", "t", "B", "é", "中", "1", "²", "!", "’", " ", "👍", "Ᲊ", "\U00010d40", "\x1c", "l", "e", "v", "m", "\r\n", "́", "\0"]


def test_ids_are_those_of_the_library(codec, other):
    draw = random.Random(5)
    for _ in range(150):
        texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(14))) for _ in range(100)]
        ids, offsets, places = codec.encode([t.encode() for t in texts])
        for t, a, b in zip(texts, places[:-1], places[1:], strict=True):
            assert ids[a:b].tolist() == other.encode_ordinary(t), repr(t)
            assert codec.decode(ids[a:b]) == t.encode()
            lengths = np.diff(np.append(offsets[a:b], len(t.encode())))
            assert [codec.decode([i]) for i in ids[a:b]] == [t.encode()[o:o + n] for o, n in zip(offsets[a:b], lengths, strict=True)]


def test_long_runs_and_scans_of_many_rounds(codec, other):
    for text in ("'s" * 3000 + "x", "'re'll" * 500, "a" * 20_000, " " * 5000 + "x", "!" * 5000, "\n" * 4000, "ab" * 6000, LONG):
        ids, _, _ = codec.encode([text.encode()])
        assert ids.tolist() == other.encode_ordinary(text)


def test_words_are_forgotten_without_a_trace(codec, other, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED_WORDS", 3)
    for text in ("one two three four", "five six seven one", "one two"):
        assert codec.encode([text.encode()])[0].tolist() == other.encode_ordinary(text)


def test_a_span_is_decoded_from_its_own_tokens(codec):
    text = "Offsets say where: l'été à Zürich, 1234 ünïcödé words.".encode()
    ids, offsets, _ = codec.encode([text])
    for a in range(len(text)):
        for b in range(a, len(text) + 1):
            assert codec.decode_span(ids, offsets, a, b) == text[a:b]


def test_bytes_that_are_no_text_come_back(codec):
    odd_bytes = [b"\xff\xfe abc", b"", b"a\xc3", "\ud800".encode("utf-8", "surrogatepass"), b"caf\xc3\xa9 \x80\x80"]
    ids, _, places = codec.encode(odd_bytes)
    assert [codec.decode(ids[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)] == odd_bytes


def test_tokens_of_whole_tables(spark, documents, other):
    def plain(rows):
        out = []
        for r in rows:
            ids = other.encode_ordinary(r.text or "")
            joined = ",".join(map(str, ids)).encode()
            out.append((r.doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        return key(out)

    for df in (documents, odd(spark), odd(spark, extra=True).withColumn("ids", F.lit(1))):
        assert key(byte_pairs.tokens_query(df, VOCABULARY).collect()) == plain(df.collect())
    assert byte_pairs.tokens_query(documents.where("false"), VOCABULARY).collect() == []


def test_encoded_texts_are_decoded_again(spark, other):
    df = byte_pairs.encoded(odd(spark, extra=True), VOCABULARY)
    rows = byte_pairs.decoded(df, VOCABULARY).collect()
    assert set(odd(spark, extra=True).columns) < set(df.columns)
    for r in rows:
        assert r.ids == other.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
        assert len(r.offsets) == len(r.ids)


# --- Ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best=50):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        wanted, scored = set(terms(text)), []
        for doc_id, c in counted:
            n, score = sum(c.values()), 0
            for t in wanted & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:best])]
    return out


def test_search_of_awkward_rows(spark):
    rows = [tuple(r)[:2] for r in odd(spark).collect()]
    items = [(1, "the quick BROWN fox"), (1, "the quick BROWN fox"), (1, "one two"), (2, None), (3, ""), (None, "words in a line"), (4, "nowhere"), (5, LONG), (6, "?!")]
    df = spark.createDataFrame(items, ITEMS)
    want = key(plain_search(rows, items))
    assert key(ranked_search.search_query(odd(spark), df).collect()) == want
    more = odd(spark, extra=True).withColumn("term", F.lit("x"))
    assert key(ranked_search.search_query(more, df.withColumn("terms", F.lit("x")).withColumn("name", F.lit(1))).collect()) == want
    assert ranked_search.search_query(odd(spark).where("false"), df).collect() == []
    assert ranked_search.search_query(odd(spark), df.where("false")).collect() == []


@pytest.mark.parametrize("shard", [7, 100_000])
def test_search_prunes_without_loss(spark, monkeypatch, shard):
    """Many small scores, ties, frequent terms and lists of many blocks."""
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    monkeypatch.setattr(ranked_search, "FIRST_SPAN", 16)
    monkeypatch.setattr(ranked_search, "PASS_TERMS", 30)
    draw = random.Random(3)
    words = [f"w{int(40 * draw.random() ** 3)}" for _ in range(6000)]
    rows, at = [], 0
    while at < len(words):
        n = draw.choice([1, 2, 3, 5, 8, 30])
        rows.append((draw.randrange(300), " ".join(words[at:at + n])))
        at += n
    items = [(i, " ".join(f"w{draw.randrange(42)}" for _ in range(draw.choice([1, 2, 4, 12])))) for i in range(25)]
    got = ranked_search.ranked(ranked_search.index(spark.createDataFrame(rows, ITEMS).toDF("doc_id", "text")), spark.createDataFrame(items, ITEMS), 20)
    assert key(got.collect()) == key(plain_search(rows, items, 20))


def test_blocks_of_non_essential_lists_stay_closed():
    """A rare term decides: the frequent term's blocks without a candidate are never decompressed."""
    texts = [b"common " * (1 + i % 3) + (b"rare rare rare" if i % 400 == 5 else b"") for i in range(8000)]
    (own, *rows) = [r for batch in ranked_search.shard_rows(0, list(range(8000)), texts) for r in batch.to_pylist()]
    m = ranked_search.middles(np.frombuffer(own["lengths"], "<i8"), 8000, own["words"])

    def lists():
        return [ranked_search.TermList(r | {"w": 9000 if r["term"] == b"rare" else 3}, 8000, own["words"]) for r in rows]

    every = np.arange(8000)
    scores = sum(x.of(every, m) for x in lists())
    searched = lists()
    found = ranked_search.search(searched, m, 5)
    assert sorted(found, key=lambda x: (-x[0], x[1])) == [(s, -d) for s, d in sorted(((int(s), -d) for d, s in enumerate(scores)), reverse=True)[:5]]
    common = max(searched, key=lambda x: len(x.lasts))
    assert len(common.lasts) > 60 and len(common.opened) < 30
