"""Clusters of similar pages and connected components against plain versions."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from pagequarry.operators import duplicates
from pagequarry.operators.components import connected_components

DOCS = "site string, doc bigint, body string"


def bag(body):
    words = re.findall(r"[a-z0-9]{3,}", body.lower())
    return Counter(" ".join(words[i:i + 6]) for i in range(len(words) - 5)) if len(words) >= 20 else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def plain_clusters(docs):
    bags = {(g, d): bag(t) for g, d, t in docs}
    bags = {k: v for k, v in bags.items() if v}
    links = [(x, y) for x, y in combinations(sorted(bags), 2) if x[0] == y[0] and jaccard(bags[x], bags[y]) >= 0.55]
    roots, out = roots_of(bags, links), {}
    sizes = Counter(roots.values())
    for x, root in roots.items():
        if sizes[root] > 1:
            first = min(y for y in bags if y[0] == x[0] and bags[y] == bags[x])
            score = jaccard(bags[root], bags[x])
            out[x] = (root[1], first[1], round(score, 9), score >= 0.55)
    return out


def got_clusters(spark, docs, **kwargs):
    rows = duplicates.similar_clusters(spark.createDataFrame(docs, DOCS), "site", "doc", "body", **kwargs).collect()
    found = {(r.site, r.doc): (r.cluster, r.representative, round(r.score, 9), r.similar) for r in rows}
    assert len(found) == len(rows)
    return found


def family(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}y"
    return " ".join(out)


@pytest.mark.parametrize("block", [2, 512])
def test_clusters_against_all_pairs(spark, block):
    """Chains whose ends are not similar, copies, texts that share common wording only, repeated shingles."""
    rng = random.Random(11)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(70)] for _ in range(4)]
    frame = [f"frame{i}" for i in range(30)]
    docs = []
    for i in range(90):
        base = bases[rng.randrange(4)]
        text = family(rng, base, rng.choice([0, 0, 1, 2, 3, 4]))
        if i % 3 == 0:
            text = " ".join(frame) + " " + text
        docs.append(("gh"[i % 2], i, text + (" " + text if i % 7 == 0 else "")))
    drift = list(bases[0])
    for i in range(100, 116):  # each like the one before, the last unlike the first
        drift[(i - 100) * 4:(i - 100) * 4 + 2] = [f"d{i}a", f"d{i}b"]
        docs.append(("g", i, " ".join(drift)))
    docs += [("g", 200, "too short"), ("h", 201, ""), ("h", 202, None)]
    docs = [(g, d, t) for g, d, t in docs]
    want = plain_clusters([(g, d, t or "") for g, d, t in docs])
    assert any(not v[3] for v in want.values()) and len({v[0] for v in want.values()}) > 3
    assert got_clusters(spark, docs, block=block) == want


def test_no_documents_give_no_clusters(spark):
    assert got_clusters(spark, [("s", 1, "nothing like it")]) == {}
    assert duplicates.similar_clusters(spark.createDataFrame([], DOCS), "site", "doc", "body").collect() == []


def test_a_mass_of_near_copies_is_linear(spark, monkeypatch):
    """20,000 texts of which any two are similar: a few pairs a text are verified, not 200 million."""
    seen = []
    scored = duplicates._scored

    def counting(pairs, *args):
        seen.append(pairs.count())
        return scored(pairs, *args)

    monkeypatch.setattr(duplicates, "_scored", counting)
    words = " ".join(f"term{i:02d}" for i in range(40))
    docs = spark.range(20_000).selectExpr("'s' as site", "id as doc", f"concat('{words} own', id, ' tail') as body")
    rows = duplicates.similar_clusters(docs, "site", "doc", "body")
    assert rows.where("cluster = 0 AND similar").count() == 20_000
    assert sum(seen) <= 60_000


def test_findings_name_the_first_page_of_a_cluster(spark):
    body = [f"term{i:03d}" for i in range(60)]
    texts = [" ".join([*body, f"own{i}"]) for i in range(80)] + ["other " * 5] + [" ".join(f"else{i}" for i in range(60))] * 2
    pages = spark.createDataFrame([("s", i, f"/{i}", t) for i, t in enumerate(texts)], "scan_id string, seq bigint, url string, text string")
    found = duplicates.similarity_findings(pages).collect()
    assert {(r.key1, r.key2) for r in found} == {(0, j) for j in range(1, 80)} | {(81, 82)}
    one = next(r for r in found if r.key2 == 82)
    assert one.affected_url == "/81" and one.confidence == 1.0 and one.evidence[0].value == "similarity_score=1.00 vs /82"
    assert len(duplicates.similarity_findings(pages, comparisons=60).collect()) == 5


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [("g", rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [("h", i, i + 1) for i in range(64)]
    links += [("g", 900, 900), ("g", None, 3), ("h", 1000, 3)] + [("k", 0, i) for i in range(1, 200)]
    rows = connected_components(spark.createDataFrame(links, "scan_id string, a bigint, b bigint")).collect()
    real = [((g, a), (g, b)) for g, a, b in links if a is not None and a != b]
    want = roots_of({x for pair in real for x in pair}, real)
    assert {(r.scan_id, r.node): (r.scan_id, r.root) for r in rows} == want and len(rows) == len(want)
