"""Each operator on awkward rows, and against a plain version on small data."""

import hashlib
import random
import re

import pytest
import xxhash

import corpus_pipeline
from pagequarry.llm import (
    chat, common, compression, decontaminate, fuzzy_lines, licences, mixing, quality_rules, queries, simhash, toxicity, warc,
)
from testkit.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen green turtles watch from a distant hill near the old mill"


def odd(spark, extra=False):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties."""
    rows = [
        (1, PASSAGE, "en", "b", 9), (1, PASSAGE, "en", "b", 9), (2, PASSAGE, None, None, None), (3, None, None, "a", None), (4, "", "en", "a", 0),
        (5, " \n\t\n", "en", "a", 4), (6, LONG, "en", "a", 1), (None, "no id here but some words in a line", None, "c", None), (None, None, None, None, None),
        (7, "one", "en", "b", 3), (8, "one\none\n\none two three", "en", "b", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("body", "fp", "key", "size", "score", "row", "h", "id", "taken", "gone", "bucket", "label", "found", "t1"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 0, 1), (6, None, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(0, "nothing of this kind stands in any of the texts here at all today"), (1, None), (2, ""), (None, PASSAGE), (3, "too short")], "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity_query(d, labelled(s)),
    "mixing": lambda s, d: mixing.mix_documents(d),
    "rules": lambda s, d: quality_rules.rules_query(d),
    "simhash": lambda s, d: simhash.simhash_query(d),
    "decontamination": lambda s, d: decontaminate.contamination(d, bench(s)),
    "quality": lambda s, d: compression.quality_query(d, labelled(s)),
    "licences": lambda s, d: licences.scan(d),
    "lines": lambda s, d: fuzzy_lines.lines_query(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_extra_columns_and_empty_tables(spark, name):
    plain = sorted(map(str, OPERATORS[name](spark, odd(spark)).collect()))
    assert plain == sorted(map(str, OPERATORS[name](spark, odd(spark, extra=True)).collect()))
    if name not in ("decontamination", "lines"):
        assert len(plain) == 11
    assert OPERATORS[name](spark, odd(spark).where("false")).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_keep_columns(spark, stage, tmp_path):
    labelled(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (odd(spark), odd(spark, extra=True)):
        got = run(spark, docs, str(tmp_path))
        if stage != "mixing":
            assert got.columns == docs.columns
        assert got.count() <= 11
        assert run(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_near_dedup_keeps_one_of_each_group(spark):
    words = PASSAGE.split() * 3 + [f"tail{i}" for i in range(60)]
    near = [w if i != 40 else "changed" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(words)), (9, " ".join(near)), (2, LONG), (2, LONG), (7, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id for r in simhash.drop_near_copies(docs).collect())) == [2, 3, 7]


def test_near_copies_are_those_of_all_pairs(spark):
    draw = random.Random(11)
    texts = []
    for k in range(40):
        words = [f"n{draw.randrange(4000)}" for _ in range(draw.randrange(60, 200))]
        n = len(words)
        added = [f"m{draw.randrange(4000)}" for _ in range((10 + k % 16) * n // 100)]
        texts += [words, words + added, words[:(78 + k % 14) * n // 100], [w if draw.random() > 0.02 else "other" for w in words]]
    texts += [texts[0][:3], [*texts[0][:3], "more"], texts[0][:3]]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    group = list(range(len(sets)))
    links = [(i, j) for j in group for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(4):
        for i, j in links + links[::-1]:
            group[i] = group[j] = min(group[i], group[j])
    kept = [k for k, g in enumerate(group) if k == g]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(links) > 80
    for small in (32, 2):
        assert sorted(r.doc_id for r in simhash.drop_near_copies(df, small=small).collect()) == kept


def test_edited_items_are_found_at_every_length(spark):
    draw = random.Random(2)
    items, docs = [], []
    for k in range(240):
        n = 5 + k % 40
        words = [f"q{draw.randrange(10**9)}" for _ in range(n)]
        items.append((k, " ".join(words)))
        for edits in {n // 4, n // 8}:
            edited = list(words)
            for at in draw.sample(range(n), edits):
                edited[at] = "other"
            docs.append((k, f"some text before it {' '.join(edited)} and after it"))
    items.append((1000, "\u4eca\u5929\u5929\u6c14\u5f88\u597d"))
    docs.append((1000, "\u4ed6\u8bf4\u4eca\u5929\u5929\u6c14\u4e0d\u597d\u4e86"))
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((k, k) for k, _ in docs)


def test_fingerprints_and_components_against_counting(spark):
    docs = common.table(spark, FOLDER, "documents").select("doc_id", "text")
    prints = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in prints}
    for _ in prints:
        new = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == group:
            break
        group = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_query(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_shards_over_the_tree_limit_are_split_without_losing_links(spark):
    draw = random.Random(3)
    base = draw.getrandbits(64)
    values = sorted({base ^ (1 << draw.randrange(20)) ^ (1 << draw.randrange(20)) ^ (1 << draw.randrange(20)) for _ in range(120)})
    nodes = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "id bigint, fp bigint")
    links = simhash.hamming_links(nodes, 2, simhash.pigeonhole_masks(2, 4), most=16)
    roots = {r.node: r.root for r in common.connected_components(links.select("a", "b")).collect()}
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert [roots.get(i, i) for i in range(len(values))] == group


def test_tree_finds_what_a_scan_finds():
    draw = random.Random(1)
    values, tree = [draw.getrandbits(16) for _ in range(300)], simhash.Tree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.near(q, 3)) == sorted(((v ^ q).bit_count(), i) for i, v in enumerate(values) if (v ^ q).bit_count() <= 3)


def test_toxic_words_are_found_under_disguise():
    found = toxicity.Matcher(toxicity.Lexicon(((f" {toxicity.fold('idiot')} ", 3.0), (f" {toxicity.fold('scum')} ", 3.0)), (f"{toxicity.fold('pond scum')}",)))
    assert [found.measure(t.encode())[1] for t in ("You 1D10T!", "an ídі​οt", "idiotic", "pond scum", "scum pond", "")] == [1, 1, 0, 0, 1, 0]


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    for query, label, least in ((toxicity.toxicity_query, "toxic", 0.75), (compression.quality_query, "quality", 0.9)):
        rows = query(docs, labels).where("held_out").join(labels, "doc_id").selectExpr(f"{label} as y", "predicted as p").collect()
        rates = [sum(r.p == y for r in rows if r.y == y) / max(1, sum(r.y == y for r in rows)) for y in (0, 1)]
        assert sum(rates) / 2 >= least


def test_matching_statistics_against_a_scan():
    draw = random.Random(2)
    sequences = [[draw.choice([b"a", b"b", b"c"]) for _ in range(12)] for _ in range(5)]
    machine = licences.Automaton(sequences)
    runs = {tuple(s[i:j]): n for n, s in enumerate(sequences) for i in range(12) for j in range(i + 1, 13)}
    text = [draw.choice([b"a", b"b", b"c", b"x"]) for _ in range(300)]
    got = {at: (length, machine.ends[state]) for at, length, state in machine.statistics(text)}
    for at in range(len(text)):
        length = max((n for n in range(1, min(12, at + 1) + 1) if tuple(text[at - n + 1:at + 1]) in runs), default=0)
        assert (got[at][0] if at in got else 0) == length
        if length:
            run = tuple(text[at - length + 1:at + 1])
            assert set(got[at][1]) == {n for n, s in enumerate(sequences) if any(tuple(s[i:i + length]) == run for i in range(12))}


def test_licence_notices_and_phrases():
    scan = licences.Scanner().scan
    notice = "x y " + licences.NOTICES[0][1].replace("without restriction", "without any restriction") + " z MIT License"
    words, n_base, first, last, base, labels, score, _ = scan(notice.encode())
    assert (n_base, first, last, base, labels) == (1, words - 2, words - 2, "mit", "mit") and score > 0.9
    assert scan(b"GNU-General public LICENSE, cc by gnu general public license")[1:6] == (3, 0, 6, "cc-by,gpl", "cc-by,gpl")
    assert scan(None)[:7] == (0, 0, None, None, "", "", 0.0)


def test_contamination_survives_substitutions(spark):
    item = PASSAGE.split()
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "before " + " ".join(changed) + " after"), (2, " ".join(reversed(item))), (3, PASSAGE.upper() + "!")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()} == {(1, 7), (3, 7)}


def test_flow_meets_quotas_at_least_cost():
    assert mixing.cheapest_flow([(10, [0]), (10, [0, 1])], [15, 5]) == [{0: 10}, {0: 5, 1: 5}]
    assert mixing.cheapest_flow([(4, [0])], [11]) == [{0: 11}]
    assert mixing.targets({"a": 10, "b": 1, "c": 0}, {"a": 1, "b": 2, "c": 3}) == {"c": 0, "b": 3, "a": 8}


def test_events_fold_and_texts_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|im_end|>", "<|im_end|>\\", "<<s>[[/INST]", "a\nb", "", "\\", "<\\\\s>"]
    messages = spark.createDataFrame([(1, i, f"r\n{i}\\n" if i else None, t) for i, t in enumerate(texts)], "conv_id bigint, message bigint, role string, text string")
    segments = chat.render(messages)
    for r in segments.collect():
        inner = r.segment.removeprefix(chat.START).removesuffix(chat.END)
        assert not any(c in inner for c in chat.CONTROLS)
    assert [(r.role, r.text) for r in chat.parse(segments).orderBy("message").collect()] == [(f"r\n{i}\\n" if i else "", t) for i, t in enumerate(texts)]
    events = [(1, 3, 0, "delta", None, "lo"), (1, 1, 0, "start", "user", None), (1, 2, 0, "delta", None, "hel"), (1, 4, 1, "start", "assistant", None),
              (1, 5, 1, "delta", None, "bad"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "good"), (1, 8, 2, "start", "user", "x"),
              (1, 9, 2, "delete", None, None), (1, 10, 0, "edit", None, "bye"), (None, None, None, "delta", None, "lost")]
    log = spark.createDataFrame(events, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    assert {tuple(r) for r in chat.rebuild(log).collect()} == {(1, 0, "user", "bye"), (1, 1, "assistant", "good"), (None, None, None, "lost")}


def test_chat_query_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", "y"), (2, None, "assistant", LONG)]
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\n\nx\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and set(got) == {1, 2, None, -1}


def test_archives_give_back_pages(spark):
    rows = [(3, "http://www.B.example/x?q#f", "p" * 100), (1, None, "p" * 100), (2, "http://a.example", "p" * 99), (4, "x\r\ny", None), (None, None, "p" * 100),
            (5, "http://a.example/é", "head\r\n\r\nWARC/1.1\r\né" * 30), (6, "http://a.example", "p" * 99), (7, "http://a.example", "head\r\n\r\nWARC/1.1\r\né" * 30)]
    got = warc.warc_query(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (None, "response", None), (5, "response", None),
        (6, "response", None), (7, "revisit", 5)}
    assert all(r.payload_digest == hashlib.sha256((html or "").encode()).hexdigest() for r in got for i, _, html in rows if i == r.page_id)
    assert warc.warc_query(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_loser_tree_merges_runs():
    draw = random.Random(4)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((draw.randrange(50),) for _ in range(draw.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda e: e)) == sorted(x for r in runs for x in r)


def test_equal_lines_are_one_group_and_near_lines_join_it(spark):
    words = [f"token{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    line = " ".join(words)

    def print_of(some):
        return simhash.majority(simhash.shingle_hashes(" ".join(some).encode(), 1))

    changed = ([*words[:i], "other", *words[i + 1:]] for i in range(60))
    near = " ".join(next(c for c in changed if (print_of(c) ^ print_of(words)).bit_count() <= fuzzy_lines.RADIUS))
    docs = spark.createDataFrame([(2, f"{line}\nunique words stand here"), (1, f"start here now\n{near}"), (3, line.upper() + " 12!"), (4, "}\n\n{")], "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in fuzzy_lines.lines_query(docs).collect()}
    assert got == {(1, 1): (1, 1, True), (2, 0): (1, 1, False), (3, 0): (1, 1, False)}
    left = {r.doc_id: r.text for r in fuzzy_lines.drop_repeated_lines(docs).collect()}
    assert left == {1: f"start here now\n{near}", 2: "unique words stand here", 4: "}\n\n{"}


def test_large_blocks_of_near_lines_stay_whole(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(k, " ".join([*words[:k], "changed" + chr(97 + k % 26), *words[k + 1:]])) for k in range(24)]
    docs = spark.createDataFrame([(1000, " ".join(words)), *rows], "doc_id bigint, text string")
    lines = fuzzy_lines.lines_of(docs, "doc_id", "text")
    got = fuzzy_lines.line_groups(docs, small=12)
    prints = {r.key: r.fp & simhash.ALL for r in lines.collect()}
    near = {k for k, v in prints.items() if k == 1000 or (v ^ prints[1000]).bit_count() <= fuzzy_lines.RADIUS}
    assert near <= {r.doc_id for r in got.collect()} and got.select("first_key").distinct().count() == 1


def plain_line_groups(docs):
    """{(key, pos): group} by comparing all lines with one another."""
    places = {}
    for key, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            if words := tuple(re.findall(r"[^\W_]+", line.lower())):
                places.setdefault(words, []).append((key, pos))
    lines = sorted(places, key=len)
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            b = lines[j]
            most = len(b) // 5
            if len(b) - len(a) > most:
                break
            if root(i) != root(j) and len(b) - len(set(a) & set(b)) <= most + len(b) - len(set(b)) and edits(a, b) <= most:
                parent[root(i)] = root(j)
    groups = {}
    for i, line in enumerate(lines):
        groups.setdefault(root(i), []).extend(places[line])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def line_groups_of(df, **how):
    groups = {}
    for r in fuzzy_lines.line_groups(df, **how).collect():
        groups.setdefault((r.first_key, r.first_pos), set()).add((r.doc_id, r.pos))
    return {frozenset(g) for g in groups.values()}


def test_line_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    draw = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    extra = []
    for n in [*range(1, 31), 40, 60, 90] * 3:
        line = draw.sample(words, n)
        edited = list(line)
        for _ in range(n // 5):
            at = draw.randrange(len(edited))
            edited[at:at + draw.randrange(2)] = [draw.choice(words)] * draw.randrange(2)
        extra += [" ".join(line), " ".join(edited)]
    df = docs.unionByName(spark.createDataFrame([(10_000_000, "\n".join(extra))], docs.schema)).localCheckpoint()
    want = plain_line_groups([(r.doc_id, r.text) for r in df.dropDuplicates(["doc_id"]).collect()])
    got = line_groups_of(df)
    assert got == want and sum(any(k == 10_000_000 for k, _ in g) for g in got) > 40


def test_crowded_blocks_join_what_small_ones_do(spark):
    draw = random.Random(5)
    rows = []
    for family in range(80):
        words = ["alpha"] * 9 + ["beta"] * 9 + [f"u{family}x{i}" for i in range(6)] + ["gamma"] * 6
        twin = list(words)
        for at in draw.sample(range(len(words)), 5):
            twin[at] = draw.choice(["alpha", "beta", "gamma", f"t{family}"])
        rows += [(2 * family, " ".join(words)), (2 * family + 1, " ".join(twin))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_line_groups(rows)
    assert want and line_groups_of(df, small=2, piece=7) == want and line_groups_of(df, small=10_000) == want


def test_lines_that_differ_in_numbers_stay_and_short_ones_are_copies(spark):
    bills = ["Invoice 1001 of 3 May paid 20 euro", "Invoice 2977 of 9 May paid 845 euro"]
    han = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65"
    rows = [(1, "\n".join([*bills, "Menu", "12 34", han])), (2, "\n".join(["menu!", "12, 34", "12 35", han[:-1] + "\u884c", "--"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert line_groups_of(df) == {frozenset({(1, 2), (2, 0)}), frozenset({(1, 3), (2, 1)}), frozenset({(1, 4), (2, 3)})}
    assert {r.doc_id: r.text for r in fuzzy_lines.drop_repeated_lines(df).collect()}[1] == rows[0][1]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], connect(FOLDER)) == ""


def test_ablations_count_what_one_rule_alone_rejects(spark):
    book = quality_rules.ledger(quality_rules.measured(odd(spark)))
    rows = {r.rule: (r.fails, r.only) for r in quality_rules.ablations(book, "v2").collect()}
    few = [r.failures & quality_rules.mask("v2") for r in book.collect()]
    assert rows["few_words"] == (sum(f & 1 for f in few), sum(f == 1 for f in few))
