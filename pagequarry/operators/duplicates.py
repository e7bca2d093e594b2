"""Duplicate titles, repeated openings, and pages with similar wording."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.binding import let
from pagequarry.operators.components import connected_components
from pagequarry.operators.rules.base import emit, evidence, text, when
from pagequarry.operators.rules.catalog import rule
from pagequarry.session import materialize

SHINGLE_WORDS = 6
LEAST_WORDS = 20
THRESHOLD = 0.55
# How many copies of one token meet in a task before the token is split.
TOKEN_BLOCK = 512


def duplicate_titles(profiles: DataFrame) -> DataFrame:
    """Per scan: how many pages repeat an earlier title, and the first that does.

    Only two rows per title and task reach the shuffle (counts aside), so a title
    carried by a third of all pages is no hot group.
    """
    key = F.lower(F.trim(F.col("title")))
    keyed = profiles.select("scan_id", "seq", "url", "title", key.alias("title_key")).where(F.col("title_key") != "")
    counts = keyed.groupBy("scan_id", "title_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    repeats = counts.groupBy("scan_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    order = Window.partitionBy("scan_id", "title_key").orderBy("seq")
    second = keyed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2).where(F.col("nth") == 2)
    first = second.groupBy("scan_id").agg(F.min_by(F.struct("url", "title"), "seq").alias("first"))
    return repeats.join(first, "scan_id").select(
        "scan_id", "duplicates", F.col("first.url").alias("url"), F.col("first.title").alias("title")
    )


def duplicate_title_findings(profiles: DataFrame) -> DataFrame:
    url = F.col("url")
    return emit(duplicate_titles(profiles), [
        when(rule("SEO_DUPLICATE_TITLES"), True, text("Duplicate page titles (", F.col("duplicates"), " page(s))"), url,
             evidence("PAGE", url, F.coalesce("title", F.lit("")))),
    ])


def repeated_openings(profiles: DataFrame) -> DataFrame:
    """Per scan: every opening that two or more pages share, how many do, and the first of them."""
    groups = (
        profiles.where(F.col("opening_sha").isNotNull())
        .groupBy("scan_id", "opening_sha")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "url")).alias("first"))
        .where(F.col("n") >= 2)
    )
    return groups.select("scan_id", F.col("n").alias("copies"), F.col("first.url").alias("url"), F.col("first.seq").alias("seq"))


def repeated_opening_findings(profiles: DataFrame) -> DataFrame:
    url, n = F.col("url"), F.col("copies")
    return emit(repeated_openings(profiles), [
        when(rule("CONTENT_REPEATED"), True, text("Repeated content across ", n, " page(s)"), url,
             evidence("PAGE", url, text(n, " pages share identical text prefix")), key1=F.col("seq")),
    ])


def _over_shingles(body: Column, of: Callable[[list[Column]], Column], kind: str) -> Column:
    """``of`` applied to each run of six words; nothing for fewer than twenty words.

    Words are picked one by one: slicing would copy the whole text at every position.
    """
    words = F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]{3,}"), F.lit(0))

    def build(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS)
        return F.when(
            F.size(w) >= LEAST_WORDS, F.transform(starts, lambda i: of([F.get(w, i + k) for k in range(SHINGLE_WORDS)]))
        ).otherwise(
            F.array().cast(f"array<{kind}>")
        )

    return let(words, build)


def shingles_of(body: Column) -> Column:
    """Six-word shingles of a text in order."""
    return _over_shingles(body, lambda six: F.concat_ws(" ", *six), "string")


def shingle_hashes(body: Column) -> Column:
    """The same shingles as 64-bit hashes: eight bytes to shuffle and sort instead of six words."""
    return _over_shingles(body, lambda six: F.xxhash64(*six), "bigint")


def shingle_counts(docs: DataFrame, group: str, doc: str, body: str) -> DataFrame:
    """Shingle multisets: one row per document and shingle with its count.

    A document of one row is counted within the row, so its shingles are not shuffled. Only documents of several rows,
    found by their ids, are counted by an aggregate.
    """
    repeated = materialize(
        docs.groupBy(F.col(group).alias("g"), F.col(doc).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "d"), "repeated-ids")
    same = docs[group].eqNullSafe(repeated["g"]) & docs[doc].eqNullSafe(repeated["d"])
    counted = _runs(shingles_of(F.col(body)), lambda s, n: F.struct(s.alias("shingle"), n.cast("bigint").alias("n")))
    once = docs.join(repeated, same, "left_anti").select(group, doc, F.inline(counted))
    rows = docs.join(repeated, same, "left_semi").select(group, doc, F.explode(shingles_of(F.col(body))).alias("shingle"))
    return once.unionByName(rows.groupBy(group, doc, "shingle").agg(F.count(F.lit(1)).alias("n")))


def _fingerprint(hashes: Column) -> Column:
    """Equal for equal shingle multisets."""
    return F.sha2(F.array_join(F.transform(F.sort_array(hashes), lambda h: F.hex(h)), ","), 256)


def _runs(items: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` (item, count) for each different item of an array, within the row: sorted, equal items stand together."""
    def build(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, j: of(F.get(s, p), F.coalesce(F.get(at, j + 1), F.size(s)) - p)))

    return F.when(F.size(items) > 0, let(F.sort_array(items), build))


def copy_groups(docs: DataFrame, group: str, doc: str, body: str) -> DataFrame:
    """Each document with the first document of its group that has the same shingles.

    ``representative`` equals the document itself for the first of each set of copies.
    Documents too short for shingles are left out: they are similar to nothing.
    Texts are read once; the rest works on a narrow stage table.
    """
    hashed = docs.select(group, doc, shingle_hashes(F.col(body)).alias("hashes")).where(F.size("hashes") > 0)
    prints = materialize(hashed.select(group, doc, _fingerprint(F.col("hashes")).alias("fingerprint")), "fingerprints")
    firsts = prints.groupBy(group, "fingerprint").agg(
        F.min(doc).alias("representative"), F.count(F.lit(1)).alias("copies")
    )
    return prints.join(firsts, [group, "fingerprint"]).select(group, doc, "representative", "copies")


def _prefixes(docs: DataFrame, group: str, doc: str, body: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The different texts with their tokens and, rarest first, the prefix that two similar texts must share a token of;
    and each document with the first one of its copies.

    A token of the prefix has its ``place`` among all tokens of the text (from 0) and the number ``df`` of texts with it;
    tokens of one text alone come first and are left out.
    """
    hashed = docs.select(group, doc, shingle_hashes(F.col(body)).alias("hashes")).where(F.size("hashes") > 0)
    prints = materialize(hashed.withColumn("fingerprint", _fingerprint(F.col("hashes"))), "hashes")
    firsts = prints.groupBy(group, "fingerprint").agg(F.min(doc).alias(doc), F.count(F.lit(1)).alias("copies"))
    # The k-th occurrence of a shingle is a token of its own: multisets become sets, row by row.
    numbered = F.flatten(_runs(
        F.col("hashes"), lambda h, n: F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.col(group), h, k))))
    texts = prints.drop("fingerprint").join(firsts.drop("fingerprint"), [group, doc]).select(
        group, doc, "copies", F.size("hashes").alias("size"), numbered.alias("tokens"))
    # Most tokens stand in one text: they are dropped where they meet, and only the others go back to their texts.
    # No text is without tokens; a plain explode would number them once more, in a filter on their count.
    met = texts.select(group, doc, F.explode_outer("tokens").alias("token")).withColumn(
        "df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    repeated = met.groupBy(group, doc).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("repeated"))
    # The threshold as a ratio of integers: products of floats lose pairs exactly at it.
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator
    prefix_length = F.col("size") - F.expr(f"cast((size * {num}L + {den - 1}L) div {den} as int)") + 1
    alone = F.col("size") - F.size("repeated")
    prefixed = materialize(
        texts.join(repeated, [group, doc], "left")
        .withColumn("repeated", F.coalesce("repeated", F.array().cast("array<struct<df:bigint,token:bigint>>")))
        .select(
            group, doc, "copies", "size", "tokens",
            F.transform(
                F.slice("repeated", F.lit(1), F.greatest(prefix_length - alone, F.lit(0))),
                lambda o, i: F.struct(o["df"], o["token"], (alone + i).alias("place")),
            ).alias("prefix"),
        ),
        "prefixes",
    )
    first_of = firsts.select(group, "fingerprint", F.col(doc).alias("representative"))
    return prefixed, prints.join(first_of, [group, "fingerprint"]).select(group, doc, "representative")


def similar_pairs(
    docs: DataFrame, group: str, doc: str, body: str, threshold: float = THRESHOLD, block: int = TOKEN_BLOCK,
) -> DataFrame:
    """All pairs of distinct texts in a group whose multiset Jaccard is at least ``threshold``.

    Exact. Copies are folded to their first document beforehand (``copies_a`` and
    ``copies_b`` say how many each side stands for; ``copy_groups`` lists them), so a
    mass of copies gives one row, not its square. Candidates come from prefix
    filtering: in rare-first token order two texts that similar must share one of
    the first n - ceil(t n) + 1 tokens, so wording common to a whole site makes no
    candidates. Tokens still shared by many texts are split into blocks whose pairs
    are spread over tasks. Texts are read once; each later step starts from a
    written stage table.
    """
    prefixed, _ = _prefixes(docs, group, doc, body, threshold)
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator
    index = prefixed.select(group, doc, "size", F.inline("prefix"))
    blocks = F.ceil(F.col("df") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(doc), blocks.cast("bigint")).cast("int")
    meeting = index.select(
        group, doc, "size", "token", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    ).select(
        group, doc, "size", "token", "mine",
        F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
    )
    left = meeting.select(group, "token", "low", "high", F.col(doc).alias("a"), F.col("size").alias("size_a"), F.col("mine").alias("block_a"))
    right = meeting.select(group, "token", "low", "high", F.col(doc).alias("b"), F.col("size").alias("size_b"), F.col("mine").alias("block_b"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    candidates = (
        left.join(right, [group, "token", "low", "high"])
        .where((F.col("a") < F.col("b")) & ((F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b"))))
        .where(small * F.lit(den) >= large * F.lit(num))
        .select(group, "a", "b")
        .distinct()
    )
    side = prefixed.select(group, doc, "copies", "size", "tokens")
    both = candidates.join(
        side.select(F.col(group), F.col(doc).alias("a"), F.col("copies").alias("copies_a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a")),
        [group, "a"],
    ).join(
        side.select(F.col(group), F.col(doc).alias("b"), F.col("copies").alias("copies_b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b")),
        [group, "b"],
    )
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    scored = both.withColumn("shared", shared).withColumn(
        "score", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    )
    either = F.col("size_a") + F.col("size_b") - F.col("shared")
    return scored.where(F.col("shared") * F.lit(den) >= either * F.lit(num)).select(group, "a", "b", "copies_a", "copies_b", "score")


def _scored(pairs: DataFrame, prefixed: DataFrame, group: str, doc: str, num: int, den: int) -> DataFrame:
    """``pairs`` (group, a, b) with ``score``, the multiset Jaccard, and whether they are ``similar``, decided in integers."""
    side = prefixed.select(group, doc, "size", "tokens")
    both = pairs
    for end in ("a", "b"):
        both = both.join(side.select(group, *[F.col(c).alias(f"{c}_{end}" if c != doc else end) for c in (doc, "size", "tokens")]), [group, end])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    either = F.col("size_a") + F.col("size_b") - F.col("shared")
    return both.withColumn("shared", shared).select(
        *pairs.columns, (F.col("shared") / either).alias("score"), (F.col("shared") * F.lit(den) >= either * F.lit(num)).alias("similar")
    )


def similar_clusters(
    docs: DataFrame, group: str, doc: str, body: str, threshold: float = THRESHOLD, block: int = TOKEN_BLOCK,
) -> DataFrame:
    """Documents that similar texts connect: (group, doc, cluster, representative, score, similar).

    ``cluster`` is the first document of those connected, ``representative`` the first copy of the document's text,
    ``score`` its similarity with the cluster's first document and ``similar`` whether that reaches ``threshold``.
    Documents that nothing is similar to are left out.

    No two documents that are similar end in different clusters, yet the pairs are not listed: of the texts that share
    a rare token, all are compared with the first one, and a mass of near copies is connected by that already. Only
    texts unlike the first one are compared with the others, and only with those that are not connected to them so far,
    in pieces of ``block``. Pairs whose tokens behind the shared one can't suffice are not compared at all.
    """
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator
    prefixed, copies = _prefixes(docs, group, doc, body, threshold)
    index = prefixed.select(group, F.col(doc).alias("x"), "size", F.inline("prefix")).drop("df")
    token = [group, "token"]
    firsts = materialize(
        index.groupBy(*token).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "size", "place")).alias("first")).where("n > 1"), "firsts"
    )

    def may_reach(size: Column, place: Column) -> Column:
        """The shared token is the first that both have: what stands behind it must suffice."""
        rest = F.least(F.col("size") - F.col("place"), size - place)
        near = F.least("size", size) * F.lit(den) >= F.greatest("size", size) * F.lit(num)
        return near & (rest * F.lit(num + den) >= (F.col("size") + size) * F.lit(num))

    def pair(y: Column) -> list[Column]:
        return [group, F.least("x", y).alias("a"), F.greatest("x", y).alias("b")]

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        return materialize(_scored(pairs.distinct(), prefixed, group, doc, num, den).where("similar").select(group, "a", "b"), label)

    y = F.col("first.x")
    star = index.join(firsts, token).where(F.col("x") != y)
    links = linked(star.where(may_reach(F.col("first.size"), F.col("first.place"))).select(*pair(y)), "cluster-links")
    roots = connected_components(links, group, "clusters").withColumnRenamed("node", "x")

    # Texts unlike the first one of a token, against all of that token that are not connected to them.
    unlike = star.where("n > 2").select(*token, "x", "size", "place", "n", *pair(y)[1:]).join(links, [group, "a", "b"], "left_anti").drop("a", "b")
    pieces = F.ceil(F.col("n") / F.lit(block)).cast("int")
    asked = materialize(
        unlike.join(roots, [group, "x"], "left").select(
            *token, "x", "size", "place", F.coalesce("root", "x").alias("root"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")),
        "cluster-unlike",
    )
    if not asked.isEmpty():
        crowd = index.join(firsts.where("n > 2"), token).where(F.col("x") != F.col("first.x")).join(roots, [group, "x"], "left").select(
            *token, F.col("x").alias("y"), F.col("size").alias("size_y"), F.col("place").alias("place_y"), F.coalesce("root", "x").alias("root_y"),
            F.pmod(F.xxhash64("x"), pieces.cast("bigint")).cast("int").alias("piece"),
        )
        met = asked.join(crowd, [*token, "piece"]).where("root <> root_y").where(may_reach(F.col("size_y"), F.col("place_y")))
        more = linked(met.select(*pair(F.col("y"))), "cluster-more")
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more), group, "clusters").withColumnRenamed("node", "x")

    texts = prefixed.select(group, F.col(doc).alias("x"), "copies").join(roots, [group, "x"], "left").withColumn("root", F.coalesce("root", "x"))
    large = texts.groupBy(group, "root").agg(F.sum("copies").alias("n")).where("n > 1").select(group, "root")
    members = _scored(texts.join(large, [group, "root"], "left_semi").select(group, F.col("root").alias("a"), F.col("x").alias("b")), prefixed, group, doc, num, den)
    return copies.join(members.withColumnRenamed("b", "representative"), [group, "representative"]).select(
        group, doc, F.col("a").alias("cluster"), "representative", "score", "similar"
    )


def first_comparisons(profiles: DataFrame, comparisons: int = 60, most: int = 5) -> DataFrame:
    """Similar page pairs among a scan's first comparisons in crawl order.

    Pairs (i, j), i < j, are looked at in order until ``comparisons`` pairs or ``most``
    hits: a bounded look for those who want one. ``similar_clusters`` is whole.
    """
    order = Window.partitionBy("scan_id").orderBy("seq")
    first = (
        profiles.select("scan_id", "seq", "url", "text").where(F.coalesce("text", F.lit("")) != "")
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= comparisons + 1)
        .withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("scan_id")))
        .withColumn("i", F.col("nth") - 1)
    )
    counted = (
        first.select("scan_id", "seq", "i", "many", shingle_hashes(F.col("text")).alias("s"))
        .select("scan_id", "seq", "i", "many", F.size("s").alias("size"), F.explode("s").alias("h"))
        .groupBy("scan_id", "seq", "i", "many", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    )
    i, j = F.col("i_a"), F.col("i_b")

    def place_of(low: Column, high: Column) -> Column:
        return low * F.col("many") - F.floor(low * (low + 1) / 2) + (high - low)

    # Few pages can be the first of a pair: the home page alone on any larger site.
    leads = counted.where(place_of(F.col("i"), F.col("i") + 1) <= comparisons)
    keys = ["scan_id", "h"]
    a = leads.select(*keys, "many", *[F.col(c).alias(f"{c}_a") for c in ("seq", "i", "size", "n")])
    b = counted.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("seq", "i", "size", "n")])
    pairs = (
        a.join(b, keys).where((i < j) & (place_of(i, j) <= comparisons))
        .groupBy("scan_id", place_of(i, j).alias("place"), "seq_a", "seq_b", "size_a", "size_b")
        .agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
        .withColumn("score", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
        .where(F.col("score") >= THRESHOLD)
    )
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy("place")))
    found = ranked.where(F.col("rank") <= most).select("scan_id", "seq_a", "seq_b", "score")
    return _with_urls(found, profiles)


def similar_to_first(profiles: DataFrame) -> DataFrame:
    """Each page that is similar to the first page of its cluster, with that page: one row a page, however many are alike."""
    clusters = similar_clusters(profiles.select("scan_id", "seq", "text"), "scan_id", "seq", "text")
    pairs = clusters.where("similar AND seq <> cluster").select("scan_id", F.col("cluster").alias("seq_a"), F.col("seq").alias("seq_b"), "score")
    return _with_urls(pairs, profiles)


def _with_urls(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    named = profiles.select("scan_id", "seq", "url")
    return pairs.join(named.select("scan_id", F.col("seq").alias("seq_a"), F.col("url").alias("url_a")), ["scan_id", "seq_a"]).join(
        named.select("scan_id", F.col("seq").alias("seq_b"), F.col("url").alias("url_b")), ["scan_id", "seq_b"]
    ).select("scan_id", "seq_a", "seq_b", "url_a", "url_b", "score")


def similarity_findings(profiles: DataFrame, comparisons: int | None = None, most: int = 5) -> DataFrame:
    """A finding for each page similar to the first of its cluster; with ``comparisons``, for the pairs of ``first_comparisons``."""
    a, score = F.col("url_a"), F.col("score")
    shown = text("similarity_score=", F.format_string("%.2f", F.round(score, 2)), " vs ", F.col("url_b"))
    pairs = similar_to_first(profiles) if comparisons is None else first_comparisons(profiles, comparisons, most)
    return emit(pairs, [
        when(rule("CONTENT_POTENTIAL_SIMILARITY"), True, F.lit("Potential content similarity between two pages"), a,
             evidence("METRIC", a, shown, similarity_score=F.round(score, 3)), confidence=F.round(score, 2),
             key1=F.col("seq_a"), key2=F.col("seq_b")),
    ])
