import html
import random

from pyspark.sql import functions as F

from pagequarry.functions.text import decode_entities, visible_text


def test_references_without_semicolon_against_the_standard_library(spark):
    draw = random.Random(8)
    parts = ["&copy", "&copy;", "&notit;", "&notin;", "&not", "&amp", "&ampamp;", "&nbspx", "&unknown", "&unknown;", "&#65", "&#x41", "&#65;", "&#x41;z", "&", "&;",
             "&lt;b", "&para", "&frac12cup", "&sup1", "&#", "&#x", "&Eacute", "&eacutes", "&ngE", "&acE;"]
    texts = ["&copy 2020 &amp more", *{"".join(draw.choice([*parts, " ", "word", "9"]) for _ in range(draw.randrange(1, 9))) for _ in range(600)}]
    # A digit or letter right behind a number would be part of it.
    texts = [t for t in texts if "&#65" not in t or all(c[:1] not in "0123456789" for c in t.split("&#65")[1:])]
    texts = [t for t in texts if "&#x" not in t or all(c[:1] not in "0123456789abcdefABCDEF" for c in t.split("&#x41")[1:]) and "&#x9" not in t and "&#9" not in t]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_entities(F.col("t"), legacy=True).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: html.unescape(t) for t in texts} and len(got) > 300


def test_links_keep_names_without_semicolon(spark):
    row = spark.range(1).select(
        decode_entities(F.lit("?a=1&copy=2&amp;b")).alias("link"), visible_text(F.lit("<p>&copy 2020</p> &amp more")).alias("text")).first()
    assert (row.link, row.text) == ("?a=1&copy=2&b", "© 2020 & more")
