"""The JSON recogniser against the standard library's parser."""

import json
import random

from pyspark.sql import functions as F

from pagequarry.operators.extract import json_is_valid

ODD = [
    "", " ", "{}", "[]", '{"a":1,"a":2}', '{"a":{"a":1,"a":1}}', '{"a":1,}', "[1,]", "[,1]", "{1:2}", '{"a"}', '{"a":}', "[[[]]]", "[[[]]", "[]]", "{]", "[}",
    "01", "1.", ".5", "-", "-0", "1e5", "1E+5", "1e", "+1", "0x1", "NaN", "-Infinity", "Infinity", "-NaN", "truefalse", "true", "nul", "None", "'a'",
    '"a', 'a"', '"\\n"', '"\\x"', '"\\u12"', '"\\u12aF"', '"\\ud800"', '"\t"', '"\n"', '"é中👍"', '"a" "b"', "1 2", "﻿{}", "\xa01", "\x0b1", "\f1", "\r\n1\t", "//1", "1//",
    '{"a":1 "b":2}', '{"a" 1}', '{"a"::1}', '["a":1]', "null,", ",", ":", '"\x7f"', '"/\\/"', "[1,2]x", "1" * 400, '"' + "a\\n" * 5000 + '"',
]
PIECES = ["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', "1", "-2.5e3", "true", "null", " ", "\n", '"', "x", "0"]


def valid(text):
    try:
        json.loads(text)
        return True
    except json.JSONDecodeError:
        return False


def value(rng, depth=0):
    """A random value with repeated keys and blanks."""
    kind = rng.randrange(6 if depth < 4 else 3)
    blank = rng.choice(["", "", " ", "\n\t"])
    if kind == 0:
        return blank + rng.choice(["1", "-0.5", "2e9", "true", "false", "null"]) + blank
    if kind in (1, 2):
        return blank + json.dumps(rng.choice(["", "a", 'q"\\', "é\n", "</"]), ensure_ascii=rng.random() < 0.5)
    if kind == 3:
        return blank + "[" + ",".join(value(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return blank + "{" + ",".join(f'"{rng.choice("ab")}"{blank}:{value(rng, depth + 1)}' for _ in range(rng.randrange(4))) + blank + "}"


def test_json_texts(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(1500):
        text = value(rng)
        texts.append(text)
        at = rng.randrange(len(text))
        texts.append(text[:at] + rng.choice(["", *PIECES]) + text[at + rng.randrange(2):])
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_is_valid(F.col("t")).alias("ok")).collect()
    wrong = [(texts[r.i], r.ok) for r in rows if r.ok != valid(texts[r.i])]
    assert wrong == []
    assert sum(r.ok for r in rows) > 1000

