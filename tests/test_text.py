"""Text functions against Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docrecords.functions import text as T
from docrecords.operators.hierarchy import heading_weight, level_type

SAMPLES = [
    "abc", 'q"x', "é à", "\U0001f600 x", "a\\u00E9 é", "\\", "tab\t\x01\x1f\x7f", "ABCDEFéྫC DEF", "", "  ÉA",
    " 　 x \x1f", ". Foo", "  .;x;.  ", "<a href='x'>&amp;</a>", "&lt;code&gt; & <code>x</code>", "'\"", "﻿￿",
    *["".join(random.Random(i).choices("ab<>&\"'\\;\t\u00e9\u20ac\U0001f600", k=30)) for i in range(40)],
]


def apply(spark, fn):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_json(spark):
    assert apply(spark, T.json_text) == [json.dumps(s) for s in SAMPLES]
    assert [json.loads(x) for x in apply(spark, T.json_value)] == SAMPLES
    assert spark.range(1).select(T.json_text(F.lit(None).cast("string"))).first()[0] == "null"


@pytest.mark.parametrize("chars", ["", ".,;:§¶", "x"])
def test_strip(spark, chars):
    def strip(s):
        s = s.strip()
        return (s.strip(chars) if chars else s) or None

    assert apply(spark, lambda c: T.strip_text(c, chars)) == [strip(s) for s in SAMPLES]
    assert apply(spark, lambda c: T.strip_built(c, chars)) == [strip(s) for s in SAMPLES]


@pytest.mark.parametrize("keep", [(), ("code",), ("code", "a")])
def test_escape(spark, keep):
    entities = str.maketrans({"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})
    kept = "|".join(f"</?{tag}>" for tag in keep) or "(?!)"

    def escape(s):
        parts = re.split(f"({kept})", s)
        return "".join(part if ix % 2 else part.translate(entities) for ix, part in enumerate(parts))

    want = [escape(s) for s in SAMPLES]
    assert apply(spark, lambda c: T.escape_text(c, keep)) == want
    # escaping twice changes nothing
    assert apply(spark, lambda c: T.escape_text(T.escape_text(c, keep), keep)) == [escape(w) for w in want]


def test_weights_and_flags(spark):
    df = spark.range(8).select(level_type(F.col("id").cast("int")).alias("t"), heading_weight(F.col("id").cast("int")).alias("w"))
    rows = df.withColumn("w2", T.level_weight(F.col("t"))).collect()
    assert [r.w for r in rows] == [r.w2 for r in rows] == [100, 90, 80, 70, 60, 50, 40, 0]
    assert [r.t for r in rows][-2:] == ["lvl6", "content"]
    row = spark.range(1).select(T.flag_text(F.lit(True)).alias("a"), T.restore_apostrophes(F.lit("it&#x27;s")).alias("b")).first()
    assert (row.a, row.b) == ("True", "it's")
