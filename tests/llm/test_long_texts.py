"""Texts with a great many matches: places right to the end, time in proportion."""

import time

from pyspark.sql import functions as F

from candor.llm import sanitisation
from candor.llm.native import blocks, cut, occurrences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_100000_mentions_in_one_text(spark):
    took = {}
    for n in (1000, 50_000, 100_000):
        text = "é x%d@b.co, " % n * n
        df = spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS)
        began = time.time()
        r = sanitisation.sanitised(df).first()
        took[n] = time.time() - began
        assert r["text"] == "é <EMAIL>, " * n and r["n_chars"] == len(r["text"])
    assert took[100_000] < max(40, 4 * took[50_000])


def test_places_of_many_matches(spark):
    text = "ab é cab " * 30_000
    found = spark.createDataFrame([(text,)], "text string").select(occurrences(F.col("text"), "ab|é").alias("x")).first()["x"]
    import re

    assert [(x["start"], x["end"], x["said"]) for x in found] == [(m.start(), m.end(), m[0]) for m in re.finditer("ab|é", text)]


def test_cuts_of_a_text_in_blocks(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "𝄞" for i in range(10_000))
    cuts = [(0, 0), (0, 1), (4095, 4097), (4096, 4096), (8192, 10_000), (0, 10_000), (9_999, 10_000), (10_000, 10_000), (3, 9_000), (9_990, 20_000)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    got = df.select("a", "b", cut(blocks(F.col("text")), F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == text[r["a"] : r["b"]] for r in got)
    empty = df.limit(1).select(cut(blocks(F.lit("")), F.lit(0), F.lit(0)).alias("x")).first()
    assert empty["x"] == ""
