import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import arrays as A
from candor.functions import scores as S
from candor.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("sentence", "span", "want"),
    [
        ("Paris is the capital of France.", "Paris", (0, 5)),
        ("Paris is the capital of France.", "paris", (0, 5)),
        ("Paris is the capital of France.", "France", (24, 30)),
        ("Paris is the capital of France.", "the capital of France", (9, 30)),
        ("Paris is the capital of France.", "London", None),
        ("Paris is the capital of France.", "", None),
        ("Paris  is here", "Paris is", (0, 9)),
    ],
)
def test_locate(spark, sentence, span, want):
    got = one(spark, T.locate(F.col("a"), F.col("b")), a=sentence, b=span)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("raw", "want"), [("Paris", "Paris"), ('"Paris"', "Paris"), ("Paris.", "Paris"), ("NONE", None), ("", None), ("The city of Paris", None)])
def test_validated(spark, raw, want):
    assert one(spark, T.validated(F.col("a"), F.col("b")), a=raw, b="Paris is the capital of France.") == want


@pytest.mark.parametrize(
    ("pieces", "prompt", "span", "want"),
    [
        (["Paris", " is", " the", " capital", " of", " France", "."], 2, (0, 5), (2, 3)),
        (["Paris", " is", " the", " capital", " of", " France", "."], 2, (24, 30), (7, 8)),
        (["Paris", " is", " the", " capital", " of", " France", "."], 2, (9, 30), (4, 8)),
        (["It", " was", " 1969", "."], 1, (7, 11), (3, 4)),
        ([], 2, (0, 3), (2, 2)),
    ],
)
def test_token_range(spark, pieces, prompt, span, want):
    lens = np.cumsum([len(p) for p in pieces]).tolist()
    df = spark.createDataFrame([(lens, prompt, *span)], "l array<int>, p int, a int, b int")
    assert tuple(df.select(T.token_range(F.col("l"), F.col("p"), F.col("a"), F.col("b")).alias("x")).first()["x"]) == want


@pytest.mark.parametrize(("tag", "values", "want"), [("s1", (None, None, -0.09), 0.42), ("s1", (None, None, 0.0), 0.73), ("s1", (None, None, 0.1), 0.92), ("l1b", (0.0, 0.154, -0.167), 0.003), ("l1b", (0.95, 0.70, 0.20), 0.994), ("8bv2", (0.05, 0.10, -0.21), 0.007), ("8bv2", (0.85, 0.55, -0.10), 0.992)])
def test_golden_fusion(spark, tag, values, want):
    df = spark.createDataFrame([values], "sep_entropy double, hallushift double, tsv_margin double")
    assert df.select(S.model_score(tag).alias("x")).first()["x"] == pytest.approx(want, abs=6e-3)


def test_tiers_rise_with_the_score(spark):
    got = [r["t"] for r in spark.range(101).select(S.tier(F.col("id") / 100).alias("t")).collect()]
    order = [["ok", "medium", "high"].index(t) for t in got]
    assert order == sorted(order) and got[49] == "ok" and got[50] == "medium" and got[74] == "high"
    assert spark.range(1).select(S.tier(F.lit(None).cast("double")).alias("t")).first()["t"] == "filler"


def test_array_functions_equal_numpy(spark):
    rng = np.random.default_rng(0)
    p, q = rng.random(9), rng.random(9)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    a, b = F.col("p"), F.col("q")
    got = df.select(A.softmax(a).alias("soft"), A.wasserstein(a, b).alias("w"), A.cosine(a, b).alias("c"), A.entropy(a).alias("e"), A.mean_gradient(a).alias("mg"), A.max_gradient(a).alias("xg"), A.percentile(a, 0.3).alias("p30"), A.statistics(a, b).alias("s")).first()
    e = np.exp(p - p.max())
    assert got["soft"] == pytest.approx((e / e.sum()).tolist())
    assert got["w"] == pytest.approx(np.abs(np.sort(p) - np.sort(q)).mean())
    assert got["c"] == pytest.approx(p @ q / np.linalg.norm(p) / np.linalg.norm(q))
    assert got["e"] == pytest.approx(-(p * np.log(p)).sum() / math.log(9))
    assert got["mg"] == pytest.approx(np.abs(np.diff(p)).mean()) and got["xg"] == pytest.approx(np.abs(np.diff(p)).max())
    assert got["p30"] == pytest.approx(np.percentile(p, 30))
    assert got["s"][0] == pytest.approx(p.min()) and got["s"][1] == pytest.approx((p - q).max()) and got["s"][9] == pytest.approx(np.median(p)) and len(got["s"]) == 11


def test_array_edge_cases(spark):
    df = spark.createDataFrame([([0.5],), ([],)], "p array<double>")
    assert [tuple(r) for r in df.select(A.entropy(F.col("p")), A.mean_gradient(F.col("p")), A.max_gradient(F.col("p"))).collect()] == [(0.0, 0.0, 0.0)] * 2


def plain_sentences(text: str) -> list[str]:
    """A scanner of our own: a stop ends a sentence unless its token is an abbreviation, initials or an address."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in block.split("\n")]
        mixed = len(lines) > 1 and any(re.match(r"[-•*▪▸►]|\d{1,3}[.)]\s|[a-zA-Z][.)]\s", x) for x in lines)
        for part in lines if mixed else [block.strip()]:
            if mixed and re.match(r"[-•*▪▸►]|\d{1,3}[.)]\s|[a-zA-Z][.)]\s", part):
                out.append(part)
                continue
            begin = 0
            for m in re.finditer(r"\s+(?=[A-Z\"'(])", part):
                before = part[begin : m.start()]
                token = before.split()[-1] if before.split() else ""
                word = re.search(r"([A-Za-z]{1,10})\.$", token)
                stop = before[-1:] in ".!?" and not (word and word[1].lower() in T.ABBREVIATIONS and not re.search(r"[A-Za-z]$", token[: word.start()])) and not re.search(r"\b[A-Z]\.[A-Z]\.$", token) and not re.search("https?://|www\\.", token)
                if stop:
                    out.append(before)
                    begin = m.end()
            out.append(part[begin:])
    return [x.strip() for x in out if x.strip()]


TEXTS = [
    "Dr. Smith came. He left at 3.14 p.m. Then U.S. Marines arrived! Did they? Yes.",
    "See https://x.org/a. Next one. Mail a@b.org now. Done (really). \"Quoted\" end.",
    "- first point. More\n- second\nplain line. Other\n\nNew paragraph. It ends",
    "1. one\n2. two", "single - bullet", "   ", "No stop here", "A no. Five. Vol. II came. J.R.R. Tolkien wrote. End.",
]


def test_sentences_and_places(spark):
    rng = random.Random(1)
    pieces = ["Mr. Hall", "went.", "home", "\n\n", "\n", "- item", "Yes!", "U.S.", "3.5", "www.a.b.", "Why?", "(So)", "etc.", "ok."]
    texts = TEXTS + [" ".join(rng.choice(pieces) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("text", T.sentences(F.col("text")).alias("s")).collect():
        assert [x["sentence"] for x in r["s"]] == plain_sentences(r["text"]), r["text"]
        assert all(r["text"][x["start"] : x["end"]] == x["sentence"] for x in r["s"])


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.sentences(F.col("t")).alias("s"), T.is_claim(F.col("t")).alias("c"), T.is_refusal(F.col("t")).alias("r"), T.verdict(F.col("t")).alias("v")).first()
    assert r["s"] == [] and r["c"] is False and r["r"] is False and r["v"] == 1


def test_running_equals_plain_sums(spark):
    lists = [[], [5], [1, 2], list(range(10)), [7] * 101, [3, -4, 9, 0, 2] * 40]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    top = A.running(F.col("x"), F.lit(-1), lambda a, v: F.greatest(a, v))
    for x, r in zip(lists, df.select("x", A.running_sum(F.col("x")).alias("s"), top.alias("m")).collect(), strict=True):
        assert r["x"] == x and r["s"] == [sum(x[: i + 1]) for i in range(len(x))] and r["m"] == [max([-1, *x[: i + 1]]) for i in range(len(x))]


def test_a_text_of_100000_sentences(spark):
    """The places are right to the end, and the time follows the number of sentences."""
    import time

    took = {}
    for n in (1000, 50_000, 100_000):
        df = spark.createDataFrame([("Emile wént home at 5. " * n,)], "text string")
        began = time.time()
        r = df.select(T.sentences(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
        took[n] = time.time() - began
        assert r["n"] == n and (r["last"]["start"], r["last"]["end"]) == (22 * (n - 1), 22 * n - 1)
    assert took[100_000] < max(20, 4 * took[50_000])


def scanned(line):
    """Tokens of a line by going through it once."""
    out, at, i = [], 0, 0
    while i < len(line):
        for mark, kind in (("**", "bold"), ("*", "italic"), ("`", "code")):
            end = line.find(mark, i + len(mark) + 1) if line.startswith(mark, i) else -1
            if end > 0 and "\n" not in line[i:end]:
                if i > at:
                    out.append(("plain", at, i, line[at:i]))
                at = end + len(mark)
                out.append((kind, i, at, line[i + len(mark) : end]))
                i = at - 1
                break
        i += 1
    return out + ([("plain", at, len(line), line[at:])] if at < len(line) else [])


def test_inline_tokens_equal_a_scanner(spark):
    rng = random.Random(9)
    lines = ["**a*b** and", "", "plain", "**bold** *it* `co de`", "** x", "****", "***", "*a**b*", "`a` b `", "é **ñ** 𝄞 *x*", "a" * 50 + " **b** " * 3000]
    lines += ["".join(rng.choice(["*", "**", "`", "a", " ", "é"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", T.inline_tokens(F.col("line")).alias("t")).collect()
    assert {r["id"]: [tuple(t) for t in r["t"]] for r in got} == {i: scanned(x) for i, x in enumerate(lines)}
