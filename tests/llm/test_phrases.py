"""Phrase mining against plain counting: pieces, languages, splits of hot prefixes, nested phrases, exact scores, ties."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candor.llm import phrases

DOCS = "doc_id long, text string, lang string, w1 long, phrase string, n int"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, words[i : i + k]] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in candidates.items():
        if any(m == lang and len(q) > len(p) and b >= a and inside(p, q) for (m, q), b in candidates.items()):
            continue
        score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((lang, -score, -a, " ".join(p).encode(), l, r, total[lang]))
    best, seen = [], Counter()
    for lang, score, a, p, l, r, n in sorted(out):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= top:
            best.append((lang, seen[lang], p.decode(), -a, l, r, n, -score))
    return best


def texts(seed):
    rng = random.Random(seed)
    words = "the of a Red fox Fox-trot émile ÉMILE x1 Ünder zz".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(said(rng.randint(0, 60)) + rng.choice([".", ";\n", "\t \t", "\x0b", ""]) + said(20), rng.choice(["en", "en", "en", "de", None])) for _ in range(150)]
    rows += [("alpha beta gamma delta epsilon zeta", "en")] * 40 + [("alpha beta gamma. alpha beta, beta gamma", "en")] * 3
    rows += [("w w w w w w w w w w w w", "en"), ("the the the the the " * 40, "en"), (None, "en"), ("", None), (" \t. ,;", "de"), ("one two", "und"), ("a:b!c?d", "en")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(rows)], DOCS).repartition(6)


@pytest.mark.parametrize("shard", [phrases.SHARD, 60, 1])
def test_equals_plain_counting(spark, shard):
    """Prefixes of more than 60 occurrences, and all, are split by their next word."""
    rows = texts(5)
    got = phrases.collocations(frame(spark, rows), least=12, top=100, shard=shard).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 12, 100))


def test_top_and_ties(spark):
    rows = [(f"{a} {b}", "en") for a in "pqrst" for b in ("u1", "u2") for _ in range(4)]
    got = phrases.collocations(frame(spark, rows), least=4, top=3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == plain(rows, 4, 3) and [r["phrase"] for r in got] == ["p u1", "p u2", "q u1"]


def test_partial_counts_of_small_tasks(spark, monkeypatch):
    """Counts are handed on when a task holds too many; with bitmaps so small that nearly all words pass."""
    rows = texts(6)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "SLICE", 200)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    got = phrases.collocations(frame(spark, rows), least=12, top=100, shard=30).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 12, 100))


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big * 4, 7)], "a long, n long, l long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    x = df.select(F.call_function("div", (wide("a") * wide("n")) * F.lit(1000).cast("decimal(4,0)"), wide("n") * wide("a")).alias("one"), F.call_function("div", (wide("a") * wide("n")) * F.lit(1000).cast("decimal(4,0)"), wide("n") * wide("l")).alias("x")).first()
    assert x["one"] == 1000 and x["x"] == 1000 * big // 7


def test_nothing_frequent_and_empty(spark):
    assert phrases.collocations(frame(spark, [("a b c", "en"), (None, None)])).count() == 0
    assert phrases.collocations(spark.createDataFrame([], DOCS)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_very_long_text(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(60_000)), "en")]
    got = phrases.collocations(frame(spark, rows), least=200, top=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 200, 50))
