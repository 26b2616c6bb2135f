"""Ordered operations against plain loops: many ranges, null keys, ties, empty sides, a text of a million tokens."""

import bisect
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candor import catalog
from candor.functions import text as T
from candor.operators import ordered
from candor.sources import files


@pytest.fixture(scope="module", params=[1, 7])
def wide(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("descending", [False, True])
def test_running(wide, descending):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(-5, 5)) for i in range(500)]
    rng.shuffle(rows)
    df = wide.createDataFrame(rows, "k string, o int, v int")
    got = {(r["k"], r["o"]): (r["cum_v"], r["all_v"]) for r in ordered.running(df, ["k"], "o", ["v"], descending).collect()}
    for k, o, _ in rows:
        assert got[k, o] == (sum(v for a, b, v in rows if a == k and (b >= o if descending else b <= o)), sum(v for a, _, v in rows if a == k))


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(wide, strict):
    rng = random.Random(2)
    left = [(rng.choice(["a", "b", "none", None]), i, rng.randint(0, 60)) for i in range(300)]
    right = [(rng.choice(["a", "b", "other", None]), rng.randint(0, 55), i) for i in range(120)]
    got = ordered.as_of(wide.createDataFrame(left, "k string, id int, at int"), wide.createDataFrame(right, "k string, at int, v int"), ["k"], "at", "v", strict).collect()
    assert len(got) == len(left)
    for r in got:
        after = [(at, v) for k, at, v in right if k == r["k"] and (at > r["at"] if strict else at >= r["at"])]
        assert r["v"] == (min(after)[1] if after else None)


def test_moving_average(wide):
    rng = np.random.default_rng(3)
    rows = [(("a", "b", None)[i % 3], i, rng.normal(size=4).tolist()) for i in range(400)] + [("one", 5, [1.0, 2.0, 3.0, 4.0])]
    got = {r["k"]: r["average"] for r in ordered.moving_average(wide.createDataFrame(rows, "k string, o int, x array<double>").repartition(5), ["k"], "o", "x", 0.9).collect()}
    for key in ("a", "b", None, "one"):
        c = None
        for k, _, x in rows:
            if k == key:
                c = np.array(x) if c is None else 0.9 * c + (1 - 0.9) * np.array(x)
        assert np.allclose(got[key], c, atol=1e-12)


def test_token_ranges_equal_the_array_form(wide):
    rng = random.Random(4)
    sizes = {d: [rng.randint(0, 4) for _ in range(n)] for d, n in enumerate([1, 3, 40, 200])}
    tokens = [(d, k, v) for d, s in sizes.items() for k, v in enumerate(s)]
    spans = [(d, i, a, a + rng.randint(0, 9)) for d in [*sizes, 99] for i, a in enumerate(rng.sample(range(-2, 500), 40))]
    got = {(r["d"], r["id"]): (r["a"], r["b"]) for r in ordered.token_ranges(wide.createDataFrame(tokens, "d int, k int, size int"), wide.createDataFrame(spans, "d int, id int, start int, end int"), "d", 3).collect()}
    lens = {d: np.cumsum(s).tolist() for d, s in sizes.items()}
    arrays = wide.createDataFrame([(d, i, lens.get(d, []), a, b) for d, i, a, b in spans], "d int, id int, lens array<int>, start int, end int")
    want = arrays.select("d", "id", T.token_range(F.col("lens"), F.lit(3), F.col("start"), F.col("end")).alias("x")).collect()
    assert len(got) == len(spans) and all(got[r["d"], r["id"]] == (r["x"]["a"], r["x"]["b"]) for r in want)


def test_a_text_of_a_million_tokens(spark):
    n = 1_000_000
    tokens = spark.range(n).select(F.lit(1).alias("d"), F.col("id").cast("int").alias("k"), (F.col("id") % 3 + 1).cast("int").alias("size"))
    lens = np.cumsum(np.arange(n) % 3 + 1).tolist()
    spans = [(1, i, a, a + 50) for i, a in enumerate(range(0, lens[-1], lens[-1] // 200))]
    got = ordered.token_ranges(tokens, spark.createDataFrame(spans, "d int, id int, start int, end int"), "d", 0).collect()
    for r in got:
        assert r["a"] == bisect.bisect_right(lens, r["start"]) and r["b"] == min(n, bisect.bisect_right(lens, min(r["start"] + 50, lens[-1]) - 1) + 1)


def test_line_files(spark, tmp_path):
    lines = [f"line {i}" + " é" * (i % 50) if i % 7 else "" for i in range(5000)]
    (tmp_path / "a").mkdir()
    for i in range(3):
        (tmp_path / "a" / f"part-{i}.txt").write_text("".join(x + "\n" for x in lines[i * 1700 : (i + 1) * 1700]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # a file is several splits
    try:
        got = {r["n"]: r["line"] for r in files.read_lines(spark, str(tmp_path / "a")).collect()}
        assert got == dict(enumerate(lines))
        (tmp_path / "b.txt").write_text("".join(x[::-1] + "\n" for x in lines))
        both = files.zipped_lines(spark, str(tmp_path / "a"), str(tmp_path / "b.txt")).collect()
        assert len(both) == 5000 and all(r["left"] == r["right"][::-1] for r in both)
        (tmp_path / "c.txt").write_text("one\n")
        with pytest.raises(ValueError, match="5000 and 1 lines"):
            files.zipped_lines(spark, str(tmp_path / "a"), str(tmp_path / "c.txt"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_token_ranges_of_texts_order_a_row_per_block(spark, tmp_path, monkeypatch):
    """Texts over several blocks and runs of spaces, against the SQL; what goes through the orders are rows of blocks."""
    texts = ["a bb  ccc " * 1500, " ", "x" * 50, "w " * 1023 + "last", "w " * 1024, " " * 2050, None, "one two"]
    pd.DataFrame({"doc_id": [i * 101 + 7 for i in range(len(texts))], "text": texts}).to_parquet(tmp_path / "documents.parquet")
    c, written, kept = duckdb.connect(), [], ordered.kept
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")

    def counted(df, name):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(ordered, "kept", counted)
    got = catalog.QUERIES["t33_j11_w06_token_ranges"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    want = c.sql(catalog.ORACLES["t33_j11_w06_token_ranges"] + " ORDER BY doc_id").df()
    assert got[["doc_id", "a", "b"]].to_numpy().tolist() == want[["doc_id", "a", "b"]].to_numpy().tolist()
    assert 0 < sum(written) <= 6 * len(texts)


@pytest.mark.parametrize("often", [False, True])
def test_token_ranges_of_odd_documents(spark, tmp_path, monkeypatch, often):
    """Empty and null texts, null and repeated doc_ids, with few repeated ids and with many, against the SQL."""
    monkeypatch.setattr(ordered, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(1, ""), (2, None), (None, "a b c"), (None, ""), (None, None), (-7, "one two three four five six seven"), (8, " "), (9, ""), (9, "x y z x y z x y z"), (10, None), (10, "x y z x y z x y z")]
    rows += [(11, ""), (11, ""), (12, None), (12, None), (13, ""), (13, None), (14, "a b c d e f g h"), (14, "a b c d e f g h"), (15, "aaa bbb"), (15, "c d e f g h i j k l m n o p q r s t u v"), (16, "x" * 40)]
    texts = lambda: "".join(rng.choice(["a", "bb", "é", " ", "  "]) for _ in range(rng.choice([1, 5, 40, 300])))
    rows += [(100 + (i // 3 if often else i), texts()) for i in range(90)] + [(105, texts()), (105, None)]
    pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]}).to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = catalog.QUERIES["t33_j11_w06_token_ranges"](spark, str(tmp_path)).select("doc_id", "a", "b").collect()
    want = c.sql("SELECT doc_id, a, b FROM (" + catalog.ORACLES["t33_j11_w06_token_ranges"] + ") ORDER BY doc_id").fetchall()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0] is not None and r[0]) == want
    assert (1, None, None) in want and len(want) == len({i for i, t in rows if i is not None and t is not None})
