import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.operators import fitting, labels, metrics, rollup, splits
from candor.sources import files, qa
from candor.streaming import score_log


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "a" if i % 3 else "b", int(y), float(s)) for i, (y, s) in enumerate(zip(rng.integers(0, 2, 120), rng.integers(0, 25, 120) / 25, strict=True))]
    return rows, spark.createDataFrame(rows, "id long, k string, y int, s double").cache()


def pairs_won(rows):
    pos, neg = [s for _, _, y, s in rows if y], [s for _, _, y, s in rows if not y]
    return np.mean([(p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)])


def test_auroc_is_the_share_of_pairs_won(scored):
    rows, df = scored
    got = {r["k"]: r["auroc"] for r in metrics.auroc(df, ["k"]).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(pairs_won([r for r in rows if r[1] == k]))
    flipped = {r["k"]: r["auroc"] for r in metrics.auroc(df.withColumn("s", -F.col("s")), ["k"]).collect()}
    assert all(flipped[k] == pytest.approx(1 - got[k]) for k in "ab")
    assert metrics.auroc(df.where("y = 1"), ["k"]).first()["auroc"] is None


def test_average_precision_and_threshold(scored):
    rows, df = scored
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    ap = last = 0.0
    best = (-1.0, 0.0)
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = (hit & (y == 1)).sum() / y.sum(), (hit & (y == 1)).sum() / hit.sum()
        ap, last = ap + (recall - last) * precision, recall
        best = max(best, (round(2 * precision * recall / (precision + recall), 12) if recall else 0.0, -t))
    one = df.withColumn("k", F.lit(0))
    assert metrics.average_precision(one, ["k"]).first()["ap"] == pytest.approx(ap)
    assert metrics.best_threshold(one, ["k"]).first()["threshold"] == pytest.approx(-best[1])


def test_bootstrap_is_repeatable(scored):
    _, df = scored
    a, b = (sorted(r["auroc"] for r in metrics.bootstrap(df, 20, "id").collect()) for _ in range(2))
    assert a == b and len(a) == 20 and len(set(a)) > 10


def test_rank_mean_needs_two_rows(scored, spark):
    with pytest.raises(ValueError):
        metrics.rank_mean(spark.createDataFrame([(1, 0.5)], "id long, s double"), ["s"], "id", "f")


def test_headline_is_the_second_largest(spark):
    rows = [(1, 0.9, "high"), (1, 0.5, "medium"), (1, None, "filler"), (2, 0.3, "ok"), (3, None, "filler")]
    df = spark.createDataFrame(rows, "k int, fused double, tier string").withColumns({c: F.lit(0.5) for c in ("sep_entropy", "hallushift", "tsv_margin")})
    got = {r["k"]: (r["fused"], r["tier"], r["n_flagged"], r["n_sentences"], r["sep_entropy"]) for r in rollup.headline(df, "k", 0.5, 0.74).collect()}
    assert got == {1: (0.5, "medium", 1, 3, 0.5), 2: (0.3, "ok", 0, 1, 0.5), 3: (None, "filler", 0, 1, 0.0)}


def test_splits_hold_shares_and_groups(spark):
    df = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 10).alias("g"))
    s = splits.stratified(df, "y", "id", 0.25)
    assert {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()} == {(0, "test"): 38, (0, "train"): 112, (1, "test"): 13, (1, "train"): 37}
    assert splits.grouped(df, "g", 0.5).groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.confident(df, "y", "id", {1: 0.9, 0: 0.1}, 100, "id").count() == 100  # a class is short


def test_labels(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0.9, 0.1), (3, 0.1, 0.9), (4, 0.1, 0.1)], "k int, entail double, contradict double")
    assert {r["k"]: r["label"] for r in labels.evidence_labels(df, "k", "confident").collect()} == {1: -1, 2: 0, 3: 1, 4: -1}
    assert {r["k"]: r["label"] for r in labels.evidence_labels(df, "k").collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    with pytest.raises(ValueError):
        labels.check(df.withColumn("label", F.lit(1)), "label")


def test_fusion_learns_and_is_kept(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int").withColumn("dead", F.lit(1.0))
    model = fitting.fusion(df, ["a", "b", "dead"], "y")
    assert model.scale[2] == 1 and model.coef[0] > 5 * abs(model.coef[1])
    assert fitting.Fusion.read(model.frame(spark)) == model
    oof = fitting.out_of_fold(df, ["a", "b"], "y", "id")
    assert oof.count() == 300 and metrics.auroc(oof.select(F.lit(0).alias("k"), "y", F.col("fused").alias("s")), ["k"]).first()["auroc"] > 0.95
    medium, high = fitting.calibrated(oof, "y", "fused")
    assert medium == pytest.approx(0.6 * high, abs=6e-4)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("q1", "x", 1, ["a", "", "b"], "c"), ("q1", "y", 2, [], "d"), ("q2", "z", 3, ["e"], "")], "question_id string, question string, pos int, aliases array<string>, value string")
    assert [(r["question"], r["refs"]) for r in qa.load(df, "triviaqa").collect()] == [("x", ["a", "b", "c"]), ("z", ["e"])]
    assert qa.load(df, "triviaqa", 1, 1).first()["question"] == "z"
    with pytest.raises(ValueError):
        qa.load(df, "nothing")
    talk = {"data": [{"id": "1", "story": "S.", "questions": [{"input_text": "q0"}, {"input_text": "q1"}], "answers": [{"input_text": "a0"}, {"input_text": "a1."}], "additional_answers": {"0": [{"input_text": "b0"}, {"input_text": "b1"}]}}]}
    (tmp_path / "c.json").write_text(json.dumps(talk))
    got = qa.coqa(spark, str(tmp_path / "c.json")).orderBy("turn").collect()
    assert [r["context"] for r in got] == ["S.", "S. Q: q0 A: a0."] and got[1]["answers"] == ["a1.", "b1"]
    with pytest.raises(RuntimeError):
        qa.read_first(spark, str(tmp_path / "no1"), str(tmp_path / "no2"))


def test_files(spark, tmp_path):
    p = str(tmp_path / "t")
    assert files.thresholds(spark, p) == (0.5, 0.74)
    files.write_thresholds(spark, p, 0.2, 0.4)
    assert files.thresholds(spark, p) == (0.2, 0.4)
    df = spark.createDataFrame([(1, "a\nb")], "k int, t string")
    files.write_lines(df, "t", str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "a b"
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["t"] == "a\nb"
    files.write_sheet(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "c")).columns == ["k", "t"]
    with pytest.raises(ValueError):
        files.with_features(df, spark.createDataFrame([(2, [0.5])], "k int, v array<double>"), "k")
    assert files.scored_by(df, lambda b: b["k"] * 2.0, "s").first()["s"] == 2.0


def test_score_log_batch_and_stream(spark, tmp_path):
    record = {"ts": "2024-01-02 03:04:05", "model": "m", "question": "q", "answer": "a", "aggregate": {"fused": 0.5}, "sentences": [{"sentence": "x", "is_claim": True, "fused": 0.9}, {"sentence": "y", "is_claim": True, "fused": 0.3}, {"sentence": "z", "is_claim": False}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(record) + "\n\n" + json.dumps(record | {"sentences": []}) + "\n")
    log = score_log.read(spark, str(tmp_path / "in"))
    assert log.count() == 2 and score_log.claims(log).count() == 2
    assert sorted(str(r["tier"]) for r in score_log.tiered(log, 0.2, 0.5).collect()) == ["filler", "medium"]
    q = score_log.write_stream(score_log.tiered(score_log.stream(spark, str(tmp_path / "in")), 0.2, 0.5).select("model", "fused", "tier"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    wide = score_log.windowed(score_log.tiered(log, 0.2, 0.5))
    assert [(r["answers"], r["flagged"]) for r in wide.collect()] == [(2, 1)]


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 89, 90, 91, 160, 161, 300):
        words = [f"w{i}" for i in range(n)]
        got = spark.createDataFrame([(" ".join(words),)], "t string").select(T.chunks(F.col("t")).alias("c")).first()["c"]
        want, s = [], 0
        while s < n:
            want.append(" ".join(words[s : s + 90]))
            if s + 90 >= n:
                break
            s += 70
        assert got == want
