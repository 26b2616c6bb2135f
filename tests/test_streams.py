"""Streams in several batches with restarts, broken batches, and segmenters in tiers."""

import json

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from candor import catalog
from candor.functions import text as T
from candor.operators import segmenters
from candor.plans.stream_queries import BEGIN
from candor.streaming import risk_history, score_log

DATA = "/root/testdata/sf0.001"


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "label", "risk", "at"]).astype({"conv_id": "Int64", "turn": "Int64", "risk": "Int64"})
    frame["at"] = pd.to_datetime(frame["at"] + BEGIN, unit="s", utc=True).astype("datetime64[us, UTC]")
    frame.to_parquet(path / name)


def go(spark, tmp_path, **options):
    rows = spark.readStream.schema(risk_history.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = risk_history.history(rows, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
    stream.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def test_history_goes_on_after_a_restart(spark, tmp_path):
    put(tmp_path / "in", "a", [(1, 1, "assistant", "", 500_000, 60), (1, 0, "user", "q0", None, 0), (2, 0, "assistant", "", None, 0)])
    first = go(spark, tmp_path)
    assert first == [(1, 1, 1, "q0", 500_000, 500_000.0, 500_000, False), (2, 0, 1, None, None, None, None, False)]
    put(tmp_path / "in", "b", [(1, 3, "assistant", "", 100_000, 180), (1, 2, "user", "q2", None, 120), (1, 3, "assistant", "", 200_000, 180)])
    second = go(spark, tmp_path)
    assert second[1:3] == [(1, 3, 2, "q2", 100_000, 300_000.0, 500_000, False), (1, 3, 3, "q2", 200_000, 800_000 / 3, 500_000, False)]
    assert go(spark, tmp_path) == second  # nothing new, nothing twice


def test_turns_that_come_late_are_marked_or_dropped(spark, tmp_path):
    put(tmp_path / "in", "a", [(1, 5, "assistant", "", 4, 600)])
    go(spark, tmp_path, late="5 minutes")
    put(tmp_path / "in", "b", [(1, 4, "assistant", "", 2, 500), (1, 3, "assistant", "", 9, 100), (None, None, "assistant", "", 7, 600)])  # 100 lies behind the watermark of 300
    got = go(spark, tmp_path, late="5 minutes")
    assert (1, 4, 2, None, 2, 3.0, 4, True) in got and (None, None, 1, None, 7, 7.0, 7, False) in got and len(got) == 3


def test_idle_conversations_are_forgotten(spark, tmp_path):
    put(tmp_path / "in", "a", [(1, 1, "assistant", "", 4, 60), (2, 1, "assistant", "", 4, 60)])
    go(spark, tmp_path, late="1 minute", idle=600)
    put(tmp_path / "in", "b", [(2, 2, "assistant", "", 6, 500)])
    go(spark, tmp_path, late="1 minute", idle=600)
    put(tmp_path / "in", "c", [(3, 1, "assistant", "", 4, 960)])  # watermark 900: the first one's time is over
    go(spark, tmp_path, late="1 minute", idle=600)
    put(tmp_path / "in", "d", [(1, 2, "assistant", "", 8, 1000), (2, 3, "assistant", "", 8, 1000)])
    got = go(spark, tmp_path, late="1 minute", idle=600)
    assert (1, 2, 1, None, 8, 8.0, 8, False) in got and (2, 3, 3, None, 8, 6.0, 8, False) in got and len(got) == 6


def test_empty_stream(spark, tmp_path):
    put(tmp_path / "in", "a", [])
    assert go(spark, tmp_path) == []


def record(i):
    return json.dumps({"question": f"q{i}", "answer": "a"}) + "\n"


def test_a_broken_batch_leaves_the_stream_alive(spark, tmp_path):
    source, log, failed = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "failed")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(record(i))
    schema = "question string, answer string"
    rows = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    made = lambda batch: batch.select(F.lit("2024-05-01 12:00:00").alias("ts"), F.when(F.col("question") == "q1", F.raise_error(F.lit("broken"))).otherwise(F.col("question")).alias("question"), "answer")
    q = score_log.write_log(rows(), log, failed, str(tmp_path / "ck"), made)
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(r["question"] for r in score_log.read(spark, log).collect()) == ["q0", "q2"]
    assert [r["question"] for r in spark.read.schema(schema).json(failed).collect()] == ["q1"]
    score_log.write_log(rows(), log, failed, str(tmp_path / "ck2")).awaitTermination(120)  # again from the start, now whole
    assert sorted(r["question"] for r in score_log.read(spark, log).collect()) == ["q0", "q1", "q2"]
    assert not list((tmp_path / "failed").glob("batch=*/*.json"))


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    write = score_log.batch_writer(str(tmp_path / "log"), str(tmp_path / "failed"), lambda b: b)
    batch = spark.createDataFrame([("q", "a"), ("q", "a")], "question string, answer string")
    for n in (0, 0, 1):
        write(batch, n)
    assert score_log.read(spark, str(tmp_path / "log")).count() == 4


def test_logging_never_raises(spark, tmp_path):
    df = spark.createDataFrame([("q",)], "question string")
    (tmp_path / "file").write_text("no folder")
    assert score_log.logged(df, str(tmp_path / "log")) and not score_log.logged(df, str(tmp_path / "file" / "log"))
    assert not score_log.logged(df.select(F.raise_error(F.lit("broken")).alias("question")), str(tmp_path / "log"))
    assert score_log.read(spark, str(tmp_path / "log")).count() == 1


def stops():
    def split(text):
        if "fail" in text:
            raise RuntimeError("no")
        return ["altered"] if "alter" in text else [x + "." for x in text.split(".") if x.strip()]

    return split


def absent():
    raise ImportError("not here")


def test_segmenter_tiers(spark):
    texts = ["One a. two b.  Three c.\n\n- a bullet. whole\n- more.", "It may fail. It has pattern sentences.", "They alter. All of it.", "same. same. same.", "", None]
    df = spark.createDataFrame([Row(k=i, t=t) for i, t in enumerate(texts)], "k int, t string")
    pattern = df.select("k", F.posexplode(T.sentences(F.col("t"))).alias("n", "s")).select("k", "n", "s.*")
    want = {tuple(r) for r in pattern.collect()}
    assert {tuple(r) for r in segmenters.segmented(df, "t", "k", [("no", absent)]).collect()} == want
    got = {tuple(r) for r in segmenters.segmented(df, "t", "k", [("no", absent), ("stops", stops), ("never", absent)]).collect()}
    assert {r for r in got if r[0] in (1, 2)} == {r for r in want if r[0] in (1, 2)}  # failures have the pattern tier
    assert sorted((r[1:4] + r[5:]) for r in got if r[0] == 0) == [(0, "One a.", 0, "stops"), (1, "two b.", 7, "stops"), (2, "Three c.", 15, "stops"), (3, "- a bullet. whole", 25, "bullet"), (4, "- more.", 43, "bullet")]
    assert sorted(r[3] for r in got if r[0] == 3) == [0, 6, 12] and not any(r[0] > 3 for r in got)
    assert all(texts[r[0]][r[3] : r[4]] == r[2] for r in got)


def test_table_function_in_sql(spark):
    segmenters.register(spark, [("stops", stops)], "my_segments")
    segmenters.with_blocks(spark.createDataFrame([(1, "a. b.")], "k int, t string"), "t").createOrReplaceTempView("segmenter_texts")
    got = spark.sql("SELECT k, s.sentence FROM segmenter_texts, LATERAL my_segments(blocks, pattern) s ORDER BY n").collect()
    assert [tuple(r) for r in got] == [(1, "a."), (1, "b.")]


@pytest.mark.skipif(segmenters.loaded(segmenters.TIERS) is not None, reason="a segmenter is installed")
def test_without_segmenters_sentences_are_those_of_the_patterns(spark):
    a, b = (catalog.QUERIES[q](spark, DATA) for q in ("t06_w08_segmenter_tiers", "t03_t07_sentences"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
