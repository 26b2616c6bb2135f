"""Streams over the given tables: the log that never raises, risk histories of conversations; and segmenters in tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.operators import segmenters
from candor.plans.base import cut, table
from candor.plans.number_queries import TIERED, lines
from candor.sources import files
from candor.streaming import risk_history, score_log

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("t06_w08_segmenter_tiers")
def _(spark, d):
    """Sentences through the SQL table function, from the best segmenter that is installed; without one they are those of
    `t03_t07_sentences`, which the tests compare."""
    return segmenters.segmented(table(spark, d, "documents"), "text", "doc_id")


@query("s16_stream_log", f"WITH {TIERED} SELECT CAST(doc_id AS VARCHAR) AS question, round(fused, 6) AS fused, tier FROM h WHERE is_claim AND fused IS NOT NULL")
def _(spark, d):
    """Answers logged by a stream, batch by batch, and all of them a second time under the same numbers, which adds nothing."""
    one = F.struct(F.col("line").alias("sentence"), "is_claim", "fused", "tier", "sep_entropy", F.lit(None).cast("double").alias("sep_accuracy"), "hallushift", "tsv_margin")
    answers = lines(spark, d).groupBy("doc_id").agg(F.collect_list(one).alias("sentences"))
    given, log, failed, *seen = (files.scratch(spark, x) for x in ("answers", "log", "failed", "seen", "seen"))
    answers.select(F.col("doc_id").cast("string").alias("question"), "sentences").write.json(given)
    stamped = lambda batch: batch.select(F.lit("2024-05-01 12:00:00").alias("ts"), F.lit("8bv2").alias("model"), "question", F.lit("").alias("answer"), "sentences")
    for checkpoint in seen:
        rows = spark.readStream.schema(f"question string, sentences array<{score_log.SENTENCE}>").json(given)
        score_log.write_log(rows, log, failed, checkpoint, stamped).awaitTermination()
    return score_log.claims(score_log.read(spark, log)).select("question", F.round("s.fused", 6).alias("fused"), "s.tier")


#: 2024-05-01, in seconds: a stream's watermark begins at 0, and takes what isn't after it for late.
BEGIN = 1_714_521_600


def turns(rows: DataFrame) -> DataFrame:
    """The turns of `conversations` as the history takes them: a question's label, and the share of different words among an answer's
    as its risk; a minute from turn to turn."""
    words = F.split("text", " ")
    risk = F.when(F.col("text") != "", risk_history.millionths(cut(F.size(F.array_distinct(words)) / F.size(words))))
    return rows.select("conv_id", "turn", "role", T.short_label(F.col("text")).alias("label"), risk.alias("risk"), F.timestamp_seconds(F.col("turn") * 60 + BEGIN).alias("at"))


@query("d11_w09_risk_history", """WITH t AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 18 THEN substring(text, 1, 18) || '…' ELSE text END AS label
        , CASE WHEN text <> '' THEN CAST(floor(floor(CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) / len(string_split(text, ' ')) * 1000000) / 1000000 * 1000000) AS BIGINT) END AS r FROM conversations)
    , s AS (SELECT *, CASE WHEN role = 'assistant' THEN r END AS risk, last_value(CASE WHEN role = 'user' THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM t)
    , a AS (SELECT * FROM s WHERE role = 'assistant')
    SELECT conv_id, turn, row_number() OVER w AS n, question, risk, round(CAST(sum(risk) OVER w AS DOUBLE) / count(risk) OVER w, 3) AS mean, max(risk) OVER w AS peak FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as a stream, in one go; the tests take them in several, with a restart between."""
    given = table(spark, d, "conversations")
    out, seen, source = (files.scratch(spark, x) for x in ("history", "seen", "turns"))
    turns(given).write.parquet(source)
    rows = spark.readStream.schema(risk_history.SCHEMA).parquet(source)
    risk_history.history(rows).writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(risk_history.HISTORY).parquet(out).select("conv_id", "turn", "n", "question", "risk", F.round("mean", 3).alias("mean"), "peak")
