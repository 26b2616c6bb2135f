"""The log of scored answers: one JSON object per answer, appended to, and read as a table or a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candor.functions.scores import tier

SENTENCE = "struct<sentence:string,is_claim:boolean,fused:double,tier:string,sep_entropy:double,sep_accuracy:double,hallushift:double,tsv_margin:double>"
AGGREGATE = "struct<fused:double,tier:string,label:string,sep_entropy:double,hallushift:double,tsv_margin:double,n_flagged:int,n_sentences:int>"
SCHEMA = f"ts string, model string, question string, answer string, aggregate {AGGREGATE}, sentences array<{SENTENCE}>"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def logged(df: DataFrame, path: str) -> bool:
    """Appends df's rows to the log where that works. Answering must not end because logging fails: a failure is a warning
    and False."""
    try:
        append(df, path)
    except Exception as e:  # noqa: BLE001 - whatever fails, the caller goes on
        logging.getLogger(__name__).warning("not logged: %s", e)
        return False
    return True


def batch_writer(path: str, failed: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What a stream calls with each micro-batch: make(batch), the log's rows, goes to the batch's own folder, which a replay of the same batch
    writes over, so that it adds nothing. A batch that fails goes as it came to its folder in `failed`, and the stream lives; a later replay that works
    takes it out of there. Only where `failed` can't be written either, the stream ends, as the batch would be lost."""

    def write(batch: DataFrame, n: int) -> None:
        aside = f"{failed}/batch={n}"
        try:
            make(batch).write.mode("overwrite").json(f"{path}/batch={n}")
        except Exception as e:  # noqa: BLE001 - as logged
            logging.getLogger(__name__).warning("batch %d not logged: %s", n, e)
            batch.write.mode("overwrite").json(aside)
            return
        at = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
        at.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return write


def write_log(rows: DataFrame, path: str, failed: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Logs a stream of what is there now and ends; started again with the same checkpoint, it goes on where it ended."""
    return rows.writeStream.foreachBatch(batch_writer(path, failed, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines make no rows; ts becomes a timestamp. Folders of batches are read as one log."""
    return spark.read.schema(SCHEMA).json(path).drop("batch").withColumn("at", F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss"))


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path).withColumn("at", F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss"))


def claims(log: DataFrame) -> DataFrame:
    """A row per scored claim."""
    return log.select(*(c for c in log.columns if c != "sentences"), F.explode("sentences").alias("s")).where("s.is_claim and s.fused is not null")


def tiered(log: DataFrame, medium: float, high: float) -> DataFrame:
    """Headline and tier of each record from its own sentences: no state, so a stream can append."""
    scored = F.sort_array(F.transform(F.filter("sentences", lambda s: s["is_claim"] & s["fused"].isNotNull()), lambda s: s["fused"]), asc=False)
    fused = F.coalesce(F.get(scored, F.lit(1)), F.get(scored, F.lit(0)))
    return log.withColumn("fused", fused).withColumn("tier", tier(F.col("fused"), medium, high))


def windowed(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Our extension: answers and flagged answers by model and hour, with late records up to `late`; log is one that `tiered` has gone
    over."""
    rows = log.withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "model").agg(F.count("*").alias("answers"), F.count_if(F.col("tier").isin("high", "medium")).alias("flagged"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def respond(spark: SparkSession, requests: str, responses: str, checkpoint: str, answer) -> None:
    """Answers the request files that are there and ends: a micro-batch from JSON (question, text) to JSON. answer: a function of the
    request table. A file is answered once, as the checkpoint remembers it."""
    rows = spark.readStream.schema("question string, text string").json(requests)
    write_stream(answer(rows), responses, checkpoint).awaitTermination()
