"""Question-answer sources, brought to (question, refs), and their slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators.splits import first_per, page, shuffle_key

# How many rows are read of a source whose rows repeat, for n questions from an offset.
SCAN_FACTOR, SCAN_EXTRA = 3, 3000
# End of fixed values.


def _present(refs: Column) -> Column:
    return F.filter(refs, lambda r: r.isNotNull() & (r != ""))


def truthfulqa(df: DataFrame) -> DataFrame:
    """Correct answers, then the best one; repeated answers stay."""
    return df.select("question", F.concat("correct_answers", F.array("best_answer")).alias("refs"))


def triviaqa(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """The first row of each question_id, by position; for a page, of the first SCAN_FACTOR * (offset + n) + SCAN_EXTRA rows."""
    rows = df if n is None else df.orderBy("pos").limit(SCAN_FACTOR * (offset + n) + SCAN_EXTRA)
    once = first_per(rows, "question_id", ["pos"], 1)
    return once.select("question", _present(F.concat("aliases", F.array("value"))).alias("refs"), "pos")


def nq_open(df: DataFrame) -> DataFrame:
    return df.select("question", F.col("answer").alias("refs"))


def web_questions(df: DataFrame) -> DataFrame:
    return df.select("question", F.col("answers").alias("refs"))


def squad(df: DataFrame) -> DataFrame:
    return df.select("question", F.array_distinct("answers.text").alias("refs"))


def hotpotqa(df: DataFrame) -> DataFrame:
    return df.select("question", F.array("answer").alias("refs"))


def popqa(df: DataFrame) -> DataFrame:
    """Possible answers as a JSON text; in a seeded order."""
    return df.select("question", F.from_json("possible_answers", "array<string>").alias("refs"), shuffle_key(F.col("question"), 42).alias("pos"))


def sciq(df: DataFrame) -> DataFrame:
    return df.select("question", F.array("correct_answer").alias("refs"), shuffle_key(F.col("question"), 42).alias("pos"))


def tydiqa(df: DataFrame) -> DataFrame:
    return df.where(F.contains("id", F.lit("english"))).select("question", F.array_distinct("answers.text").alias("refs"))


def halueval_dialogue(df: DataFrame) -> DataFrame:
    """Knowledge and dialogue history as the question."""
    return df.select(F.concat_ws(" ", "knowledge", "dialogue_history").alias("question"), F.array("right_response").alias("refs"))


def halueval_qa(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(" ", "knowledge", "question").alias("question"), F.array("right_answer").alias("refs"))


def halueval_summarization(df: DataFrame) -> DataFrame:
    return df.select(F.col("document").alias("question"), F.array("right_summary").alias("refs"))


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (truthfulqa, triviaqa, nq_open, web_questions, squad, hotpotqa, popqa, sciq, tydiqa, halueval_dialogue, halueval_qa, halueval_summarization)}


def load(df: DataFrame, name: str, n: int | None = None, offset: int = 0) -> DataFrame:
    """Rows [offset, offset + n) of a source, in the source's own order (`pos`: its position or a seeded shuffle), else by question."""
    if name not in LOADERS:
        raise ValueError(f"unknown source {name!r}")
    rows = triviaqa(df, n, offset) if name == "triviaqa" else LOADERS[name](df)
    order = ["pos", "question"] if "pos" in rows.columns else ["question"]
    return page(rows, order, n, offset).select("question", "refs")


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several configurations that can be read."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except Exception as e:  # noqa: BLE001 - any missing or unreadable path goes on to the next
            last = e
    raise RuntimeError(f"none of {paths} can be read") from last


def coqa(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, turn, context (the story and the talk before), question and answers of every turn. lines: a JSON object a line, not a file."""
    from pyspark.sql import Window

    schema = "data array<struct<id:string,story:string,questions:array<struct<input_text:string>>,answers:array<struct<input_text:string>>,additional_answers:map<string,array<struct<input_text:string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.inline("data"))
    turns = rows.select("id", "story", F.posexplode(F.arrays_zip(F.col("questions.input_text").alias("question"), F.col("answers.input_text").alias("answer"))).alias("turn", "qa"), "additional_answers")
    more = F.transform(F.map_values("additional_answers"), lambda a: F.get(a, F.col("turn"))["input_text"])
    said = F.concat(F.lit(" Q: "), "qa.question", F.lit(" A: "), "qa.answer", F.when(F.endswith(F.col("qa.answer"), F.lit(".")), "").otherwise("."))
    w = Window.partitionBy("id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("said", said)
    return turns.select("id", "turn", F.concat("story", F.array_join(F.collect_list("said").over(w), "")).alias("context"), "qa.question", F.concat(F.array("qa.answer"), F.coalesce(more, F.array().cast("array<string>"))).alias("answers"))


def articles(df: DataFrame, n: int, least: int = 400, most: int = 6000, seed: int = 0) -> DataFrame:
    """Long enough articles in a seeded order: title, prompt and cut evidence."""
    rows = df.where(F.length("text") >= least).orderBy(shuffle_key(F.col("title"), seed)).limit(n)
    return rows.select("title", F.format_string("Tell me about %s.", "title").alias("prompt"), F.substring("text", 1, most).alias("evidence"))
