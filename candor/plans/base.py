"""What the registered queries share: tables, surrogate detector scores, and the SQL that says the same for DuckDB.

The scores stand in for a model's: they are plain features of the text, deterministic, and say nothing about the quality
of any detector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.scores import MODELS

DETECTORS = ["sep_entropy", "hallushift", "tsv_margin"]

ENGLISH = [
    "Sure!", "Of course.", "Let me explain the process in detail.", "Here's what you need to know.", "In summary, it works well.",
    "However,", "For example:", "Please note the opening hours.", "I hope this answers it.", "As I mentioned, it was late.",
    "Feel free to ask again.", "I'll write a brief note.", "Below are the main points.", "This is a good example.",
    "Results may vary between people.", "Albert Einstein may vary his view.", "Consult a doctor first please.", "In my opinion the film is fine.",
    "It's hard to say what happened.", "There's no simple way out.", "I could not find any record of that.", "I don't know the answer to this.",
    "I'm not sure about the date.", "I am sorry, but I cannot help.", "There is no information on this topic.", "It is possible that the name is misspelled.",
    "Please provide more context first.", "This seems to be a fictional character.", "Key points to remember:", "What is the capital of France?",
    "Hello my friend.", "Dear all of you people in the house.", "Paris is the capital of France.", "The tower is 330 m high.", "Water boils at 100 degrees.",
    "It costs $3.50 today.", "About 5 people came.", "42", "No way.", "He lived in New York City.", "", "The river flows roughly south.",
]

REPLIES = ["CORRECT", "INCORRECT", "The answer is correct.", "That is not right.", "yes", "No.", "Yes, it is supported.", "no, it is not", "maybe", "", "It is accurate", "YES it says no", "This is wrong", "true"]

QA = [
    ("What is the capital of France?", "The capital is Paris.", ["Paris", "City of Paris"]),
    ("Who wrote Hamlet?", "It was written by W. Shakespeare", ["William Shakespeare", "Shakespeare"]),
    ("When was it?", "In 1969", ["1970"]),
    ("What is the capital of France??", "Lyon", ["Paris, France"]),
    ("Where?", "", ["the Sea"]),
    ("Which sea?", "The sea!", ["a Sea", ""]),
    ("No refs?", "Nothing", []),
]

SPANS = [
    ("Paris is the capital of France.", "Paris", "Paris"), ("Paris is the capital of France.", "paris", '"Paris"'), ("Paris is the capital of France.", "France", "Paris."),
    ("Paris is the capital of France.", "the capital of France", "NONE"), ("Paris is the capital of France.", "London", ""), ("Paris is the capital of France.", "", "The city of Paris"),
    ("Paris  is here", "Paris is", "here."),
]


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        if isinstance(v, str):
            return sql_text(v)
        if isinstance(v, list):
            return "CAST([" + ", ".join(map(one, v)) + "] AS VARCHAR[])"
        return "NULL" if v is None else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(x: Column) -> Column:
    return F.floor(x * 1000000) / 1000000


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, n (characters) and the three surrogate scores."""
    words = F.split("text", " ")
    n = F.length("text")
    return docs.where("text <> ''").select(
        "doc_id",
        "source",
        "lang",
        n.cast("bigint").alias("n"),
        cut(F.size(F.array_distinct(words)) / F.size(words)).alias("sep_entropy"),
        cut((n - F.length(F.replace(F.col("text"), F.lit("e"), F.lit("")))) / n).alias("hallushift"),
        cut(F.lit(0.5) - n / (n + 2000)).alias("tsv_margin"),
    )


SCORES = """scores AS (
    SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS n,
        floor(CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) / len(string_split(text, ' ')) * 1000000) / 1000000 AS sep_entropy,
        floor(CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) / length(text) * 1000000) / 1000000 AS hallushift,
        floor((0.5::DOUBLE - CAST(length(text) AS DOUBLE) / (length(text) + 2000)) * 1000000) / 1000000 AS tsv_margin
    FROM documents WHERE text <> '')"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with y: 1 where the document's quality is 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("y"), "toxic")
    return scores(table(spark, sf_dir, "documents")).join(labels, "doc_id")


LABELLED = SCORES + ", labelled AS (SELECT s.*, 1 - l.quality AS y, l.toxic FROM scores s JOIN labels l USING (doc_id))"


def long(df: DataFrame) -> DataFrame:
    """A row per detector: detector, doc_id, source, y, s."""
    return df.unpivot(["doc_id", "source", "n", "y"], DETECTORS, "detector", "s")


LONG = LABELLED + ", long AS (" + " UNION ALL ".join(f"SELECT '{d}' AS detector, doc_id, source, n, y, {d} AS s FROM labelled" for d in DETECTORS) + ")"


def fused_sql(tag: str) -> str:
    names, mean, scale, coef, intercept = MODELS[tag]
    z = f"CAST({intercept} AS DOUBLE)" + "".join(f" + ({n} - ({m})::DOUBLE) / ({s})::DOUBLE * ({c})::DOUBLE" for n, m, s, c in zip(names, mean, scale, coef, strict=True))
    return f"1 / (1 + exp(-({z})))"


def r6(*columns: str) -> list[Column]:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


#: Added before rounding where inputs have six digits, so that means don't end in exact halves, which engines round apart.
TIE = 1e-10


def r6_tied(*columns: str) -> list[Column]:
    return [F.round(F.col(c) + TIE, 6).alias(c) for c in columns]
