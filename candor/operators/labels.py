"""Label construction from references, judges, and evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import text as T


# What judges are asked.
GROUNDED_PROMPT = 'Reference text:\n%s\n\nStatement: "%s"\n\nIs the statement supported by the reference text? Answer yes or no.'
QA_PROMPT = 'Question: %s\nKnown correct answer(s): %s\nModel\'s answer: "%s"\n\nIs the model\'s answer correct? Reply CORRECT or INCORRECT.'
NO_REFERENCE = "(no reference available)"
# End of fixed values.

#: Adds a column `reply` to rows with a column `prompt`: a model behind sources.files.scored_by, or an expression.
Judge = Callable[[DataFrame], DataFrame]


def grounded_judge(df: DataFrame, claim: str, source: str, judge: Judge) -> DataFrame:
    """df with evidence (the chunks of `source` that overlap most with the claim), prompt, reply, and label: 0 if the judge says yes."""
    rows = df.withColumn("evidence", T.evidence(T.best_chunks(F.col(claim), T.chunks(F.coalesce(F.col(source), F.lit(""))))))
    rows = judge(rows.withColumn("prompt", F.format_string(GROUNDED_PROMPT, "evidence", claim)))
    return rows.withColumn("label", T.grounded_verdict(F.col("reply")))


def qa_judge(df: DataFrame, question: str, claim: str, refs: str, judge: Judge) -> DataFrame:
    """df with prompt, reply, and label: 0 if the judge finds the claim correct, given question and references."""
    gold = T.gold_string(F.col(refs), NO_REFERENCE)
    rows = judge(df.withColumn("prompt", F.format_string(QA_PROMPT, question, gold, claim)))
    return rows.withColumn("label", T.verdict(F.col("reply")))


def by_source(df: DataFrame, claim: str, evidence_source: str, refs: str, judge: Judge) -> DataFrame:
    """Labels of raw claims: the grounded judge for the source `wiki`, references for all others."""
    wiki = grounded_judge(df.where("source = 'wiki'"), claim, evidence_source, judge).select(*df.columns, "label")
    others = df.where("source is null or source <> 'wiki'").withColumn("label", T.reference_label(F.col(claim), F.col(refs)))
    return wiki.unionByName(others)


def answer_pairs(df: DataFrame, key: str, answer: str, refs: DataFrame) -> DataFrame:
    """Rows (key, kind, ref, answer): each answer with each correct and incorrect reference of its key; rows without any have one row
    of nulls. refs: key, correct, incorrect."""
    tagged = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    rows = df.select(key, answer).join(refs, key, "left")
    return rows.select(key, answer, F.explode_outer(F.concat(tagged(F.col("correct"), "correct"), tagged(F.col("incorrect"), "incorrect"))).alias("x")).select(key, answer, "x.kind", "x.ref")


def last_by_key(df: DataFrame, key: Column, position: str) -> DataFrame:
    """One row per normalised key, the last."""
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc(position)))).where("_r = 1").drop("_r")


def with_references(df: DataFrame, question: str, refs: DataFrame, ref_question: str, position: str) -> DataFrame:
    """References by normalised question; the last of repeated keys, an empty list where there is none."""
    right = last_by_key(refs, T.norm(F.col(ref_question)), position).select("_key", F.col("refs"))
    out = df.withColumn("_key", T.norm(F.col(question))).join(right, "_key", "left").drop("_key")
    return out.withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def hybrid(claim: Column, refs: Column, judge: Column) -> Column:
    """(label, source): 0 by substring, else the judge, which can only rescue."""
    hit = T.reference_label(claim, refs) == 0
    return F.when(hit, F.struct(F.lit(0).alias("label"), F.lit("substring").alias("source"))).otherwise(F.struct(judge.cast("int").alias("label"), F.lit("judge").alias("source")))


def best_reference(df: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Largest score over the references of a row; 1 if it isn't above the threshold. No references: 0."""
    return df.groupBy(key).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("score")).withColumn("label", F.when(F.col("score") > threshold, 0).otherwise(1))


def evidence_labels(df: DataFrame, key: str, mode: str = "factscore", sure: float = 0.5) -> DataFrame:
    """From (key, entail, contradict) per evidence chunk (null: no evidence): 0 if a chunk entails the claim, else 1 if one
    contradicts it, else 1, or in the mode `confident` -1."""
    g = df.groupBy(key).agg(F.max("entail").alias("entail"), F.max("contradict").alias("contradict"))
    return g.withColumn("label", F.when(F.col("entail") >= sure, 0).when(F.col("contradict") >= sure, 1).otherwise(-1 if mode == "confident" else 1))


def comparative(df: DataFrame, key: str) -> DataFrame:
    """From (key, kind, score): 0 if the best correct reference beats the best incorrect one, else (also on ties) 1."""
    best = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(-1e9))
    return df.groupBy(key).agg(F.when(best("correct") > best("incorrect"), 0).otherwise(1).alias("label"))


def agreement(df: DataFrame, old: str, new: str) -> DataFrame:
    a, b = F.col(old), F.col(new)
    return df.agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agreement"), F.count_if((a == 1) & (b == 0)).alias("to_0"), F.count_if((a == 0) & (b == 1)).alias("to_1"))


def usable(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that have a label; evidence and references dropped."""
    return df.where(F.col(label) >= 0).drop("evidence", "refs")


def check(df: DataFrame, label: str, other: DataFrame | None = None) -> None:
    """Refuse what can't be trained on: no rows, a single class, or another table of another size."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if not n:
        raise ValueError("no rows left")
    if len(n) < 2:
        raise ValueError(f"a single class: {n}")
    if other is not None and other.count() != sum(n.values()):
        raise ValueError("the tables have different numbers of rows")
