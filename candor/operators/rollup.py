"""Roll-ups of sentence scores to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scores import highlight_alpha, sep_confidence, tier, tier_label


def headline(df: DataFrame, key: str, medium: Column | float, high: Column | float) -> DataFrame:
    """Per answer, over its claims (fused not null): fused, the second-largest (the only one, if single), the means of
    the detectors (0 without claims), n_flagged, and n_sentences with fillers."""
    claim = F.col("fused").isNotNull()
    top = F.sort_array(F.collect_list("fused"), asc=False)  # as many as the answer has sentences
    mean = lambda c: F.coalesce(F.avg(F.when(claim, F.col(c))), F.lit(0.0)).alias(c)
    out = df.groupBy(key).agg(F.coalesce(F.get(top, F.lit(1)), F.get(top, F.lit(0))).alias("fused"), mean("sep_entropy"), mean("hallushift"), mean("tsv_margin"), F.count_if(F.col("tier") == "high").alias("n_flagged"), F.count("*").alias("n_sentences"))
    t = tier(F.col("fused"), medium, high)
    return out.withColumns({"tier": t, "label": tier_label(t)})


def whole_answer(df: DataFrame, key: str, fused: str, medium: float, high: float) -> DataFrame:
    """The older form: the answer's own score, and how many sentences are flagged."""
    out = df.groupBy(key).agg(F.max(fused).alias("fused"), F.count_if(F.col("tier") == "high").alias("n_flagged"), F.count("*").alias("n_sentences"))
    return out.withColumn("tier", tier(F.col("fused"), medium, high))


def confidence(df: DataFrame, key: str) -> DataFrame:
    """Mean of (accuracy + 1 - entropy) / 2 over claims, 1 without claims; a single claim counts with the answer's own scores
    (columns answer_entropy, answer_accuracy)."""
    claim = F.col("is_claim")
    one = F.count_if(claim) == 1
    each = F.avg(F.when(claim, sep_confidence(F.col("sep_entropy"), F.col("sep_accuracy"))))
    own = F.first(sep_confidence(F.col("answer_entropy"), F.col("answer_accuracy")))
    return df.groupBy(key).agg(F.coalesce(F.when(one, own).otherwise(each), F.lit(1.0)).alias("confidence"), F.count_if(claim).alias("n_claims"))


def relative(df: DataFrame, key: str) -> DataFrame:
    """Opacity by the score relative to the answer's largest."""
    most = F.max("fused").over(Window.partitionBy(key))
    return df.withColumn("alpha", highlight_alpha(F.col("fused"), most, F.col("tier")))


def series(df: DataFrame, key: str, turn: str) -> DataFrame:
    """Turns with a risk, numbered from 1 as Q1, Q2, ..."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(turn))
    return df.where("risk is not null").withColumn("label", F.concat(F.lit("Q"), n))
