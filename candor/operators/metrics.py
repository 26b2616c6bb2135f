"""Ranking and classification metrics as grouped aggregates over (keys, y, s): y is 0 or 1 (1: hallucinated), s the score.

Rows are first counted by distinct score, so what is ordered is distinct. Running sums over an order are made in ranges of it, which
are written once; see `ordered`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.operators.ordered import running
from candor.sources.files import kept

#: Rows of a range of the bootstrap, about.
RANGE_ROWS = 200_000


def counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Positive and negative weight by distinct score."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, "s").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"))


def auroc(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties a half; null with a single class."""
    c = running(counts(df, keys, weight), keys, "s", ["neg"])
    won, pos, neg = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)), F.sum("pos"), F.sum("neg")
    return c.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auroc"))


def curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per distinct score as threshold: tp, fp, P, N, tpr, fpr, precision, recall."""
    c = running(counts(df, keys), keys, "s", ["pos", "neg"], descending=True).withColumnsRenamed({"all_pos": "P", "all_neg": "N"})
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return c.select(*keys, "s", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "P", "N", F.try_divide(tp, "P").alias("tpr"), F.try_divide(fp, "N").alias("fpr"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, "P").alias("recall"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct thresholds of the gain in recall times precision; null with a single class."""
    c = curve(df, keys)
    return c.groupBy(*keys).agg(F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(F.col("pos") * F.col("precision")) / F.first("P")).alias("ap"))


def trapezoid_pr(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under precision over recall by trapezoids, from recall 0 with precision 1. Not average precision."""
    c = curve(df, keys)
    recall_before = F.try_divide(F.col("tp") - F.col("pos"), "P")
    seen = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    before = F.when(seen > 0, (F.col("tp") - F.col("pos")) / seen).otherwise(1.0)
    return c.groupBy(*keys).agg(F.sum((F.col("recall") - recall_before) * (F.col("precision") + before) / 2).alias("pr_auc"))


def best_threshold(df: DataFrame, keys: list[str], objective: str = "f1") -> DataFrame:
    """Threshold with the largest F1 (or Youden's J); the lowest of equals. Candidates are the distinct scores, or 200
    interpolated quantiles of all scores if there are more. 0.5 with nothing to choose. A quantile lies between two scores of the
    curve, which give its counts, so the curve is gone through once."""
    c = curve(df, keys)
    c = kept(c, "curve")
    size = c.groupBy(*keys).agg(F.count("*").alias("d"))
    c = c.join(size.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)))
    few = c.where("d <= 200").select(*keys, F.col("s").alias("t"), "tp", "fp", "P", "N")
    steps, last = 199, F.col("P") + F.col("N") - 1  # quantile i is at place i * last / steps of the sorted scores
    before = F.col("P") + F.col("N") - F.col("tp") - F.col("fp")
    after = before + F.col("pos") + F.col("neg")
    nth = lambda place: F.ceil(F.greatest(place, F.lit(0)) * steps / last).cast("int")
    none = F.array().cast("array<int>")
    covered = lambda lo, hi: F.when(nth(hi) > nth(lo), F.sequence(nth(lo), F.least(nth(hi) - 1, F.lit(steps)))).otherwise(none)
    at = F.struct("s", "tp", "fp")
    reached = F.concat(F.transform(covered(before, F.when(after > last, after + last).otherwise(after)), lambda i: F.struct(i.alias("i"), at.alias("lo"), F.lit(None).cast("struct<s:double,tp:bigint,fp:bigint>").alias("hi"))), F.transform(covered(before - 1, after - 1), lambda i: F.struct(i.alias("i"), F.lit(None).cast("struct<s:double,tp:bigint,fp:bigint>").alias("lo"), at.alias("hi"))))
    many = c.where("d > 200").withColumns({"s": F.col("s").cast("double"), "tp": F.col("tp").cast("bigint"), "fp": F.col("fp").cast("bigint")}).select(*keys, "P", "N", F.inline(reached))
    many = many.groupBy(*keys, "i").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.first("P").alias("P"), F.first("N").alias("N"))
    place = F.col("i") * last / steps
    part = place - F.floor(place)
    t = F.when((part == 0) | F.col("hi").isNull(), F.col("lo.s")).otherwise(F.col("lo.s") * (1 - part) + F.col("hi.s") * part)
    many = many.withColumn("t", t).select(*keys, "t", *(F.when(F.col("t") <= F.col("lo.s"), F.col(f"lo.{x}")).otherwise(F.col(f"hi.{x}")).alias(x) for x in ("tp", "fp")), "P", "N")
    at = few.unionByName(many)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")), F.lit(0.0))
    youden = F.col("tp") / (F.col("P") + 1e-9) - F.col("fp") / (F.col("N") + 1e-9)
    score = f1 if objective == "f1" else youden
    return at.groupBy(*keys).agg(F.coalesce(F.max_by("t", F.struct(F.round(score, 12), -F.col("t"))), F.lit(0.5)).alias("threshold"), F.max(score).alias("objective"))


def confusion(df: DataFrame, keys: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """tn, fp, fn, tp with accuracy, precision, recall and f1 (0 where undefined)."""
    hit, y = F.col("s") >= threshold, F.col("y") == 1
    c = df.groupBy(*keys).agg(F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(hit & y).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def summary(df: DataFrame, keys: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """One row per detector, rounded to four digits."""
    out = auroc(df, keys).join(average_precision(df, keys), keys).join(confusion(df, keys, threshold), keys)
    return out.select(*keys, *(F.round(c, 4).alias(c) for c in ("auroc", "ap", "accuracy", "precision", "recall", "f1")))


def average_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with rank_<column> of each column: ties share their mean rank, from 1. All columns are ranked in one go."""
    base = kept(df, "unranked")
    values = base.unpivot(keys, columns, "_c", "_x").groupBy(*keys, "_c", "_x").agg(F.count("*").alias("_n"))
    ranks = running(values, [*keys, "_c"], "_x", ["_n"]).select(*keys, "_c", "_x", (F.col("cum__n") - (F.col("_n") - 1) / 2).alias("_rank"))
    ranks = kept(ranks, "ranks")
    for c in columns:
        base = base.join(ranks.where(F.col("_c") == c).select(*keys, F.col("_x").cast(base.schema[c].dataType).alias(c), F.col("_rank").alias(f"rank_{c}")), [*keys, c])
    return base


def pearson(a: str, b: str) -> Column:
    """Correlation; null where either doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    ranked = average_ranks(df.select(*keys, a, b), keys, [a, b])
    return ranked.groupBy(*keys).agg(pearson(f"rank_{a}", f"rank_{b}").alias("rho"))


def rank_mean(df: DataFrame, columns: list[str], tie: str, out: str) -> DataFrame:
    """Mean over columns of the ordinal rank over n - 1; ties in the order of `tie`. The columns are ranked in one go, by running
    counts in ranges of (value, tie)."""
    base = kept(df.withColumn("_id", F.monotonically_increasing_id()), "unranked")
    n = base.count()
    if n < 2:
        raise ValueError("rank fusion needs two rows at least")
    values = base.select("_id", F.struct(tie, "_id").alias("_t"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["_id", "_t"], columns, "_c", "_x")
    ranked = running(values.select("_id", "_c", F.struct("_x", "_t").alias("_o"), F.lit(1).alias("_one")), ["_c"], "_o", ["_one"])
    mean = ranked.groupBy("_id").agg((F.sum((F.col("cum__one") - 1) / (n - 1)) / len(columns)).alias(out))
    return base.join(mean, "_id").drop("_id")


# Cumulated probabilities of Poisson(1).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
# End of fixed values.


def bootstrap(df: DataFrame, replicates: int, row_id: str) -> DataFrame:
    """b, auroc of each replicate, rows weighted by Poisson(1) counts from a hash of row and replicate, so that every
    replicate is the same on every run; replicates with a single class are left out. Each range of scores (equal ones are in one) gives, for all replicates at
    once, the weights of both classes and the pairs won within it; only these sums are put together over the ranges."""
    rows = kept(df.select("s", "y", F.xxhash64(row_id).alias("h")), "replicated")
    parts = max(1, rows.count() // RANGE_ROWS + 1)
    rows = rows.repartitionByRange(parts, "s").withColumn("r", F.spark_partition_id())

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s", "h"])
        y, h = part["y"].to_numpy(), part["h"].to_numpy().view(np.uint64)
        _, score = np.unique(part["s"].to_numpy(), return_inverse=True)
        cuts, out = np.array(POISSON), []
        for lo in range(0, replicates, 64):
            b = np.arange(lo, min(replicates, lo + 64))
            x = h[:, None] ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for shift, odd in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                x = (x ^ x >> np.uint64(shift)) * np.uint64(odd)
            w = np.searchsorted(cuts, (x >> np.uint64(11)).astype(float) / (1 << 53), side="right")
            pos, neg = (np.stack([np.bincount(score, w[:, i] * (y == v), score.max() + 1) for i in range(len(b))], axis=1) for v in (1, 0))
            won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
            out.append(pd.DataFrame({"b": b, "r": part["r"].iloc[0], "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "won": won}))
        return pd.concat(out)

    each = rows.groupBy("r").applyInPandas(sums, "b int, r long, pos double, neg double, won double")
    below = Window.partitionBy("b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    total = each.groupBy("b").agg(F.sum(F.col("won") + F.col("pos") * F.col("below")).alias("won"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return total.where("P > 0 and N > 0").select("b", (F.col("won") / (F.col("P") * F.col("N"))).alias("auroc"))


def localisation(df: DataFrame, group: str, pos: str) -> DataFrame:
    """Top-1 rate over groups with a positive and two rows at least: is the row with the largest score (first of
    equals) a positive?"""
    g = df.groupBy(group).agg(F.max("y").alias("any"), F.count("*").alias("n"), F.max_by("y", F.struct("s", -F.col(pos))).alias("hit"))
    return g.where("any = 1 and n >= 2").agg(F.avg("hit").alias("top1"), F.count("*").alias("n"))
