"""Deterministic splits, samples and slices, by hashes of row ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """df with _nth, the place (from 1) of a row among those of its label in the seeded order, and _of, their number. The order's keys
    are hashes, so their first three digits cut it into 4,096 equal ranges; rows are ordered within a range alone."""
    key = shuffle_key(F.col(row_id), seed)
    rows = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    sizes = rows.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    all_of = Window.partitionBy(label)
    sizes = sizes.withColumns({"_of": F.sum("_n").over(all_of), "_before": F.sum("_n").over(all_of.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")})
    sizes = sizes.select(F.col(label).alias("_label"), F.col("_range").alias("_r"), "_of", "_before")
    inside = Window.partitionBy(label, "_range").orderBy("_key", row_id)
    out = rows.withColumn("_in", F.row_number().over(inside)).join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("_nth", F.col("_before") + F.col("_in")).drop("_key", "_range", "_in", "_label", "_r", "_before")


def stratified(df: DataFrame, label: str, row_id: str, share: float, seed: int = 42) -> DataFrame:
    """split: test for the first ceil(share * n) rows of each label in the seeded order, else train."""
    rows = ranked(df, label, row_id, seed)
    return rows.withColumn("split", F.when(F.col("_nth") <= F.ceil(share * F.col("_of")), "test").otherwise("train")).drop("_nth", "_of")


def grouped(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """split by a hash of the group, so that its rows stay together; needs no shuffle."""
    unit = F.conv(F.substring(shuffle_key(F.col(group), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(unit < share, "test").otherwise("train"))


def folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 0) -> DataFrame:
    return ranked(df, label, row_id, seed).withColumn("fold", F.pmod(F.col("_nth") - 1, F.lit(k)).cast("int")).drop("_nth", "_of")


def first_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; only n rows of a key leave a task."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(shuffle_key(F.col(row_id), seed), row_id).limit(n)


def page(df: DataFrame, order: str | list[str], n: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(order).offset(offset)
    return out if n is None else out.limit(n)


def confident(df: DataFrame, pseudo: str, loss: str, shares: dict[int, float], k: int, row_id: str) -> DataFrame:
    """For each class, the k * share rows of least loss; the k rows of least loss of all, if a class is short."""
    have = {r[pseudo]: r["count"] for r in df.groupBy(pseudo).count().collect()}  # a row per class
    want = {c: int(k * s) for c, s in shares.items()}
    if any(have.get(c, 0) < n for c, n in want.items()):
        return df.orderBy(loss, row_id).limit(k)
    return reduce(DataFrame.unionByName, (df.where(F.col(pseudo) == c).orderBy(loss, row_id).limit(n) for c, n in want.items()))
