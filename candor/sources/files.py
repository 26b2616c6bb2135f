"""Files in and out: tables, feature side tables, thresholds, line texts and worksheets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.functions.scores import DEFAULT_HIGH, DEFAULT_MEDIUM
from candor.functions.text import one_line


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; in local mode without one, in a temporary folder. It goes when the
    application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="candor-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/candor-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: made once however often it is used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attached(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a first pass with columns that a second pass made for some of them; the others keep what they have."""
    new = second.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = first.join(new, key, "left")
    had = lambda c: F.col(c) if c in first.columns else F.lit(None)
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(had(c)) for c in columns}).drop("_new", *(f"_{c}" for c in columns))


def with_features(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Rows with their feature arrays, by key; refuses tables that don't match row for row."""
    out = rows.join(features, key)
    n = [x.count() for x in (rows, features, out)]
    if len(set(n)) > 1:
        raise ValueError(f"rows {n[0]}, features {n[1]}, matched {n[2]}")
    return out


def thresholds(spark: SparkSession, path: str) -> tuple[float, float]:
    """(t_med, t_high) of a JSON file, or the defaults if it isn't there."""
    try:
        r = spark.read.schema("t_med double, t_high double").option("multiLine", True).json(path).first()
    except Exception as e:  # noqa: BLE001 - Spark raises several kinds for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        r = None
    return (r["t_med"], r["t_high"]) if r else (DEFAULT_MEDIUM, DEFAULT_HIGH)


def write_thresholds(spark: SparkSession, path: str, medium: float, high: float) -> None:
    spark.createDataFrame([(medium, high)], "t_med double, t_high double").coalesce(1).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str, order: str | None = None) -> None:
    """One row per line, in order (if one is given); line breaks become spaces, nulls empty lines."""
    if order:
        df = df.orderBy(order)
    df.select(F.coalesce(one_line(F.col(column)), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """n (from 0) and the line, in the order of the files' names and of the lines in them. Splits of files are counted, and numbered side
    by side from where the splits before them end."""
    rows = spark.read.text(path).select(F.col("value").alias(column), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    sizes = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    sizes = sizes.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1
    return rows.withColumn("_own", own).join(sizes, ["_f", "_b"]).select((F.col("_s") + F.col("_own")).alias("n"), column)


def zipped_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """n, left and right of two line files, line by line; refuses files of different lengths."""
    a, b = read_lines(spark, left, "left"), read_lines(spark, right, "right")
    return zipped(a, b, "n")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two line tables by line number; refuses different lengths."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} lines")
    return left.join(right, key)


def scored_by(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], column: str, kind: str = "double") -> DataFrame:
    """df with a column from a model, called batch by batch: where judges, entailment and similarity models plug in."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: score(b)})

    return df.mapInPandas(go, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {column} {kind}")
