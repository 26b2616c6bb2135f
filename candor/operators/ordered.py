"""Operations along an order of all rows, in ranges: running sums, as-of joins and moving averages.

Spark deals the rows out by ranges of (keys, order), about equally many to each, whatever the values and however many rows a key
has. Each range gives what it has in total, a row per key; what lies before a range is put together from these rows alone. No
task holds a whole order, and the input is made once: the ranges are written to the shared folder.

Null keys are a group like any other. Where rows of a key are equal in the order, they may be taken in any order among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.arrays import bound
from candor.sources.files import kept

#: Tokens of one block.
BLOCK = 1024


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df, written once, with _r: the number of the range of (keys, order) that the row is in."""
    dealt = df.repartitionByRange(_parts(df), *keys, order)
    return kept(dealt.withColumn("_r", F.spark_partition_id()), "ranges")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def running(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False) -> DataFrame:
    """df with cum_<value>, the sum over the rows of the keys up to and with this one, and all_<value>, the sum over all of them."""
    rows = ranges(df, keys, order)
    sums = rows.groupBy(*keys, "_r").agg(*(F.sum(v).alias(v) for v in values))
    of = Window.partitionBy(*keys)
    before = of.orderBy(F.desc("_r") if descending else F.col("_r")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_r", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b_{v}") for v in values), *(F.sum(v).over(of).alias(f"all_{v}") for v in values))
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc(order) if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values})
    out = within.join(sums, _same(within, sums, [*keys, "_r"]))
    return out.select(*(within[c] for c in df.columns), *((within[f"cum_{v}"] + sums[f"_b_{v}"]).alias(f"cum_{v}") for v in values), *(sums[f"all_{v}"] for v in values))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, strict: bool = False) -> DataFrame:
    """left with `value` of the first row of right, by `on`, that isn't before it (strict: that is after it); null if there is none, the
    smallest value of equal places. Both sides go through one order, in which each row of left takes the value that stands next."""
    ours, theirs = (1, 0) if strict else (0, 1)  # of equal places, whose rows come first
    columns = [c for c in left.columns if c not in (*keys, on)]
    a = left.select(*keys, F.struct(F.col(on).alias("on"), F.lit(ours).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("value")).alias("_o"), F.struct(*columns).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*keys, F.struct(F.col(on).alias("on"), F.lit(theirs).alias("side"), F.col(value).alias("value")).alias("_o"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.col(value).alias("_v"))
    rows = ranges(a.unionByName(b), keys, "_o")
    after = Window.partitionBy(*keys, "_r").orderBy(F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_next", F.last("_v", ignorenulls=True).over(after))
    first = rows.groupBy(*keys, "_r").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias("_f"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_f", F.last("_f", ignorenulls=True).over(later))
    out = within.where("_left is not null").join(first, _same(within, first, [*keys, "_r"]))
    return out.select(*(within[k] for k in keys), within["_o.on"].alias(on), "_left.*", F.coalesce("_next", "_f").alias(value))


def moving_average(df: DataFrame, keys: list[str], order: str, vector: str, decay: float) -> DataFrame:
    """keys and average: c = decay * c + (1 - decay) * x over the rows in order, from the first row's x on. A range's fold is a pair
    (decay ** rows, weighted sum), and pairs compose, so ranges are folded side by side, in one pass over their rows each."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(vector).cast("array<double>").alias("_x"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # key, rows, first x, fold of all rows

        def out() -> pa.RecordBatch:
            key, n, first, total = held
            arrays = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([number], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x.tolist()]) for x in (first, total)))], [*keys, "_r", "_n", "_first", "_total"])

        from pyspark import TaskContext

        number, types = TaskContext.get().partitionId(), []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            if not batch.num_rows:
                continue
            said = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            bounds = [0, *(i for i in range(1, len(said)) if said[i] != said[i - 1]), len(said)]
            flat = batch.column("_x")
            matrix = flat.flatten().to_numpy().reshape(batch.num_rows, -1)
            for a, b in zip(bounds, bounds[1:], strict=False):
                n = b - a
                part = (1 - decay) * (decay ** np.arange(n - 1, -1, -1.0)) @ matrix[a:b]
                if held and held[0] == said[a]:
                    held[1], held[3] = held[1] + n, held[3] * decay**n + part
                else:
                    if held:
                        yield out()
                    held = [said[a], n, matrix[a], part]
        if held:
            yield out()

    dealt = rows.repartitionByRange(_parts(df), *keys, "_o").sortWithinPartitions(*keys, "_o")
    parts = kept(dealt.mapInArrow(fold, ", ".join([*fields, "_r int, _n long, _first array<double>, _total array<double>"])), "folds")
    after = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"_later": F.coalesce(F.sum("_n").over(after), F.lit(0)), "_lead": F.row_number().over(Window.partitionBy(*keys).orderBy("_r")) == 1})
    # the first row of all counts whole, not by 1 - decay
    whole = F.when(F.col("_lead"), F.zip_with("_total", "_first", lambda t, x: t + F.lit(decay) ** F.col("_n") * x)).otherwise(F.col("_total"))
    terms = placed.select(*keys, F.posexplode(F.transform(whole, lambda t: t * F.lit(decay) ** F.col("_later"))).alias("_k", "_x"))
    summed = terms.groupBy(*keys, "_k").agg(F.sum("_x").alias("_x")).groupBy(*keys)
    return summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda s: s["_x"]).alias("average"))


def token_ranges(tokens: DataFrame, spans: DataFrame, key: str, prompt_len: int) -> DataFrame:
    """Spans (key, id, start, end in characters of the decoded answer) with a and b: the tokens [a, b) that cover them. tokens: key, k
    (from 0, without gaps) and size, what the answer grows by with the token. Of a span that ends beyond the answer, what is inside
    counts; without tokens it is (prompt_len, prompt_len)."""
    return token_ranges_of_blocks(blocks_of(tokens, key), spans, key, prompt_len)


def blocks_of(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens (key, k, size), a row each, in blocks: key, k (the first token's number) and sizes."""
    whole = (F.col("k") - F.col("k") % BLOCK).alias("k")
    return tokens.groupBy(key, whole).agg(F.transform(F.array_sort(F.collect_list(F.struct(tokens["k"].alias("t"), "size"))), lambda x: x["size"]).alias("sizes"))


def token_blocks(sizes: Column) -> Column:
    """Rows (k, sizes) of the sizes of an answer's tokens, for `F.inline`: up to BLOCK tokens from number k on."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.struct(i.alias("k"), F.slice(x, i + 1, BLOCK).alias("sizes")))
    return bound(sizes, cut)


def token_ranges_of_blocks(blocks: DataFrame, spans: DataFrame, key: str, prompt_len: int) -> DataFrame:
    """`token_ranges` of tokens in blocks: key, k (the first token's number) and sizes, an array. The order has a row per block; a place
    finds its block there, and its token in the block."""
    blocks = blocks.where(F.size("sizes") > 0)
    each = blocks.select(key, F.col("k").cast("long").alias("k"), "sizes")
    sums = each.select(key, "k", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"), (F.col("k") + F.size("sizes") - 1).alias("last"))
    grown = running(sums, [key], "k", ["size"])
    sizes = grown.groupBy(key).agg(F.max("all_size").alias("size"), F.max("last").alias("last"))
    first = F.greatest(F.lit(0), F.least(F.col("start"), F.col("size") - 1))
    end = F.greatest(first + 1, F.least(F.col("end"), F.col("size"))) - 1
    sized = spans.join(sizes, key, "left")
    asked = sized.where("last is not null").select(key, "id", "start", "end", "last", F.inline(F.array(F.struct(F.lit(0).alias("which"), first.cast("long").alias("at")), F.struct(F.lit(1).alias("which"), end.cast("long").alias("at")))))
    found = as_of(asked, grown.select(key, F.col("cum_size").alias("at"), "k"), [key], "at", "k", strict=True)
    inside = each.join(grown.select(key, "k", (F.col("cum_size") - F.col("size")).alias("before")), [key, "k"])
    # tokens are counted until their sizes pass the place
    start = F.struct(F.lit(0).cast("long").alias("n"), F.col("before").alias("sum"))
    step = lambda acc, x: F.when(acc["sum"] > F.col("at"), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + x).alias("sum")))
    token = F.col("k") + F.aggregate("sizes", start, step, lambda acc: acc["n"]) - 1
    found = found.join(inside, [key, "k"], "left").withColumn("k", F.coalesce(token, "last") + prompt_len)
    found = found.groupBy(key, "id", "start", "end").agg(F.max(F.when(F.col("which") == 0, F.col("k"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("k") + 1)).alias("b"))
    none = sized.where("last is null").select(key, "id", "start", "end", F.lit(prompt_len).alias("a"), F.lit(prompt_len).alias("b"))
    return found.unionByName(none)
