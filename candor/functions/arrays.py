"""Array mathematics on columns of array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, merge) -> Column:
    """merge(... merge(zero, first) ..., this) for every item. An array grown item by item is copied each time, so items go in parts of
    about the square root of their number: the copies are n * sqrt(n) items instead of n * n."""

    def within(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.slice(F.array(before), 1, 0).alias("out"))
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(merge(acc["at"], x))).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def of(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), size), lambda i: i < F.size(xs))
        return bound(F.transform(firsts, lambda i: F.slice(xs, i + 1, size)), whole)

    def whole(parts: Column) -> Column:
        before = F.concat(F.array(zero), within(F.transform(parts, lambda p: F.aggregate(p, zero, merge)), zero))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), within))

    return bound(values, of)


def running_sum(values: Column) -> Column:
    """Sums of the items up to and with each, of an array<int>."""
    return running(values, F.lit(0), lambda a, x: a + x)


def softmax(x: Column) -> Column:
    def scaled(pair: Column) -> Column:
        return bound(F.transform(pair, lambda v: F.exp(v - F.array_max(pair))), lambda e: bound(total(e), lambda t: F.transform(e, lambda v: v / t)))

    return bound(x, scaled)


def wasserstein(p: Column, q: Column) -> Column:
    """Between two value samples: of samples of n and m values, the one whose n * m quantile steps are compared."""
    equal = total(F.zip_with(F.array_sort(p), F.array_sort(q), lambda a, b: F.abs(a - b))) / F.size(p)

    def general(x: Column) -> Column:
        n, m = F.size(x["p"]), F.size(x["q"])
        every = F.sequence(F.lit(0), n * m - 1)
        return total(F.transform(every, lambda i: F.abs(F.get(x["p"], F.floor(i / m).cast("int")) - F.get(x["q"], F.floor(i / n).cast("int"))))) / (n * m)

    return F.when(F.size(p) == F.size(q), equal).when((F.size(p) > 0) & (F.size(q) > 0), bound(F.struct(F.array_sort(p).alias("p"), F.array_sort(q).alias("q")), general))


def dot(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * b))


def norm(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def cosine(p: Column, q: Column) -> Column:
    return dot(p, q) / (norm(p) * norm(q))


def unit(p: Column) -> Column:
    return bound(p, lambda x: bound(norm(x), lambda n: F.transform(x, lambda v: v / n)))


def entropy(p: Column) -> Column:
    """-sum p ln p over ln n, of positive values; 0 for a single value. Not bounded by 1 unless p sums to 1."""
    s = -total(F.transform(F.filter(p, lambda v: v > 0), lambda v: v * F.ln(v)))
    return F.when(F.size(p) <= 1, 0.0).otherwise(s / F.ln(F.size(p)))


def count_below(p: Column, limit: float = 0.1) -> Column:
    return F.size(F.filter(p, lambda v: v < limit))


def count_above(p: Column, limit: float = 0.9) -> Column:
    return F.size(F.filter(p, lambda v: v > limit))


def steps(p: Column) -> Column:
    """Absolute differences of neighbours."""
    pairs = F.greatest(F.size(p) - 1, F.lit(0))
    return F.when(F.size(p) > 1, F.zip_with(F.slice(p, 1, pairs), F.slice(p, 2, pairs), lambda a, b: F.abs(b - a))).otherwise(F.array().cast("array<double>"))


def mean_gradient(p: Column) -> Column:
    return bound(steps(p), lambda s: F.when(F.size(s) > 0, total(s) / F.size(s)).otherwise(0.0))


def max_gradient(p: Column) -> Column:
    return F.coalesce(F.array_max(steps(p)), F.lit(0.0))


def percentile(p: Column, share: float) -> Column:
    """Linear interpolation between order statistics."""
    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * share
        lo = F.floor(at).cast("int")
        hi = F.least(lo + 1, F.size(s) - 1)
        return F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (at - lo)

    return bound(F.array_sort(p), of)


def spread(p_max: Column, p_min: Column) -> Column:
    """Largest gap between a step's largest and smallest probability."""
    return F.array_max(F.zip_with(p_max, p_min, lambda a, b: a - b))


def statistics(p_max: Column, p_min: Column) -> Column:
    """The eleven token statistics: least p_max, spread, entropies, low counts, mean gradients, quartiles of p_max."""
    both = [f(x) for f in (entropy, count_below, mean_gradient) for x in (p_max, p_min)]
    return F.array(*(c.cast("double") for c in [F.array_min(p_max), spread(p_max, p_min), *both, *(percentile(p_max, q) for q in (0.25, 0.5, 0.75))]))


def pair_distances(vectors: Column) -> Column:
    """Of distributions one after another: the distances of neighbours, then their cosines. Fewer than two have none: Spark can
    evaluate this before a filter that drops such rows, so it must not raise."""
    pairs = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    left, right = lambda v: F.slice(v, 1, pairs(v)), lambda v: F.slice(v, 2, pairs(v))
    return bound(vectors, lambda v: F.concat(F.zip_with(left(v), right(v), wasserstein), F.zip_with(left(v), right(v), cosine)))


def every_second(layers: Column, first: int, last: Column) -> Column:
    """Layers first, first + 2, ... up to last, as distributions. Layer 0 is the embedding."""
    return F.transform(F.filter(layers, lambda _, i: (i >= first) & (i <= last) & (F.pmod(i - first, F.lit(2)) == 0)), softmax)


def layer_features(hidden: Column, attention: Column, layers: Column) -> Column:
    """One step's features: hidden layers 2, 4, ... `layers`, then attention layers 1, 3, ... `layers` - 1."""
    return F.concat(pair_distances(every_second(hidden, 2, layers)), pair_distances(every_second(attention, 1, layers - 1)))


def last_real(vectors: Column, mask: Column) -> Column:
    """The vector at the last place that isn't padding; mask: 1 for what is real."""
    return F.get(vectors, F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int")) - 1)


def sliced_mean(values: Column, a: Column, b: Column, fallback: Column) -> Column:
    """Mean of values [a, b); the fallback where these are fewer than two."""
    part = F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))
    return F.when(F.size(part) >= 2, total(part) / F.size(part)).otherwise(fallback)


def standardised(x: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), scale, lambda d, s: d / s)


def layers_of(n_features: Column) -> Column:
    """Layers of the model from the width of its features: 4 (L/2 - 1) + 11."""
    return 2 * (F.floor((n_features - 11) / 4) + 1)


def steered_layer(layers: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(layers * 0.28).cast("bigint"))
