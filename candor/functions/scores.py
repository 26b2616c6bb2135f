"""Scoring: fusion, tiers, margins and bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.arrays import bound, cosine

# Thresholds by model, detector order, and fusion parameters.
THRESHOLDS = {"s1": (0.7, 0.9), "l1b": (0.245, 0.409), "8bv2": (0.588, 0.98)}
DEFAULT_MEDIUM, DEFAULT_HIGH = 0.50, 0.74
SCORE_FEATURES = ["sep_entropy", "hallushift", "tsv_margin"]
LABELS = {"ok": "Reliable", "medium": "Uncertain", "high": "Likely Hallucinated", "filler": "Not a claim"}
TIER_COLORS = {"ok": "green", "medium": "yellow", "high": "red", "filler": "grey"}
UI_RED, UI_AMBER = 0.5, 0.33
COSINE_TEMPERATURE = 0.1
# End of fixed values.


def score_vector() -> Column:
    """The scores in the models' order."""
    return F.array(*(F.col(c).cast("double") for c in SCORE_FEATURES))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def fused(features: list[Column], mean: list[float], scale: list[float], coef: list[float], intercept: float) -> Column:
    """Logistic score of standardised features. A scale of features that hardly vary is 1 (see dead_scale)."""
    z = F.lit(float(intercept))
    for x, m, s, c in zip(features, mean, scale, coef, strict=True):
        z = z + (x - float(m)) / float(s) * float(c)
    return sigmoid(z)


def dead_scale(variance: Column) -> Column:
    """Scale of a feature: 1 where its variance is below 1e-12."""
    return F.when(variance < 1e-12, 1.0).otherwise(F.sqrt(variance))


def tier(score: Column, medium: Column | float = DEFAULT_MEDIUM, high: Column | float = DEFAULT_HIGH) -> Column:
    return F.when(score.isNull(), "filler").when(score >= high, "high").when(score >= medium, "medium").otherwise("ok")


def tier_label(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in LABELS.items():
        out = F.when(t == name, label).otherwise(out)
    return out


def tier_color(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, color in TIER_COLORS.items():
        out = F.when(t == name, color).otherwise(out)
    return out


def medium_of(high: Column) -> Column:
    return F.round(0.6 * high, 3)


def ui_band(score: Column) -> Column:
    return F.when(score >= UI_RED, "red").when(score >= UI_AMBER, "amber").otherwise("green")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def sep_hallucination(entropy: Column, accuracy: Column) -> Column:
    return (entropy + 1 - accuracy) / 2


def sep_confidence(entropy: Column, accuracy: Column) -> Column:
    return (accuracy + 1 - entropy) / 2


def tsv(vector: Column, hallucinated: Column, truthful: Column) -> Column:
    """(margin, tsv): difference of the cosines with both centroids, and 1 - P(truthful) from their softmax."""
    def of(pair: Column) -> Column:
        h, t = pair["h"], pair["t"]
        return F.struct((h - t).alias("margin"), (1 - 1 / (1 + F.exp((h - t) / COSINE_TEMPERATURE))).alias("tsv"))

    return bound(F.struct(cosine(vector, hallucinated).alias("h"), cosine(vector, truthful).alias("t")), of)


def highlight_alpha(score: Column, most: Column, t: Column) -> Column:
    """Opacity of a sentence's mark, by its score relative to the largest of its answer."""
    rel = F.when(most == 0, 0.0).otherwise(score / most)
    return F.when(t == "high", 0.22 + 0.45 * rel).when(t == "medium", 0.20 + 0.35 * rel)


def expected_tier(expect: Column, t: Column) -> Column:
    return F.when(expect == "ok", t == "ok").otherwise(t.isin("high", "medium"))


def anchor(steps: Column, prompt_len: Column) -> Column:
    """Second-last token, or the prompt's end if that is later."""
    return F.greatest(steps - 2, prompt_len)

# Shipped fusion parameters (features, mean, scale, coefficients, intercept).
MODELS = {
    "s1": (["tsv_margin"], [-0.0899], [0.1251], [1.8473], -0.3196),
    "l1b": (["sep_entropy", "hallushift", "tsv_margin"], [0.4768, 0.4885, 0.0148], [0.4671, 0.2461, 0.1026], [4.5894, 0.2780, 0.2890], -0.2442),
    "8bv2": (["sep_entropy", "hallushift", "tsv_margin"], [0.1578, 0.1485, -0.1945], [0.3523, 0.1825, 0.0324], [3.7465, 0.4394, 0.0277], -3.6476),
}
# End of fixed values.


def model_score(tag: str) -> Column:
    names, mean, scale, coef, intercept = MODELS[tag]
    return fused([F.col(n) for n in names], mean, scale, coef, intercept)
