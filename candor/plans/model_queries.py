"""Fitted fusions, out-of-fold evaluation, calibration, and the score log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import arrays as A
from candor.operators import fitting, head, ordered, splits
from candor.operators import metrics as M
from candor.operators.splits import stratified
from candor.plans.base import DETECTORS, LABELLED, labelled, r6, table
from candor.plans.number_queries import CENTROIDS, E_, centroids, vectors
from candor.streaming import score_log

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("f01_f10_fit_and_calibrate")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the training split, thresholds from its scores, metrics on the test split."""
    rows = stratified(labelled(spark, d), "y", "doc_id", 0.25)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = fitting.fusion(train, DETECTORS, "y", c=0.5)
    medium, high = fitting.calibrated(train.withColumn("fused", model.score()), "y", "fused")
    scored = test.select(F.lit("fused").alias("detector"), "y", model.score().alias("s"))
    return M.summary(scored, ["detector"], high).withColumns({"t_med": F.lit(medium), "t_high": F.lit(high)})


@query("f09_a30_out_of_fold")
def _(spark, d):
    oof = fitting.out_of_fold(labelled(spark, d), DETECTORS, "y", "doc_id")
    rows = oof.select(F.lit("fused").alias("detector"), "y", F.col("fused").alias("s"))
    return M.auroc(rows, ["detector"]).join(M.average_precision(rows, ["detector"]), "detector").select("detector", *r6("auroc", "ap"))


@query("f02_boosted")
def _(spark, d):
    """All 300 rounds."""
    scored = fitting.boosted(labelled(spark, d), DETECTORS, "y")
    return M.auroc(scored.select(F.lit("boosted").alias("detector"), "y", F.col("fused").alias("s")), ["detector"])


@query("f09_honest_evaluation")
def _(spark, d):
    """Two heads learnt out of fold on the training rows, a third score as it is, their fusion, and all four on the test rows."""
    heads = {"surface": ["sep_entropy", "hallushift"], "length": ["tsv_margin", "n"]}
    _, test = fitting.honest(labelled(spark, d), heads, ["tsv_margin"], "y", "doc_id")
    rows = test.select("y", *heads, "tsv_margin", "fused").unpivot(["y"], [*heads, "tsv_margin", "fused"], "detector", "s")
    return M.auroc(rows, ["detector"]).join(M.average_precision(rows, ["detector"]), "detector").select("detector", *r6("auroc", "ap"))


@query("a31_anchor_fits")
def _(spark, d):
    """A head fitted on each of two feature anchors, both at once, and scored on the same held-out rows."""
    rows = stratified(labelled(spark, d), "y", "doc_id", 0.25)
    train = F.col("split") == "train"
    models = fitting.fusions(rows, [fitting.Fit("end", ["sep_entropy", "tsv_margin"], train, 0.1), fitting.Fit("span", ["hallushift", "tsv_margin"], train, 0.1)], "y")
    scored = rows.where(~train).select("y", *(m.score().alias(a) for a, m in models.items())).unpivot(["y"], list(models), "anchor", "s")
    return M.auroc(scored, ["anchor"]).select("anchor", *r6("auroc"))


@query("f03_probes")
def _(spark, d):
    """A probe on the vectors and its mirror: the second one's scores are the first one's from 1."""
    rows = stratified(vectors(spark, d).select("vec_id", "v", (F.col("label") % 2).cast("int").alias("y")), "y", "vec_id", 0.25)
    coef, intercept = fitting.probes(rows.where("split = 'train'"), "v", "y")
    z = A.dot(F.col("v"), F.array(*map(F.lit, coef))) + intercept
    scored = rows.where("split = 'test'").select("y", (1 / (1 + F.exp(-z))).alias("false"), (1 / (1 + F.exp(z))).alias("true")).unpivot(["y"], ["false", "true"], "probe", "s")
    return M.auroc(scored, ["probe"]).select("probe", *r6("auroc"))


@query("f07_moving_average", f"""WITH {E_}, u AS (SELECT label % 2 AS cls, vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS x FROM e)
    , c AS (SELECT cls, list_reduce(list(x ORDER BY vec_id), lambda c, x: list_transform(list_zip(c, x), lambda z: 0.99::DOUBLE * z[1] + (1 - 0.99::DOUBLE) * z[2])) AS c FROM u GROUP BY cls)
    , k AS (SELECT cls, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS k, sqrt(list_sum(list_transform(c, lambda y: y * y))) AS n FROM c)
    SELECT CAST(cls AS INT) AS cls, CAST(k AS INT) AS k, round(x / n, 9) AS x FROM k""")
def _(spark, d):
    """Centroids of both classes as moving averages of unit vectors in the order of vec_id, at unit length."""
    rows = vectors(spark, d).select((F.col("label") % 2).cast("int").alias("cls"), "vec_id", A.unit(F.col("v")).alias("x"))
    return ordered.moving_average(rows, ["cls"], "vec_id", "x", 0.99).select("cls", F.posexplode(A.unit(F.col("average"))).alias("k", "x")).select("cls", "k", F.round("x", 9).alias("x"))


@query("l06_relabel_delta", f"""WITH {LABELLED}, x AS (SELECT unnest(['old', 'new']) AS labels, sep_entropy AS s, y, toxic FROM labelled), z AS (SELECT labels, s, CASE labels WHEN 'old' THEN y ELSE toxic END AS y FROM x)
    , r AS (SELECT labels, y, rank() OVER (PARTITION BY labels ORDER BY s) + (count(*) OVER (PARTITION BY labels, s) - 1) / 2.0 AS r FROM z)
    SELECT labels, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r GROUP BY labels""")
def _(spark, d):
    """A score against old and new labels."""
    rows = labelled(spark, d).select(F.col("sep_entropy").alias("s"), F.inline(F.array(F.struct(F.lit("old").alias("labels"), F.col("y").alias("y")), F.struct(F.lit("new").alias("labels"), F.col("toxic").alias("y")))))
    return M.auroc(rows, ["labels"]).select("labels", *r6("auroc"))


@query("d11_tiered_log", """WITH e AS (SELECT event_id, user_id, value / 500.0 AS v FROM events WHERE value IS NOT NULL)
    SELECT event_id, CASE WHEN v >= 0.409 THEN 'high' WHEN v >= 0.245 THEN 'medium' ELSE 'ok' END AS tier FROM e""")
def _(spark, d):
    """Events as a log of scored answers, tiers as the log's reader computes them row by row."""
    log = table(spark, d, "events").where("value is not null").select("event_id", F.array(F.struct(F.lit(True).alias("is_claim"), (F.col("value") / 500.0).alias("fused"))).alias("sentences"))
    return score_log.tiered(log, 0.245, 0.409).select("event_id", "tier")


@query("f04_f05_f06_head")
def _(spark, d):
    """Embeddings stand for the features of a model of 28 layers: 4 * 13 + 11 of their 64 values. The fit stops after 30 epochs, a pass
    each, as it shows the operator; the operator's own number is 300."""
    rows = vectors(spark, d).select("vec_id", F.slice("v", 1, head.width(28)).alias("v"), (F.col("label") % 2).cast("int").alias("y"))
    rows = stratified(rows, "y", "vec_id", 0.25)
    model, _ = head.fit(rows, "v", "y", "vec_id", 28, epochs=30)
    scored = rows.where("split = 'test'").select(F.lit("head").alias("detector"), "y", model.score(F.col("v")).alias("s"))
    return M.auroc(scored, ["detector"]).join(M.average_precision(scored, ["detector"]), "detector").select("detector", *r6("auroc", "ap"))


_ROUNDS = 3
_BALANCE = "".join(
    f""", q{i} AS (SELECT vec_id, a * f0 / (a * f0 + b * f1) AS p0, b * f1 / (a * f0 + b * f1) AS p1, a, b, f0, f1 FROM e, f{i})
    , f{i + 1} AS (SELECT f0 * 0.7::DOUBLE * count(*) / sum(p0) AS f0, f1 * 0.3::DOUBLE * count(*) / sum(p1) AS f1 FROM q{i} GROUP BY f0, f1)"""
    for i in range(_ROUNDS)
)


@query("f08_pseudo_labels", f"""WITH {E_.replace("e AS", "u0 AS", 1)}, {CENTROIDS.replace("FROM e", "FROM u0")}
    , j AS (SELECT vec_id, list_cosine_similarity(v, (SELECT c FROM c WHERE cls = 0)) AS h, list_cosine_similarity(v, (SELECT c FROM c WHERE cls = 1)) AS t FROM u0)
    , e AS (SELECT vec_id, exp((h - greatest(h, t)) / 0.05::DOUBLE) AS a, exp((t - greatest(h, t)) / 0.05::DOUBLE) AS b FROM j)
    , f0 AS (SELECT 1.0::DOUBLE AS f0, 1.0::DOUBLE AS f1){_BALANCE}
    , p AS (SELECT vec_id, a * f0 / (a * f0 + b * f1) AS p0, b * f1 / (a * f0 + b * f1) AS p1 FROM e, f{_ROUNDS})
    , n AS (SELECT vec_id, p0, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS cls, round(-p0 * ln(p0) - p1 * ln(p1), 9) AS h FROM p)
    , r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY h, vec_id) AS r, row_number() OVER (ORDER BY h, vec_id) AS r_all FROM n)
    , g AS (SELECT count(*) FILTER (cls = 0) < 28 OR count(*) FILTER (cls = 1) < 12 AS short FROM n)
    SELECT vec_id, CAST(cls AS BIGINT) AS cls, round(p0, 6) AS p0, round(h, 6) AS entropy FROM r, g WHERE CASE WHEN short THEN r_all <= 40 ELSE r <= CASE cls WHEN 0 THEN 28 ELSE 12 END END""")
def _(spark, d):
    """Similarities to the class centroids, balanced to shares of 0.7 and 0.3, and the 40 surest rows by class (the selection is the feature)."""
    rows = vectors(spark, d).join(F.broadcast(centroids(vectors(spark, d))))
    rows = rows.select("vec_id", F.array(A.cosine(F.col("v"), F.col("h")), A.cosine(F.col("v"), F.col("t"))).alias("s"))
    rows = head.pseudo_labels(rows, "s", [0.7, 0.3], rounds=_ROUNDS).select("vec_id", F.col("pseudo")[0].alias("p0"), F.when(F.col("pseudo")[1] > F.col("pseudo")[0], 1).otherwise(0).cast("long").alias("cls"), F.round("entropy", 9).alias("entropy"))
    return splits.confident(rows, "cls", "entropy", {0: 0.7, 1: 0.3}, 40, "vec_id").select("vec_id", "cls", *r6("p0", "entropy"))
