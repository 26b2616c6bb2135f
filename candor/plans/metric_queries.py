"""Ranking metrics, statistics and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.scores import model_score
from candor.operators import metrics as M
from candor.plans.base import DETECTORS, LABELLED, LONG, fused_sql, labelled, long, r6

QUERIES, ORACLES = {}, {}
L1B, S1 = fused_sql("l1b"), fused_sql("s1")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_AUROC = """, ranked AS (SELECT detector, {extra} y, rank() OVER (PARTITION BY detector {part} ORDER BY s) + (count(*) OVER (PARTITION BY detector {part}, s) - 1) / 2.0 AS r FROM long)
    , auroc AS (SELECT detector {extra2}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auroc FROM ranked GROUP BY ALL)"""
AUROC = _AUROC.format(extra="", part="", extra2="")
AUROC_SOURCE = _AUROC.format(extra="source,", part=", source", extra2=", source")
CURVE = """, byscore AS (SELECT detector, s, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY detector, s)
    , curve AS (SELECT detector, s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS P, sum(neg) OVER (PARTITION BY detector) AS N FROM byscore WINDOW w AS (PARTITION BY detector ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
AP = CURVE + ", ap AS (SELECT detector, sum(pos * (tp / (tp + fp))) / max(P) AS ap FROM curve GROUP BY detector)"
CONFUSION = """, confusion AS (SELECT detector, count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s >= 0.5 AND y = 0) AS fp, count(*) FILTER (s < 0.5 AND y = 1) AS fn, count(*) FILTER (s >= 0.5 AND y = 1) AS tp FROM long GROUP BY detector)
    , scored AS (SELECT *, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM confusion)"""


@query("a11_auroc", f"WITH {LONG}{AUROC} SELECT detector, round(auroc, 6) AS auroc FROM auroc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.auroc(long(labelled(spark, d)), ["detector"]).select("detector", *r6("auroc"))


@query("a12_average_precision", f"WITH {LONG}{AP} SELECT detector, round(ap, 6) AS ap FROM ap")
def _(spark, d):
    return M.average_precision(long(labelled(spark, d)), ["detector"]).select("detector", *r6("ap"))


@query("a13_pr_trapezoid", f"""WITH {LONG}{CURVE}, t AS (SELECT detector, s, tp / P AS rec, tp / (tp + fp) AS prec FROM curve)
    , u AS (SELECT *, coalesce(lag(rec) OVER w, 0) AS rec0, coalesce(lag(prec) OVER w, 1) AS prec0 FROM t WINDOW w AS (PARTITION BY detector ORDER BY s DESC))
    SELECT detector, round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS pr_auc FROM u GROUP BY detector""")
def _(spark, d):
    return M.trapezoid_pr(long(labelled(spark, d)), ["detector"]).select("detector", *r6("pr_auc"))


@query("a14_curves", f"""WITH {LONG}{CURVE} SELECT detector, s, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM curve""")
def _(spark, d):
    return M.curve(long(labelled(spark, d)), ["detector"]).select("detector", "s", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"), *r6("tpr", "fpr", "precision"))


@query("a15_best_threshold", f"""WITH {LONG}, c AS (SELECT detector, count(DISTINCT s) AS k FROM long GROUP BY detector)
    , q AS (SELECT detector, unnest(quantile_cont(s, [i / 199.0 FOR i IN range(200)])) AS t FROM long GROUP BY detector)
    , grid AS (SELECT DISTINCT l.detector, s AS t FROM long l JOIN c USING (detector) WHERE k <= 200 UNION SELECT DISTINCT q.detector, t FROM q JOIN c USING (detector) WHERE k > 200)
    , v AS (SELECT g.detector, t, 2 * count(*) FILTER (s >= t AND y = 1) / (count(*) FILTER (s >= t AND y = 1) + count(*) FILTER (s >= t AND y = 0) + count(*) FILTER (y = 1)) AS f1 FROM grid g JOIN long l USING (detector) GROUP BY g.detector, t)
    SELECT detector, round(arg_max(t, struct_pack(a := round(f1, 12), b := -t)), 6) AS threshold, round(max(f1), 6) AS objective FROM v GROUP BY detector""")
def _(spark, d):
    return M.best_threshold(long(labelled(spark, d)), ["detector"]).select("detector", *r6("threshold", "objective"))


@query("a09_a10_confusion", f"WITH {LONG}{CONFUSION} SELECT detector, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored")
def _(spark, d):
    return M.confusion(long(labelled(spark, d)), ["detector"]).select("detector", "tn", "fp", "fn", "tp", *r6("accuracy", "precision", "recall", "f1"))


@query("a16_summary", f"WITH {LONG}{AUROC}{AP}{CONFUSION} SELECT detector, round(auroc, 4) AS auroc, round(ap, 4) AS ap, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM auroc JOIN ap USING (detector) JOIN scored USING (detector)")
def _(spark, d):
    return M.summary(long(labelled(spark, d)), ["detector"])


@query("a17_prevalence", f"WITH {LABELLED} SELECT source, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate, count(DISTINCT lang) AS langs FROM labelled GROUP BY source")
def _(spark, d):
    return labelled(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("positives"), F.round(F.avg("y"), 6).alias("rate"), F.countDistinct("lang").alias("langs"))


@query("a18_agreement", f"WITH {LABELLED} SELECT count(*) AS n, round(avg(CAST(y = toxic AS INT)), 6) AS agreement, count(*) FILTER (y = 1 AND toxic = 0) AS to_0, count(*) FILTER (y = 0 AND toxic = 1) AS to_1 FROM labelled")
def _(spark, d):
    from candor.operators.labels import agreement

    return agreement(labelled(spark, d), "y", "toxic").select("n", *r6("agreement"), "to_0", "to_1")


@query("a19_distribution", f"WITH {LONG} SELECT detector, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, min(s) AS low, max(s) AS high, round(avg(CAST(s > 0.5 AS INT)), 6) AS over_half, round(max(s) - min(s), 6) AS range FROM long GROUP BY detector")
def _(spark, d):
    g = long(labelled(spark, d)).groupBy("detector").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("low"), F.max("s").alias("high"), F.avg((F.col("s") > 0.5).cast("int")).alias("over_half"), (F.max("s") - F.min("s")).alias("range"))
    return g.select("detector", *r6("mean", "std"), "low", "high", *r6("over_half", "range"))


@query("a20_localisation", f"""WITH {LABELLED}, g AS (SELECT source, max(y) AS a, count(*) AS n, arg_max(y, struct_pack(s := sep_entropy, d := -doc_id)) AS hit FROM labelled GROUP BY source)
    SELECT round(avg(hit), 6) AS top1, count(*) AS n FROM g WHERE a = 1 AND n >= 2""")
def _(spark, d):
    return M.localisation(labelled(spark, d).withColumn("s", F.col("sep_entropy")), "source", "doc_id").select(*r6("top1"), "n")


@query("a21_within_group_auroc", f"WITH {LONG}{AUROC_SOURCE} SELECT detector, round(avg(auroc), 6) AS auroc FROM auroc WHERE auroc IS NOT NULL GROUP BY detector")
def _(spark, d):
    return M.auroc(long(labelled(spark, d)), ["detector", "source"]).where("auroc is not null").groupBy("detector").agg(F.round(F.avg("auroc"), 6).alias("auroc"))


@query("a23_pearson", f"WITH {LABELLED} SELECT round(CASE WHEN stddev_pop(sep_entropy) > 0 AND stddev_pop(hallushift) > 0 THEN corr(sep_entropy, hallushift) END, 6) AS sh, round(CASE WHEN stddev_pop(sep_entropy) > 0 AND stddev_pop(tsv_margin) > 0 THEN corr(sep_entropy, tsv_margin) END, 6) AS st, round(CASE WHEN stddev_pop(hallushift) > 0 AND stddev_pop(tsv_margin) > 0 THEN corr(hallushift, tsv_margin) END, 6) AS ht FROM labelled")
def _(spark, d):
    s, h, t = DETECTORS
    return labelled(spark, d).agg(F.round(M.pearson(s, h), 6).alias("sh"), F.round(M.pearson(s, t), 6).alias("st"), F.round(M.pearson(h, t), 6).alias("ht"))


@query("a24_spearman", f"""WITH {LONG}, r AS (SELECT detector, rank() OVER (PARTITION BY detector ORDER BY s) + (count(*) OVER (PARTITION BY detector, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY detector ORDER BY n) + (count(*) OVER (PARTITION BY detector, n) - 1) / 2.0 AS b FROM long)
    SELECT detector, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS rho FROM r GROUP BY detector""")
def _(spark, d):
    return M.spearman(long(labelled(spark, d)), ["detector"], "s", "n").select("detector", *r6("rho"))


@query("a25_bootstrap")
def _(spark, d):
    """Percentile interval of each detector's AUROC, of the difference of two, and the chance that it is above 0."""
    df = labelled(spark, d)
    both = [M.bootstrap(df.select("doc_id", "y", F.col(c).alias("s")), 2000, "doc_id").select("b", F.col("auroc").alias(n)) for c, n in (("sep_entropy", "x"), ("hallushift", "z"))]
    pairs = both[0].join(both[1], "b")
    return pairs.agg(F.percentile("x", [0.025, 0.975]).alias("x_interval"), F.percentile("z", [0.025, 0.975]).alias("z_interval"), F.percentile(F.col("x") - F.col("z"), [0.025, 0.975]).alias("difference"), F.avg((F.col("x") > F.col("z")).cast("double")).alias("p_better"))


@query("a26_pivot", f"WITH {LONG} SELECT source, {', '.join(f'round(avg(s) FILTER (detector = {chr(39)}{c}{chr(39)}), 6) AS {c}' for c in DETECTORS)} FROM long GROUP BY source")
def _(spark, d):
    return long(labelled(spark, d)).groupBy("source").pivot("detector", DETECTORS).agg(F.round(F.avg("s"), 6))


@query("a27_best_single", f"""WITH {LABELLED}, g AS (SELECT source, avg(sep_entropy) AS a, avg(hallushift) AS b, avg(tsv_margin) AS c, avg({fused_sql('l1b')}) AS f FROM labelled GROUP BY source)
    SELECT source, CASE WHEN a >= b AND a >= c THEN 'sep_entropy' WHEN b >= c THEN 'hallushift' ELSE 'tsv_margin' END AS best_single, f >= greatest(a, b, c) AS fused_wins FROM g""")
def _(spark, d):
    s, h, t = (F.col(c) for c in DETECTORS)
    g = labelled(spark, d).withColumn("fused", model_score("l1b")).groupBy("source").agg(*(F.avg(c).alias(c) for c in [*DETECTORS, "fused"]))
    return g.select("source", F.when((s >= h) & (s >= t), DETECTORS[0]).when(h >= t, DETECTORS[1]).otherwise(DETECTORS[2]).alias("best_single"), (F.col("fused") >= F.greatest(s, h, t)).alias("fused_wins"))


def _models(names: list[tuple[str, str]]) -> str:
    return LABELLED + ", long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS detector, doc_id, source, n, y, {e} AS s FROM labelled" for n, e in names) + ")"


@query("a28_ablation", f"WITH {_models([('l1b', f'round({L1B}, 9)'), ('s1', f'round({S1}, 9)'), ('sep', 'sep_entropy')])}{AUROC} SELECT detector, round(auroc, 6) AS auroc FROM auroc")
def _(spark, d):
    """Two fusions of the same scores, and a single detector."""
    df = labelled(spark, d).select("doc_id", "y", F.round(model_score("l1b"), 9).alias("l1b"), F.round(model_score("s1"), 9).alias("s1"), F.col("sep_entropy").alias("sep"))
    return M.auroc(df.unpivot(["doc_id", "y"], ["l1b", "s1", "sep"], "detector", "s"), ["detector"]).select("detector", *r6("auroc"))


@query("a29_mean_deviation", f"WITH {LABELLED} SELECT round(avg(abs(sep_entropy - hallushift)), 6) AS deviation FROM labelled")
def _(spark, d):
    return labelled(spark, d).agg(F.round(F.avg(F.abs(F.col("sep_entropy") - F.col("hallushift"))), 6).alias("deviation"))


@query("a31_anchors", f"""WITH {_models([('end', 'sep_entropy'), ('span', 'round(sep_entropy * 0.5 + hallushift * 0.5, 9)')])}{AUROC} SELECT detector AS anchor, round(auroc, 6) AS auroc FROM auroc""")
def _(spark, d):
    """The same held-out rows scored from two feature anchors."""
    df = labelled(spark, d).select("doc_id", "y", F.col("sep_entropy").alias("end"), F.round(F.col("sep_entropy") * 0.5 + F.col("hallushift") * 0.5, 9).alias("span"))
    return M.auroc(df.unpivot(["doc_id", "y"], ["end", "span"], "anchor", "s"), ["anchor"]).select("anchor", *r6("auroc"))


@query("a32_length_confound", f"WITH {LABELLED} SELECT lang, round(CASE WHEN stddev_pop(sep_entropy) > 0 AND stddev_pop(n) > 0 THEN corr(sep_entropy, n) END, 6) AS score_length, round(CASE WHEN stddev_pop(n) > 0 AND stddev_pop(y) > 0 THEN corr(n, y) END, 6) AS length_label FROM labelled GROUP BY lang")
def _(spark, d):
    return labelled(spark, d).groupBy("lang").agg(F.round(M.pearson("sep_entropy", "n"), 6).alias("score_length"), F.round(M.pearson("n", "y"), 6).alias("length_label"))


@query("w01_rank_mean", f"""WITH {LABELLED}, r AS (SELECT doc_id, {', '.join(f'(row_number() OVER (ORDER BY {c}, doc_id) - 1) / (count(*) OVER () - 1) AS r_{c}' for c in DETECTORS)} FROM labelled)
    SELECT doc_id, round((r_sep_entropy + r_hallushift + r_tsv_margin) / 3, 6) AS fused FROM r""")
def _(spark, d):
    return M.rank_mean(labelled(spark, d), DETECTORS, "doc_id", "fused").select("doc_id", *r6("fused"))


@query("m12_m13_standardise", f"""WITH {LABELLED}, p AS (SELECT avg(hallushift) AS m, CASE WHEN var_pop(hallushift) < 1e-12 THEN 1 ELSE sqrt(var_pop(hallushift)) END AS s FROM labelled)
    SELECT doc_id, round((hallushift - m) / s, 6) AS z FROM labelled, p""")
def _(spark, d):
    from candor.functions.scores import dead_scale

    df = labelled(spark, d)
    fit = df.agg(F.avg("hallushift").alias("m"), dead_scale(F.var_pop("hallushift")).alias("s"))
    return df.join(F.broadcast(fit)).select("doc_id", F.round((F.col("hallushift") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("m21_perturbation", f"""WITH {LABELLED}, e AS (SELECT unnest([0.0, 0.0001, 0.01, 0.1])::DOUBLE AS eps), x AS (SELECT eps, y, doc_id, {fused_sql('l1b').replace('tsv_margin', '(tsv_margin + eps)')} AS s FROM labelled, e)
    , r AS (SELECT eps, y, s, rank() OVER (PARTITION BY eps ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY eps, round(s, 9)) - 1) / 2.0 AS r FROM x)
    SELECT eps, round(stddev_pop(s), 6) AS std, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r GROUP BY eps""")
def _(spark, d):
    """Spread and AUROC of the scores after eps is added to one column."""
    df = labelled(spark, d).withColumn("eps", F.explode(F.array(*map(F.lit, [0.0, 0.0001, 0.01, 0.1])))).withColumn("tsv_margin", F.col("tsv_margin") + F.col("eps"))
    scored = df.select("eps", "y", model_score("l1b").alias("s"))
    spread = scored.groupBy("eps").agg(F.round(F.stddev_pop("s"), 6).alias("std"))
    return spread.join(M.auroc(scored.withColumn("s", F.round("s", 9)), ["eps"]).select("eps", *r6("auroc")), "eps")


@query("m14_m17_fusion_tiers", f"""WITH {LABELLED}, x AS (SELECT doc_id, {fused_sql('l1b')} AS p FROM labelled)
    SELECT doc_id, round(p, 6) AS fused, CASE WHEN p >= 0.409 THEN 'high' WHEN p >= 0.245 THEN 'medium' ELSE 'ok' END AS tier, CASE WHEN p >= 0.5 THEN 'red' WHEN p >= 0.33 THEN 'amber' ELSE 'green' END AS band FROM x""")
def _(spark, d):
    from candor.functions.scores import THRESHOLDS, tier, ui_band

    p = model_score("l1b")
    return labelled(spark, d).select("doc_id", F.round(p, 6).alias("fused"), tier(p, *THRESHOLDS["l1b"]).alias("tier"), ui_band(p).alias("band"))
