"""Array mathematics on vectors, roll-ups, splits, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.functions import arrays as A
from candor.functions import scores as S
from candor.functions import text as T
from candor.operators import rollup, splits
from candor.plans.base import DETECTORS, LABELLED, SCORES, cut, fused_sql, labelled, long, r6, r6_tied, TIE, scores, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


E_ = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SOFT = "s AS (SELECT vec_id, label, v, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM e)"


@query("m01_m06_m09_token_statistics", f"""WITH {E_}, {SOFT}, q AS (SELECT vec_id, p, list_sort(p) AS o, list_transform(range(1, 64), lambda i: abs(p[i + 1] - p[i])) AS g FROM s)
    SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 6) AS entropy, CAST(len(list_filter(p, lambda x: x < 0.016)) AS INT) AS low, round(list_avg(g), 9) AS mean_gradient, round(list_max(g), 9) AS max_gradient,
    round(o[16] + (o[17] - o[16]) * 0.75, 9) AS p25, round(o[32] + (o[33] - o[32]) * 0.5, 9) AS p50, round(o[48] + (o[49] - o[48]) * 0.25, 9) AS p75 FROM q""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return vectors(spark, d).select("vec_id", A.softmax(F.col("v")).alias("p")).select(
        "vec_id", *(F.round(x, n).alias(name) for name, x, n in (("entropy", A.entropy(p), 6), ("mean_gradient", A.mean_gradient(p), 9), ("max_gradient", A.max_gradient(p), 9), ("p25", A.percentile(p, 0.25), 9), ("p50", A.percentile(p, 0.5), 9), ("p75", A.percentile(p, 0.75), 9))), A.count_below(p, 0.016).alias("low")
    )


@query("m02_m03_j10_layers", f"""WITH {E_}, {SOFT}, j AS (SELECT a.vec_id, a.p AS p, b.p AS q FROM s a JOIN s b ON b.vec_id = a.vec_id + 2)
    SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(list_sort(p)[i] - list_sort(q)[i]))), 9) AS w1, round(list_cosine_similarity(p, q), 6) AS cosine FROM j""")
def _(spark, d):
    """Distances of each vector to the next but one, as of sampled layers."""
    rows = vectors(spark, d).select("vec_id", A.softmax(F.col("v")).alias("p"))
    nxt = rows.select((F.col("vec_id") - 2).alias("vec_id"), F.col("p").alias("q"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(A.wasserstein(F.col("p"), F.col("q")), 9).alias("w1"), F.round(A.cosine(F.col("p"), F.col("q")), 6).alias("cosine"))


@query("m05_m07_m10_extremes", f"""WITH {E_}, {SOFT}, g AS (SELECT label, list(list_max(p) ORDER BY vec_id) AS hi, list(list_min(p) ORDER BY vec_id) AS lo FROM s GROUP BY label)
    SELECT label, round(list_min(hi), 9) AS mtp, round(list_max(list_transform(range(1, len(hi) + 1), lambda i: hi[i] - lo[i])), 9) AS mps, CAST(len(list_filter(hi, lambda x: x > 0.022)) AS INT) AS high FROM g""")
def _(spark, d):
    steps = vectors(spark, d).select("label", "vec_id", A.softmax(F.col("v")).alias("p")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.array_max("p").alias("hi"), F.array_min("p").alias("lo")))).alias("s"))
    hi, lo = F.col("s.hi"), F.col("s.lo")
    return steps.select("label", F.round(F.array_min(hi), 9).alias("mtp"), F.round(A.spread(hi, lo), 9).alias("mps"), A.count_above(hi, 0.022).alias("high"))


@query("m11_a08_feature_vector")
def _(spark, d):
    """The feature vector of each label's vectors taken as steps: mean distances of adjacent layers, then the token
    statistics; unit-tested against numpy."""
    rows = vectors(spark, d).select("label", "vec_id", A.softmax(F.col("v")).alias("p"))
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = rows.withColumn("q", F.lead("p").over(w)).where("q is not null").select("label", A.wasserstein(F.col("p"), F.col("q")).alias("w"), A.cosine(F.col("p"), F.col("q")).alias("c"))
    layers = pairs.groupBy("label").agg(F.avg("w").alias("w"), F.avg("c").alias("c"))
    steps = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.array_max("p").alias("hi"), F.array_min("p").alias("lo")))).alias("s"))
    return layers.join(steps, "label").select("label", F.concat(F.array("w", "c"), A.statistics(F.col("s.hi"), F.col("s.lo"))).alias("features"))


CENTROIDS = """u AS (SELECT vec_id, label, v, unnest(v) AS x, generate_subscripts(v, 1) AS k, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM e)
    , m AS (SELECT label % 2 AS cls, k, avg(x / n) AS x FROM u GROUP BY ALL), c AS (SELECT cls, list(x ORDER BY k) AS c FROM m GROUP BY cls)"""


def centroids(rows: DataFrame) -> DataFrame:
    """One row: h and t, the centroids of the even and the odd labels, which are per-dimension means of unit vectors."""
    dims = rows.select((F.col("label") % 2).alias("cls"), F.posexplode(A.unit(F.col("v"))).alias("k", "x")).groupBy("cls", "k").agg(F.avg("x").alias("x"))
    c = dims.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    return c.groupBy().agg(F.max(F.when(F.col("cls") == 0, F.col("c"))).alias("h"), F.max(F.when(F.col("cls") == 1, F.col("c"))).alias("t"))


@query("j12_m15_f07_centroid_margin", f"""WITH {E_}, {CENTROIDS}, j AS (SELECT vec_id, list_cosine_similarity(v, (SELECT c FROM c WHERE cls = 0)) AS h, list_cosine_similarity(v, (SELECT c FROM c WHERE cls = 1)) AS t FROM e)
    SELECT vec_id, round(h - t, 6) AS margin, round(1 - exp(t / 0.1) / (exp(t / 0.1) + exp(h / 0.1)), 6) AS tsv FROM j""")
def _(spark, d):
    rows = vectors(spark, d)
    both = centroids(rows)
    return rows.join(F.broadcast(both)).select("vec_id", S.tsv(F.col("v"), F.col("h"), F.col("t")).alias("x")).select("vec_id", F.round("x.margin", 6).alias("margin"), F.round("x.tsv", 6).alias("tsv"))


@query("m16_m18_m20_m22_m23_small", f"""WITH {SCORES} SELECT doc_id, round((sep_entropy + 1 - hallushift) / 2 + 1e-10, 6) AS sep, round(0.6 * sep_entropy, 3) AS medium, greatest(0, least(1, tsv_margin * 3)) AS clamped, CAST(2 * (floor((n % 200 + 11 - 11) / 4) + 1) AS BIGINT) AS layers, CAST(greatest(1, round_even((2 * (floor((n % 200) / 4) + 1)) * 0.28, 0)) AS BIGINT) AS layer, CAST(greatest(n % 7 - 2, 3) AS BIGINT) AS anchor FROM scores""")
def _(spark, d):
    s, h, t = (F.col(c) for c in DETECTORS)
    layers = A.layers_of(F.col("n") % 200 + 11)
    return scores(table(spark, d, "documents")).select("doc_id", F.round(S.sep_hallucination(s, h) + TIE, 6).alias("sep"), S.medium_of(s).alias("medium"), S.clamped(t * 3).alias("clamped"), layers.alias("layers"), A.steered_layer(layers).alias("layer"), S.anchor(F.col("n") % 7, F.lit(3)).alias("anchor"))


@query("m24_m25_fallbacks", f"""WITH {SCORES}, o AS (SELECT doc_id, tsv_margin FROM scores WHERE doc_id % 3 = 0) SELECT s.doc_id, coalesce(o.tsv_margin, -1.0) AS margin, CASE WHEN o.doc_id IS NULL THEN 0.0 ELSE s.sep_entropy END AS entropy, CASE WHEN o.doc_id IS NULL THEN 1.0 ELSE s.hallushift END AS accuracy, greatest(n % 50 - 2, n % 7) AS anchor FROM scores s LEFT JOIN o USING (doc_id)""")
def _(spark, d):
    """Rows without a match get the last token's margin, and (0, 1); a sentence is read at its last token but one."""
    rows = scores(table(spark, d, "documents"))
    own = rows.where("doc_id % 3 = 0").select("doc_id", F.col("tsv_margin").alias("m"))
    j = rows.join(own, "doc_id", "left")
    return j.select("doc_id", F.coalesce("m", F.lit(-1.0)).alias("margin"), F.when(F.col("m").isNull(), 0.0).otherwise(F.col("sep_entropy")).alias("entropy"), F.when(F.col("m").isNull(), 1.0).otherwise(F.col("hallushift")).alias("accuracy"), S.anchor(F.col("n") % 50, F.col("n") % 7).alias("anchor"))


# Lines stand for sentences: their scores, claims and roll-up.
LINES = r"""lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) - 1 AS pos0, x.l AS line, x.k AS pos FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k) x WHERE x.l <> '')
    , f AS (SELECT doc_id, pos, line, floor(CAST(len(list_distinct(string_split(line, ' '))) AS DOUBLE) / len(string_split(line, ' ')) * 1000000) / 1000000 AS sep_entropy, floor(CAST(length(line) - length(replace(line, 'e', '')) AS DOUBLE) / length(line) * 1000000) / 1000000 AS hallushift, floor((0.5::DOUBLE - CAST(length(line) AS DOUBLE) / (length(line) + 2000)) * 1000000) / 1000000 AS tsv_margin, len(string_split(line, ' ')) >= 3 AS is_claim FROM lines)"""
TIERED = LINES + f", g AS (SELECT *, CASE WHEN is_claim THEN {fused_sql('8bv2')} END AS fused FROM f), h AS (SELECT *, CASE WHEN fused IS NULL THEN 'filler' WHEN fused >= 0.98 THEN 'high' WHEN fused >= 0.588 THEN 'medium' ELSE 'ok' END AS tier FROM g)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    n, words = F.length("line"), F.split("line", " ")
    rows = rows.withColumns({"sep_entropy": cut(F.size(F.array_distinct(words)) / F.size(words)), "hallushift": cut((n - F.length(F.replace(F.col("line"), F.lit("e"), F.lit("")))) / n), "tsv_margin": cut(F.lit(0.5) - n / (n + 2000)), "is_claim": F.size(words) >= 3})
    rows = rows.withColumn("fused", F.when(F.col("is_claim"), S.model_score("8bv2")))
    return rows.withColumn("tier", S.tier(F.col("fused"), *S.THRESHOLDS["8bv2"]))


@query("a01_w02_headline", f"""WITH {TIERED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fused DESC NULLS LAST) AS r FROM h)
    , a AS (SELECT doc_id, coalesce(max(fused) FILTER (r = 2), max(fused) FILTER (r = 1)) AS fused, coalesce(avg(sep_entropy) FILTER (fused IS NOT NULL), 0) AS sep_entropy, coalesce(avg(hallushift) FILTER (fused IS NOT NULL), 0) AS hallushift, coalesce(avg(tsv_margin) FILTER (fused IS NOT NULL), 0) AS tsv_margin, count(*) FILTER (tier = 'high') AS n_flagged, count(*) AS n_sentences FROM r GROUP BY doc_id)
    SELECT doc_id, round(fused, 6) AS fused, round(sep_entropy + 1e-10, 6) AS sep_entropy, round(hallushift + 1e-10, 6) AS hallushift, round(tsv_margin + 1e-10, 6) AS tsv_margin, n_flagged, n_sentences, CASE WHEN fused IS NULL THEN 'filler' WHEN fused >= 0.98 THEN 'high' WHEN fused >= 0.588 THEN 'medium' ELSE 'ok' END AS tier, CASE WHEN fused IS NULL THEN 'Not a claim' WHEN fused >= 0.98 THEN 'Likely Hallucinated' WHEN fused >= 0.588 THEN 'Uncertain' ELSE 'Reliable' END AS label FROM a""")
def _(spark, d):
    return rollup.headline(lines(spark, d), "doc_id", *S.THRESHOLDS["8bv2"]).select("doc_id", *r6("fused"), *r6_tied(*DETECTORS), "n_flagged", "n_sentences", "tier", "label")


@query("a02_whole_answer", f"WITH {TIERED} SELECT doc_id, round(max(hallushift), 6) AS fused, count(*) FILTER (tier = 'high') AS n_flagged, count(*) AS n_sentences FROM h GROUP BY doc_id")
def _(spark, d):
    return rollup.whole_answer(lines(spark, d), "doc_id", "hallushift", 0.5, 0.74).select("doc_id", *r6("fused"), "n_flagged", "n_sentences")


@query("a03_confidence", f"""WITH {TIERED} SELECT doc_id, round(CASE WHEN count(*) FILTER (is_claim) = 1 THEN 0.75 ELSE coalesce(avg((hallushift + 1 - sep_entropy) / 2) FILTER (is_claim), 1.0) END + 1e-10, 6) AS confidence, count(*) FILTER (is_claim) AS n_claims FROM h GROUP BY doc_id""")
def _(spark, d):
    rows = lines(spark, d).withColumn("sep_accuracy", F.col("hallushift")).withColumns({"answer_entropy": F.lit(0.25), "answer_accuracy": F.lit(0.75)})
    return rollup.confidence(rows, "doc_id").select("doc_id", *r6_tied("confidence"), "n_claims")


@query("w03_relative_marks", f"""WITH {TIERED}, m AS (SELECT *, max(fused) OVER (PARTITION BY doc_id) AS most FROM h) SELECT doc_id, pos, round(CASE WHEN tier = 'high' THEN 0.22 + 0.45 * fused / most WHEN tier = 'medium' THEN 0.20 + 0.35 * fused / most END, 6) AS alpha FROM m""")
def _(spark, d):
    return rollup.relative(lines(spark, d), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), *r6("alpha"))


@query("answer_risk")
def _(spark, d):
    """Sentences of all documents, claims by rule, surrogate scores, fusion, tiers, and the headline."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", "s.sentence")
    n, words = F.length("sentence"), F.split("sentence", r"\s+")
    rows = rows.withColumns({"sep_entropy": cut(F.size(F.array_distinct(words)) / F.size(words)), "hallushift": cut((n - F.length(F.replace(F.col("sentence"), F.lit("e"), F.lit("")))) / n), "tsv_margin": cut(F.lit(0.5) - n / (n + 2000))})
    rows = rows.withColumn("fused", F.when(T.is_claim(F.col("sentence")), S.model_score("l1b")))
    rows = rows.withColumn("tier", S.tier(F.col("fused"), *S.THRESHOLDS["l1b"]))
    return rollup.headline(rows, "doc_id", *S.THRESHOLDS["l1b"])


@query("w09_risk_series", "WITH r AS (SELECT user_id, ts, event_id, value AS risk FROM events WHERE value IS NOT NULL) SELECT event_id, 'Q' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS label, risk FROM r")
def _(spark, d):
    return rollup.series(table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("risk")), "user_id", "event_id").select("event_id", "label", "risk")


@query("w04_step_differences", "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS step FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6).alias("step"))


# Splits, samples and slices; md5 keys are the same in both engines.
def _key(seed: int, column: str = "CAST(doc_id AS VARCHAR)") -> str:
    return f"md5({column} || ':{seed}')"


@query("k07_stratified_split", f"WITH {LABELLED}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY {_key(42)}, doc_id) AS r, count(*) OVER (PARTITION BY y) AS c FROM labelled) SELECT doc_id, CASE WHEN r <= ceil(0.25 * c) THEN 'test' ELSE 'train' END AS split FROM r")
def _(spark, d):
    return splits.stratified(labelled(spark, d), "y", "doc_id", 0.25).select("doc_id", "split")


@query("k08_group_split", f"SELECT doc_id, CASE WHEN CAST('0x' || substring({_key(0, 'source')}, 1, 8) AS BIGINT) / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    return splits.grouped(table(spark, d, "documents"), "source", 0.25).select("doc_id", "split")


@query("k09_a30_folds", f"WITH {LABELLED} SELECT doc_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {_key(0)}, doc_id) - 1) % 5 AS INT) AS fold FROM labelled")
def _(spark, d):
    return splits.folds(labelled(spark, d), "y", "doc_id").select("doc_id", "fold")


@query("k11_nested_split", f"""WITH {LABELLED}, r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {_key(42)}, doc_id) AS r, count(*) OVER (PARTITION BY y) AS c FROM labelled), t AS (SELECT * FROM r WHERE r > ceil(0.25 * c))
    , s AS (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY {_key(1)}, doc_id) AS r, count(*) OVER (PARTITION BY y) AS c FROM t) SELECT doc_id, CASE WHEN r <= ceil(0.2 * c) THEN 'test' ELSE 'train' END AS split FROM s""")
def _(spark, d):
    train = splits.stratified(labelled(spark, d), "y", "doc_id", 0.25).where("split = 'train'").drop("split")
    return splits.stratified(train, "y", "doc_id", 0.2, seed=1).select("doc_id", "split")


@query("k01_slice", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return splits.page(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 50, 100)


@query("k03_head_per_class", f"WITH {LABELLED} SELECT doc_id, y FROM (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS r FROM labelled) WHERE r <= 20")
def _(spark, d):
    return splits.first_per(labelled(spark, d).select("doc_id", "y"), "y", ["doc_id"], 20)


@query("k04_sample", f"SELECT doc_id FROM documents ORDER BY {_key(0)}, doc_id LIMIT 60")
def _(spark, d):
    return splits.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 60)


@query("k05_weights_by_size", "SELECT * FROM (VALUES ('sep_entropy', 4.5894), ('hallushift', 0.2780), ('tsv_margin', 0.2890)) t(feature, weight)")
def _(spark, d):
    names, _m, _s, coef, _i = S.MODELS["l1b"]
    return spark.createDataFrame(list(zip(names, coef, strict=True)), "feature string, weight double").orderBy(F.abs("weight").desc())


@query("k06_confident_rows", f"""WITH {LABELLED}, r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY sep_entropy, doc_id) AS r, count(*) OVER (PARTITION BY y) AS c FROM labelled), g AS (SELECT bool_or(y = 1 AND c < 12 OR y = 0 AND c < 28) AS short FROM r)
    SELECT doc_id FROM r, g WHERE NOT short AND r <= CASE y WHEN 1 THEN 12 ELSE 28 END
    UNION ALL SELECT doc_id FROM (SELECT doc_id FROM labelled, g WHERE short ORDER BY sep_entropy, doc_id LIMIT 40)""")
def _(spark, d):
    return splits.confident(labelled(spark, d), "y", "sep_entropy", {1: 0.3, 0: 0.7}, 40, "doc_id").select("doc_id")


# Sources, joins and reshaping.
@query("w07_dedupe", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _(spark, d):
    return splits.first_per(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 1)


@query("p10_min_chars", "SELECT doc_id, substring(text, 1, 3000) AS evidence, 'Tell me about ' || source || '.' AS prompt FROM documents WHERE length(text) >= 200 AND trim(text) <> ''")
def _(spark, d):
    docs = table(spark, d, "documents").where((F.length("text") >= 200) & (F.trim("text") != ""))
    return docs.select("doc_id", F.substring("text", 1, 3000).alias("evidence"), F.format_string("Tell me about %s.", "source").alias("prompt"))


@query("u03_distinct_union", "SELECT source, list_sort(list_distinct(list(lang) || ['en'])) AS langs, 'qa:' || source AS tag FROM documents GROUP BY source")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return g.select("source", F.array_sort(F.array_distinct(F.concat("l", F.array(F.lit("en"))))).alias("langs"), F.concat(F.lit("qa:"), "source").alias("tag"))


@query("w05_running_context", """SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' THEN ' Q: ' ELSE ' A: ' END || text || CASE WHEN text LIKE '%.' THEN '' ELSE '.' END, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def _(spark, d):
    """What was said before each turn."""
    said = F.concat(F.when(F.col("role") == "user", " Q: ").otherwise(" A: "), "text", F.when(F.endswith("text", F.lit(".")), "").otherwise("."))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").withColumn("said", said).select("conv_id", "turn", F.array_join(F.collect_list("said").over(w), "").alias("context"))


@query("u05_question_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)})
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("p05_source_mask", "SELECT doc_id, CASE WHEN source LIKE '%1%' THEN 'judge' ELSE 'reference' END AS labeller FROM documents WHERE lang = 'en'")
def _(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.when(F.contains("source", F.lit("1")), "judge").otherwise("reference").alias("labeller"))


@query("j06_keyed_join", f"WITH {SCORES} SELECT s.doc_id, sep_entropy, quality, toxic FROM scores s JOIN labels l ON l.doc_id = s.doc_id")
def _(spark, d):
    """Tables are joined by key, where rows were matched by position."""
    return scores(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id").select("doc_id", "sep_entropy", "quality", "toxic")


@query("j13_m17_thresholds", f"WITH {SCORES}, t AS (SELECT * FROM (VALUES ('s1', 0.7, 0.9), ('l1b', 0.245, 0.409), ('8bv2', 0.588, 0.98)) t(tag, t_med, t_high)) SELECT doc_id, tag, CASE WHEN sep_entropy >= t_high THEN 'high' WHEN sep_entropy >= t_med THEN 'medium' ELSE 'ok' END AS tier FROM scores, t")
def _(spark, d):
    """Three rows of thresholds, broadcast."""
    t = spark.createDataFrame([(k, *v) for k, v in S.THRESHOLDS.items()], "tag string, t_med double, t_high double")
    return scores(table(spark, d, "documents")).join(F.broadcast(t)).select("doc_id", "tag", S.tier(F.col("sep_entropy"), F.col("t_med"), F.col("t_high")).alias("tier"))


@query("k03_first_steps", "SELECT user_id, count(*) AS steps, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE k >= 1 AND k < 4 GROUP BY user_id HAVING count(*) >= 2")
def _(spark, d):
    """Steps [1, 4) of each user, where there are two at least."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, d, "events").withColumn("k", k).where("k >= 1 and k < 4")
    return rows.groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.avg("value"), 6).alias("mean")).where("steps >= 2")


@query("u01_u02_union", "SELECT 'doc' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'item', item_id, NULL FROM benchmark")
def _(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id")), allowMissingColumns=True)


@query("u05_u06_p11_columns", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS hs_feat_00, CAST(embedding[2] AS DOUBLE) AS hs_feat_01, CAST(embedding[3] AS DOUBLE) AS hs_feat_02 FROM embeddings")
def _(spark, d):
    wide = vectors(spark, d).select("vec_id", *(F.get("v", F.lit(i)).alias(f"hs_feat_{i:02}") for i in range(3)))
    return wide.select("vec_id", *(c for c in wide.columns if c.startswith("hs_feat_")))


@query("u07_transpose", f"WITH {LABELLED} SELECT * FROM (SELECT 'hallushift' AS detector, round(avg(hallushift) FILTER (y = 0), 6) AS good, round(avg(hallushift) FILTER (y = 1), 6) AS bad FROM labelled UNION ALL SELECT 'sep_entropy', round(avg(sep_entropy) FILTER (y = 0), 6), round(avg(sep_entropy) FILTER (y = 1), 6) FROM labelled UNION ALL SELECT 'tsv_margin', round(avg(tsv_margin) FILTER (y = 0), 6), round(avg(tsv_margin) FILTER (y = 1), 6) FROM labelled)")
def _(spark, d):
    rows = long(labelled(spark, d)).withColumn("class", F.when(F.col("y") == 1, "bad").otherwise("good"))
    return rows.groupBy("detector").pivot("class", ["good", "bad"]).agg(F.round(F.avg("s"), 6))


@query("p04_p07_p08_projection", "SELECT doc_id AS row_id, quality AS label, '' AS true_label FROM labels WHERE quality >= 0")
def _(spark, d):
    from candor.operators.labels import usable

    rows = table(spark, d, "labels").withColumnsRenamed({"doc_id": "row_id", "quality": "label"}).withColumn("evidence", F.lit(""))
    return usable(rows).withColumn("true_label", F.lit("")).select("row_id", "label", "true_label")


@query("p09_short_answers", f"WITH {LABELLED} SELECT count(*) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS positives FROM labelled WHERE n <= 400")
def _(spark, d):
    return labelled(spark, d).where("n <= 400").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("positives"))


@query("t42_expected_tiers", f"WITH {TIERED} SELECT doc_id, pos, CASE WHEN doc_id % 2 = 0 THEN tier = 'ok' ELSE tier IN ('high', 'medium') END AS met FROM h WHERE tier <> 'filler'")
def _(spark, d):
    rows = lines(spark, d).where("tier <> 'filler'")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), S.expected_tier(F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("flag"), F.col("tier")).alias("met"))
