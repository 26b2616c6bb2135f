"""Sources and sinks, judges, and joins of scores, on tables shaped as the sources have them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import arrays as A
from candor.functions import scores as S
from candor.functions import text as T
from candor.operators import labels as L
from candor.operators.fitting import Fusion
from candor.plans.base import SCORES, fused_sql, r6, scores, sql_text, table, values
from candor.plans.number_queries import TIERED, lines, vectors
from candor.plans.text_queries import CHUNKS, NORM, TOKENS
from candor.sources import files, qa
from candor.streaming import score_log

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Question-answer sources.
@query("s02_truthfulqa", "SELECT text AS question, [substring(text, 1, 9), 'x', substring(text, 1, 9)] AS refs FROM benchmark ORDER BY text LIMIT 20 OFFSET 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Repeated answers stay."""
    raw = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.array(F.substring("text", 1, 9), F.lit("x")).alias("correct_answers"), F.substring("text", 1, 9).alias("best_answer"))
    return qa.load(raw, "truthfulqa", 20, 5)


@query("s01_s03_triviaqa", """WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 3156), r AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id // 3 ORDER BY doc_id) AS r FROM f)
    SELECT 'Q' || doc_id AS question, list_filter([lang, '', 'v' || doc_id], lambda x: x IS NOT NULL AND x <> '') AS refs FROM r WHERE r = 1 ORDER BY doc_id LIMIT 50 OFFSET 2""")
def _(spark, d):
    """A bounded scan, and the first row of each question."""
    raw = table(spark, d, "documents").select(F.concat_ws(":", F.col("source"), F.floor(F.col("doc_id") / 3)).alias("question_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("Q"), "doc_id").alias("question"), F.array("lang", F.lit("")).alias("aliases"), F.concat(F.lit("v"), "doc_id").alias("value"))
    return qa.load(raw, "triviaqa", 50, 2)


@query("s04_nq_open_web_questions", "SELECT * FROM (SELECT text AS question, [CAST(item_id AS VARCHAR)] AS refs FROM benchmark ORDER BY text LIMIT 30) UNION ALL SELECT * FROM (SELECT text, ['w', CAST(item_id AS VARCHAR)] FROM benchmark ORDER BY text LIMIT 30 OFFSET 10)")
def _(spark, d):
    raw = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.array(F.col("item_id").cast("string")).alias("answer"), F.array(F.lit("w"), F.col("item_id").cast("string")).alias("answers"))
    return qa.load(raw, "nq_open", 30).unionByName(qa.load(raw, "web_questions", 30, 10))


@query("s05_squad", "SELECT text AS question, CASE WHEN item_id % 2 = 0 THEN ['even', substring(text, 1, 4)] ELSE ['odd'] END AS refs FROM benchmark")
def _(spark, d):
    """Answers once each, in their order."""
    own = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("even"), F.substring("text", 1, 4), F.lit("even"))).otherwise(F.array(F.lit("odd"), F.lit("odd")))
    return qa.load(table(spark, d, "benchmark").select(F.col("text").alias("question"), F.struct(own.alias("text")).alias("answers")), "squad")


@query("s06_hotpotqa", "SELECT text AS question, [substring(text, 1, 7)] AS refs FROM benchmark")
def _(spark, d):
    """The first configuration isn't there, the second is."""
    raw = qa.read_first(spark, f"{d}/no_such_configuration.parquet", f"{d}/benchmark.parquet")
    return qa.load(raw.select(F.col("text").alias("question"), F.substring("text", 1, 7).alias("answer")), "hotpotqa")


@query("s07_popqa", "SELECT text AS question, [substring(text, 1, 5), CAST(item_id AS VARCHAR)] AS refs FROM benchmark ORDER BY md5(text || ':42'), text LIMIT 25 OFFSET 5")
def _(spark, d):
    raw = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.to_json(F.array(F.substring("text", 1, 5), F.col("item_id").cast("string"))).alias("possible_answers"))
    return qa.load(raw, "popqa", 25, 5)


@query("s08_sciq", "SELECT text AS question, [substring(text, 3, 5)] AS refs FROM benchmark ORDER BY md5(text || ':42'), text LIMIT 25")
def _(spark, d):
    return qa.load(table(spark, d, "benchmark").select(F.col("text").alias("question"), F.substring("text", 3, 5).alias("correct_answer")), "sciq", 25)


@query("s09_k10_articles", "SELECT 'T' || doc_id AS title, 'Tell me about T' || doc_id || '.' AS prompt, substring(text, 1, 500) AS evidence FROM documents WHERE length(text) >= 400 ORDER BY md5('T' || doc_id || ':0') LIMIT 30")
def _(spark, d):
    return qa.articles(table(spark, d, "documents").select(F.concat(F.lit("T"), "doc_id").alias("title"), "text"), 30, 400, 500)


@query("s10_u02_items", "SELECT 'wiki' AS source, CAST(doc_id AS VARCHAR) AS question FROM documents UNION ALL SELECT 'qa:squad', text FROM benchmark")
def _(spark, d):
    """Items of sources under their tags."""
    wiki = table(spark, d, "documents").select(F.lit("wiki").alias("source"), F.col("doc_id").cast("string").alias("question"))
    raw = table(spark, d, "benchmark").select(F.col("text").alias("question"), F.struct(F.array(F.lit("a")).alias("text")).alias("answers"))
    return wiki.unionByName(qa.load(raw, "squad").select(F.lit("qa:squad").alias("source"), "question"))


@query("s11_tydiqa_halueval", """SELECT text AS question, [lang] AS refs FROM documents WHERE contains(CASE WHEN lang = 'en' THEN 'english-' || doc_id ELSE lang END, 'english')
    UNION ALL SELECT 'k ' || text, ['r' || item_id] FROM benchmark UNION ALL SELECT 'K ' || text, ['a' || item_id] FROM benchmark UNION ALL SELECT text, ['s' || item_id] FROM benchmark""")
def _(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    tydi = docs.select(F.when(F.col("lang") == "en", F.concat(F.lit("english-"), "doc_id")).otherwise(F.col("lang")).alias("id"), F.col("text").alias("question"), F.struct(F.array("lang", "lang").alias("text")).alias("answers"))
    n = lambda x: F.concat(F.lit(x), "item_id")
    out = qa.load(tydi, "tydiqa")
    for name, raw in (
        ("halueval_dialogue", b.select(F.lit("k").alias("knowledge"), F.col("text").alias("dialogue_history"), n("r").alias("right_response"))),
        ("halueval_qa", b.select(F.lit("K").alias("knowledge"), F.col("text").alias("question"), n("a").alias("right_answer"))),
        ("halueval_summarization", b.select(F.col("text").alias("document"), n("s").alias("right_summary"))),
    ):
        out = out.unionByName(qa.load(raw, name))
    return out


STORIES = [
    ("a", "A cat sat.", [("Who sat?", "a cat", ["the cat", "cat", "a cat"]), ("Where?", "on a mat.", ["mat", "the mat", "a mat"]), ("Why?", "unknown", ["no", "none", "?"])]),
    ("b", "It rained.", [("Did it rain?", "yes", ["Yes", "yes.", "it did"])]),
]


@query("s12_coqa", f"""WITH t AS (SELECT * FROM {values([(i, n, s, q, a, m) for i, s, turns in STORIES for n, (q, a, m) in enumerate(turns)], 'id, turn, story, question, answer, more')})
    SELECT id, turn, story || coalesce(string_agg(' Q: ' || question || ' A: ' || answer || CASE WHEN answer LIKE '%.' THEN '' ELSE '.' END, '') OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context, question, [answer] || more AS answers FROM t""")
def _(spark, d):
    """Stories in one JSON file, to turns with what was said before."""
    said = lambda texts: [{"input_text": x} for x in texts]
    data = [{"id": i, "story": s, "questions": said(q for q, _, _ in turns), "answers": said(a for _, a, _ in turns), "additional_answers": {str(k): said(m[k] for _, _, m in turns) for k in range(3)}} for i, s, turns in STORIES]
    path = files.scratch(spark, "coqa")
    spark.createDataFrame([(json.dumps({"data": data}),)], "value string").coalesce(1).write.text(path)
    return qa.coqa(spark, path).withColumn("turn", F.col("turn").cast("int"))


# Files.
@query("s13_s14_s18_s19_round_trips", f"WITH {SCORES} SELECT doc_id, sep_entropy AS parquet, sep_entropy AS jsonl, sep_entropy AS csv FROM scores")
def _(spark, d):
    """A table written and read in three formats."""
    rows = scores(table(spark, d, "documents")).select("doc_id", "sep_entropy")
    paths = {k: files.scratch(spark, k) for k in ("parquet", "jsonl", "csv")}
    rows.write.parquet(paths["parquet"])
    files.write_jsonl(rows, paths["jsonl"])
    files.write_sheet(rows, paths["csv"])
    back = spark.read.parquet(paths["parquet"]).withColumnRenamed("sep_entropy", "parquet")
    back = back.join(spark.read.schema("doc_id long, sep_entropy double").json(paths["jsonl"]).withColumnRenamed("sep_entropy", "jsonl"), "doc_id")
    return back.join(spark.read.schema("doc_id long, sep_entropy double").option("header", True).csv(paths["csv"]).withColumnRenamed("sep_entropy", "csv"), "doc_id")


@query("s15_j06_side_table", "SELECT vec_id, label, CAST(len(embedding) AS INT) AS width FROM embeddings")
def _(spark, d):
    """Rows and their feature arrays in another file, with a check that they match row for row."""
    rows, path = table(spark, d, "embeddings"), files.scratch(spark, "features")
    rows.select("vec_id", "embedding").write.parquet(path)
    return files.with_features(rows.select("vec_id", "label"), spark.read.parquet(path), "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


@query("s16_s17_d11_claim_log", f"WITH {TIERED} SELECT CAST(doc_id AS VARCHAR) AS question, round(fused, 6) AS fused, tier FROM h WHERE is_claim AND fused IS NOT NULL")
def _(spark, d):
    """Answers appended to the log in two goes, read again, a row per scored claim."""
    one = F.struct(F.col("line").alias("sentence"), "is_claim", "fused", "tier", "sep_entropy", F.lit(None).cast("double").alias("sep_accuracy"), "hallushift", "tsv_margin")
    answers = lines(spark, d).groupBy("doc_id").agg(F.collect_list(one).alias("sentences"))
    log = answers.select("doc_id", F.lit("2024-05-01 12:00:00").alias("ts"), F.lit("8bv2").alias("model"), F.col("doc_id").cast("string").alias("question"), F.lit("").alias("answer"), "sentences")
    path = files.scratch(spark, "log")
    for part in (0, 1):
        score_log.append(log.where(F.col("doc_id") % 2 == part).drop("doc_id"), path)
    return score_log.claims(score_log.read(spark, path)).select("question", F.round("s.fused", 6).alias("fused"), "s.tier")


@query("s21_zipped", "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    return files.zipped(rows.select("vec_id", "label"), rows.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first")), "vec_id")


@query("s20_s21_line_files", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') AS left, coalesce(lang, '') AS right FROM documents")
def _(spark, d):
    """Texts and languages as two line files, read again and zipped by line number."""
    docs, paths = table(spark, d, "documents").select("doc_id", "text", "lang"), [files.scratch(spark, x) for x in ("texts", "languages")]
    for column, path in zip(("text", "lang"), paths, strict=True):
        files.write_lines(docs, column, path, "doc_id")
    return files.zipped_lines(spark, *paths)


@query("s22_thresholds", "SELECT * FROM (VALUES ('written', 0.245, 0.409), ('missing', 0.5, 0.74)) t(file, t_med, t_high)")
def _(spark, d):
    path = files.scratch(spark, "thresholds")
    files.write_thresholds(spark, path, *S.THRESHOLDS["l1b"])
    return spark.createDataFrame([("written", *files.thresholds(spark, path)), ("missing", *files.thresholds(spark, path + "-none"))], "file string, t_med double, t_high double")


@query("s23_a05_batch_model", "SELECT doc_id, CAST(coalesce(length(text), 0) AS DOUBLE) AS s FROM documents")
def _(spark, d):
    """A model called batch by batch; here it counts characters."""
    return files.scored_by(table(spark, d, "documents").select("doc_id", "text"), lambda b: b["text"].fillna("").str.len().astype(float), "s").select("doc_id", "s")


@query("s24_j13_stored_model", f"WITH {SCORES} SELECT doc_id, round({fused_sql('l1b')}, 6) AS fused FROM scores")
def _(spark, d):
    """A fusion kept as a table of parameters."""
    path = files.scratch(spark, "model")
    names, mean, scale, coef, intercept = S.MODELS["l1b"]
    Fusion(names, mean, scale, coef, intercept).frame(spark).write.parquet(path)
    return scores(table(spark, d, "documents")).select("doc_id", F.round(Fusion.read(spark.read.parquet(path)).score(), 6).alias("fused"))


@query("s25_requests", f"SELECT CAST(doc_id AS VARCHAR) AS question, {NORM.format('text')} AS answer FROM documents")
def _(spark, d):
    """Request files in, response files out."""
    paths = [files.scratch(spark, k) for k in ("requests", "responses", "seen")]
    files.write_jsonl(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("question"), "text"), paths[0])
    score_log.respond(spark, *paths, lambda rows: rows.select("question", T.norm(F.col("text")).alias("answer")))
    return spark.read.schema("question string, answer string").json(paths[1])


# Filters, guards and joins.
@query("p03_scored_claims", f"WITH {TIERED} SELECT doc_id, count(*) AS claims, round(max(fused), 6) AS most FROM h WHERE fused IS NOT NULL GROUP BY doc_id")
def _(spark, d):
    return lines(spark, d).where("fused is not null").groupBy("doc_id").agg(F.count("*").alias("claims"), F.round(F.max("fused"), 6).alias("most"))


@query("p12_guards", "SELECT * FROM (VALUES ('empty', 'no rows left'), ('one class', 'a single class'), ('row counts', 'the tables have different numbers of rows'), ('fine', '')) t(tables, refused)")
def _(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality").where("quality is not null")

    def refused(df: DataFrame, other: DataFrame | None = None) -> str:
        try:
            L.check(df, "quality", other)
        except ValueError as e:
            return str(e).split(":")[0]
        return ""

    cases = [("empty", refused(rows.where("false"))), ("one class", refused(rows.where("quality = 0"))), ("row counts", refused(rows, rows.where("quality = 0"))), ("fine", refused(rows, rows))]
    return spark.createDataFrame(cases, "tables string, refused string")


@query("j07_aligned", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    """Two tables of equal length, by key."""
    rows = table(spark, d, "labels")
    return files.zipped(rows.select("doc_id", "quality"), rows.select("doc_id", "toxic"), "doc_id")


@query("j08_two_passes", f"WITH {SCORES} SELECT doc_id, sep_entropy, CASE WHEN doc_id % 2 = 0 THEN tsv_margin END AS tsv_margin FROM scores")
def _(spark, d):
    """The second pass scored some of the rows."""
    rows = scores(table(spark, d, "documents"))
    return files.attached(rows.select("doc_id", "sep_entropy"), rows.where("doc_id % 2 = 0").select("doc_id", "tsv_margin"), "doc_id", ["tsv_margin"])


_C, _I = "array_slice(string_split(text, ' '), 1, 4)", "array_slice(string_split(text, ' '), 3, 9)"


@query("j03_a07_l07_references", f"""WITH p AS (SELECT item_id, text, array_to_string({_C}, ' ') AS c, array_to_string({_I}, ' ') AS i, item_id % 3 = 0 AS none FROM benchmark)
    , s AS (SELECT item_id, CASE WHEN none THEN -1e9 ELSE len(list_intersect({TOKENS.format('text')}, {TOKENS.format('c')})) / (len({TOKENS.format('c')}) + item_id % 2) END AS c, CASE WHEN none THEN -1e9 ELSE len(list_intersect({TOKENS.format('text')}, {TOKENS.format('i')})) / (len({TOKENS.format('i')}) + 1) END AS i FROM p)
    SELECT item_id, CASE WHEN c > i THEN 0 ELSE 1 END AS label FROM s""")
def _(spark, d):
    """Answers with the correct and incorrect references of their question; a third of the questions has none."""
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"), F.split("text", " ").alias("w"))
    refs = rows.where("item_id % 3 <> 0").select("item_id", F.array(F.array_join(F.slice("w", 1, 4), " ")).alias("correct"), F.array(F.array_join(F.slice("w", 3, 7), " ")).alias("incorrect"))
    pairs = L.answer_pairs(rows, "item_id", "answer", refs)
    extra = F.when(F.col("kind") == "correct", F.col("item_id") % 2).otherwise(1)
    return L.comparative(pairs.withColumn("score", T.overlap(F.col("answer"), F.col("ref")) / (F.size(T.tokens(F.col("ref"))) + extra)), "item_id")


@query("j14_sentence_slices", """WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id), r AS (SELECT unnest([0, 1, 2]) AS k, unnest([0, 1, 3]) AS a, unnest([1, 4, 9]) AS b)
    SELECT user_id, k, round(CASE WHEN len(v[a + 1 : b]) >= 2 THEN list_sum(v[a + 1 : b]) / len(v[a + 1 : b]) ELSE list_sum(v) / len(v) END, 6) AS score FROM s, r""")
def _(spark, d):
    """Scores of step ranges; the answer's own where a range has fewer than two steps."""
    steps = table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("value").cast("double").alias("value")))), lambda x: x["value"]).alias("v"))
    ranges = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate([(0, 1), (1, 4), (3, 9)])))
    rows = steps.select("user_id", "v", (A.total(F.col("v")) / F.size("v")).alias("own"), F.inline(ranges))
    return rows.select("user_id", "k", F.round(A.sliced_mean(F.col("v"), F.col("a"), F.col("b"), F.col("own")), 6).alias("score"))


# Vectors.
_PAIRS = "list_transform(range(1, 7), lambda i: {f})"
_W = "list_avg(list_transform(range(1, 65), lambda k: abs(list_sort({x}[i])[k] - list_sort({x}[i + 1])[k])))"
_COS = "list_cosine_similarity({x}[i], {x}[i + 1])"
_MID = "({x}[1] + {x}[2]) / 2 + abs({x}[2] - {x}[1]) * ({q} - 0.5)"


@query("m04_m11_a08_feature_vector", f"""WITH e AS (SELECT vec_id // 32 AS gen, (vec_id // 16) % 2 AS step, vec_id % 16 AS layer, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    , s AS (SELECT gen, step, layer, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM e)
    , g AS (SELECT gen, step, list(p ORDER BY layer) FILTER (layer >= 2 AND layer % 2 = 0) AS h, list(p ORDER BY layer) FILTER (layer <= 13 AND layer % 2 = 1) AS a, max(list_max(p)) FILTER (layer = 14) AS hi, max(list_min(p)) FILTER (layer = 14) AS lo FROM s GROUP BY ALL HAVING count(*) = 16)
    , f AS (SELECT gen, step, {_PAIRS.format(f=_W.format(x='h'))} || {_PAIRS.format(f=_COS.format(x='h'))} || {_PAIRS.format(f=_W.format(x='a'))} || {_PAIRS.format(f=_COS.format(x='a'))} AS f, hi, lo FROM g)
    , b AS (SELECT gen, list(f ORDER BY step) AS f, list(hi ORDER BY step) AS hi, list(lo ORDER BY step) AS lo FROM f GROUP BY gen HAVING count(*) = 2)
    , x AS (SELECT gen, list_transform(range(1, 25), lambda i: (f[1][i] + f[2][i]) / 2) || [list_min(hi), greatest(hi[1] - lo[1], hi[2] - lo[2]), -(hi[1] * ln(hi[1]) + hi[2] * ln(hi[2])) / ln(2), -(lo[1] * ln(lo[1]) + lo[2] * ln(lo[2])) / ln(2), len(list_filter(hi, lambda z: z < 0.1)), len(list_filter(lo, lambda z: z < 0.1)), abs(hi[2] - hi[1]), abs(lo[2] - lo[1]), {_MID.format(x='hi', q=0.25)}, {_MID.format(x='hi', q=0.5)}, {_MID.format(x='hi', q=0.75)}] AS x FROM b)
    SELECT gen, len(x) AS width, unnest(range(0, 35)) AS k, round(unnest(x), 7) AS value FROM x""")
def _(spark, d):
    """Sixteen vectors stand for the layers of a step (14 and the embedding below, attention in the odd ones), two steps for a
    generation: 4 * (14 / 2 - 1) + 11 = 35 features, in the models' order."""
    rows = vectors(spark, d).select(F.floor(F.col("vec_id") / 32).alias("gen"), (F.floor(F.col("vec_id") / 16) % 2).alias("step"), (F.col("vec_id") % 16).alias("layer"), "v")
    steps = rows.groupBy("gen", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "v"))), lambda x: x["v"]).alias("l")).where("size(l) = 16")
    p = A.softmax(F.get("l", F.lit(14)))
    steps = steps.select("gen", "step", A.layer_features(F.col("l"), F.col("l"), F.lit(14)).alias("f"), F.array_max(p).alias("hi"), F.array_min(p).alias("lo"))
    layers = steps.select("gen", F.posexplode("f").alias("k", "x")).groupBy("gen", "k").agg(F.avg("x").alias("x")).groupBy("gen").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda x: x["x"]).alias("f"))
    probs = steps.groupBy("gen").agg(F.array_sort(F.collect_list(F.struct("step", "hi", "lo"))).alias("s")).where("size(s) = 2")
    out = layers.join(probs, "gen").select("gen", F.concat("f", A.statistics(F.col("s.hi"), F.col("s.lo"))).alias("f"))
    return out.select("gen", F.size("f").cast("long").alias("width"), F.posexplode("f").alias("k", "value")).select("gen", "width", F.col("k").cast("long").alias("k"), F.round("value", 7).alias("value"))


@query("m22_last_real", "SELECT vec_id, CAST(embedding[vec_id % 64 + 1] AS DOUBLE) AS value FROM embeddings")
def _(spark, d):
    """The last place that isn't padding."""
    mask = F.transform("v", lambda _, i: F.when(i <= F.col("vec_id") % 64, 1).otherwise(0))
    return vectors(spark, d).select("vec_id", A.last_real(F.col("v"), mask).alias("value"))


@query("m26_score_vector", f"WITH {SCORES} SELECT doc_id, [sep_entropy, hallushift, tsv_margin] AS scores FROM scores")
def _(spark, d):
    return scores(table(spark, d, "documents")).select("doc_id", S.score_vector().alias("scores"))


@query("t04_bullets", f"SELECT conv_id, turn, regexp_matches(text, {sql_text(T.BULLET)}) AS bullet FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_bullet(F.col("text")).alias("bullet"))


# Judges: an overlap of words stands for the model's opinion.
def _supports(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reply", F.when(T.overlap(F.col("claim"), F.col("evidence")) >= 8, "Yes.").otherwise("No, it is not."))


_JUDGED = f"""{CHUNKS}, q AS (SELECT doc_id, array_to_string(list_reverse(string_split(substring(text, 1, 90), ' ')), ' ') AS claim FROM documents)
    , x AS (SELECT c.doc_id, n, chunk, claim, len(list_intersect({TOKENS.format('chunk')}, {TOKENS.format('claim')})) AS o FROM chunks c JOIN q USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, n) AS r FROM x)
    , v AS (SELECT doc_id, substring(string_agg(chunk, ' ' ORDER BY r), 1, 3000) AS evidence FROM r WHERE r <= 4 GROUP BY doc_id)
    , judged AS (SELECT q.doc_id, claim, CASE WHEN len(list_intersect({TOKENS.format('claim')}, {TOKENS.format("coalesce(evidence, '')")})) >= 8 THEN 0 ELSE 1 END AS label FROM q LEFT JOIN v USING (doc_id))"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim about each document: its first words, backwards."""
    said = F.array_join(F.reverse(F.split(F.substring("text", 1, 90), " ")), " ")
    return table(spark, d, "documents").select("doc_id", "lang", said.alias("claim"), "text")


@query("l02_t28_t29_grounded_judge", f"WITH {_JUDGED} SELECT doc_id, label FROM judged")
def _(spark, d):
    """The four chunks of a document that overlap most with a claim, a prompt, a judge, a verdict."""
    return L.grounded_judge(_claims(spark, d), "claim", "text", _supports).select("doc_id", "label")


@query("l03_qa_judge", f"WITH q AS (SELECT item_id, {NORM.format('text')} AS c, CASE WHEN item_id % 2 = 0 THEN substring(text, 5, 12) ELSE 'zzzz' END AS r FROM benchmark) SELECT item_id, CASE WHEN {NORM.format('r')} <> '' AND contains(c, {NORM.format('r')}) THEN 0 ELSE 1 END AS label FROM q")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.lit("Which?").alias("question"), F.col("text").alias("claim"), F.array(F.when(F.col("item_id") % 2 == 0, F.substring("text", 5, 12)).otherwise("zzzz")).alias("refs"))
    right = T.reference_label(F.col("claim"), F.col("refs")) == 0
    return L.qa_judge(rows, "question", "claim", "refs", lambda r: r.withColumn("reply", F.when(right, "CORRECT").otherwise("INCORRECT"))).select("item_id", "label")


@query("l08_p05_p06_relabelled", f"""WITH {_JUDGED}, l AS (SELECT j.doc_id, CASE WHEN d.lang = 'en' THEN 'wiki' ELSE 'qa:' || d.lang END AS source, CASE WHEN d.lang = 'en' THEN j.label WHEN {NORM.format("substring(d.text, 1, 6)")} <> '' AND contains({NORM.format('j.claim')}, {NORM.format("substring(d.text, 1, 6)")}) THEN 0 ELSE 1 END AS label, CASE WHEN j.doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM judged j JOIN documents d USING (doc_id))
    SELECT doc_id, source, label FROM l WHERE split = 'train'""")
def _(spark, d):
    """Raw claims labelled by their source, those with a label kept as a table, and its training part read."""
    raw = _claims(spark, d).select("doc_id", "claim", F.col("text").alias("evidence_text"), F.when(F.col("lang") == "en", "wiki").otherwise(F.concat(F.lit("qa:"), "lang")).alias("source"), F.array(F.substring("text", 1, 6)).alias("refs"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    path = files.scratch(spark, "claims")
    L.usable(L.by_source(raw, "claim", "evidence_text", "refs", _supports)).drop("evidence_text").write.parquet(path)
    return spark.read.parquet(path).where("split = 'train'").select("doc_id", "source", "label")
