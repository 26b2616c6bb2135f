"""Reference answers, spans, extraction, weights, thresholds, conversations and inline marks over the given tables.

Questions, answers and references are cut from benchmark items and the documents of the same number: an answer is a passage of the
item, the beginning of the document, or the first reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.operators import labels as L
from candor.plans.base import LONG, labelled, long, r6, scores, SCORES, table
from candor.plans.text_queries import NORM, SQUAD, TOKENS
from candor.sources import files, qa

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


QA = """w AS (SELECT b.item_id AS id, string_split(b.text, ' ') AS w, coalesce(d.text, '') AS doc FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
    , qa AS (SELECT id, w, array_to_string(w[1:6], ' ') AS question, CASE id % 3 WHEN 0 THEN array_to_string(w[5:14], ' ') WHEN 1 THEN substring(doc, 1, 80) ELSE array_to_string(w[7:9], ' ') END AS answer
    , [array_to_string(w[7:9], ' '), array_to_string(w[2:3], ' '), CASE WHEN id % 5 = 0 THEN ' ' ELSE w[1] END] AS refs FROM w)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """id, w (words of the item), question, answer, refs."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("w"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("doc"))
    said = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    answer = F.when(F.col("id") % 3 == 0, said(5, 10)).when(F.col("id") % 3 == 1, F.substring("doc", 1, 80)).otherwise(said(7, 3))
    refs = F.array(said(7, 3), said(2, 2), F.when(F.col("id") % 5 == 0, " ").otherwise(F.get("w", F.lit(0))))
    return items.join(docs, "id").select("id", "w", said(1, 6).alias("question"), answer.alias("answer"), refs.alias("refs"))


@query("t23_t24_gold_of_items", f"""WITH {QA}, q AS (SELECT id, {SQUAD.format('answer')} AS a, {NORM.format('answer')} AS c, list_filter(list_transform(refs, lambda r: {SQUAD.format('r')}), lambda r: r <> '') AS s, list_filter(list_transform(refs, lambda r: {NORM.format('r')}), lambda r: r <> '') AS n FROM qa)
    SELECT id, len(list_filter(s, lambda r: r = a)) > 0 AS equal, a <> '' AND len(list_filter(s, lambda r: contains(a, r) OR contains(r, a))) > 0 AS either, len(list_filter(s, lambda r: contains(a, r))) > 0 AS inside, CASE WHEN len(list_filter(n, lambda r: contains(c, r))) > 0 THEN 0 ELSE 1 END AS label FROM q""")
def _(spark, d):
    found = T.gold_matches(F.col("answer"), F.col("refs"))
    return asked(spark, d).select("id", *(c.alias(n) for n, c in found.items()), T.reference_label(F.col("answer"), F.col("refs")).alias("label"))


@query("t30_u03_gold_of_items", f"WITH {QA} SELECT id, coalesce(nullif(array_to_string(list_filter(refs, lambda r: trim(r) <> ''), '; '), ''), '(unknown)') AS gold FROM qa")
def _(spark, d):
    return asked(spark, d).select("id", T.gold_string(F.col("refs")).alias("gold"))


@query("j01_j02_references_of_questions", f"""WITH {QA}, refs AS (SELECT {NORM.format('question')} AS k, arg_max(refs, id) AS refs FROM qa GROUP BY 1)
    , x AS (SELECT 'item ' || id AS asker, question || ' ?!' AS question FROM qa UNION ALL SELECT 'document ' || doc_id, array_to_string(string_split(text, ' ')[1:6], ' ') FROM documents WHERE text IS NOT NULL)
    SELECT asker, refs IS NOT NULL AS covered, coalesce(refs, CAST([] AS VARCHAR[])) AS refs FROM x LEFT JOIN refs ON k = {NORM.format('question')}""")
def _(spark, d):
    """References for the items' questions, and for the documents' beginnings, of which most have none."""
    items = asked(spark, d)
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("document "), "doc_id").alias("asker"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("question"))
    rows = items.select(F.concat(F.lit("item "), "id").alias("asker"), F.concat("question", F.lit(" ?!")).alias("question")).unionByName(docs)
    found = L.with_references(rows, "question", items.select("id", F.col("question").alias("q"), "refs"), "q", "id")
    return found.select("asker", (F.size("refs") > 0).alias("covered"), "refs")


@query("l04_hybrid_labels_of_items", f"""WITH {QA}, n AS (SELECT id, len(list_filter(list_transform(refs, lambda r: {NORM.format('r')}), lambda r: r <> '' AND contains({NORM.format('answer')}, r))) > 0 AS hit FROM qa)
    SELECT id, CASE WHEN hit THEN 0 ELSE CAST(id % 2 AS INT) END AS label, CASE WHEN hit THEN 'substring' ELSE 'judge' END AS source FROM n""")
def _(spark, d):
    return asked(spark, d).select("id", F.inline(F.array(L.hybrid(F.col("answer"), F.col("refs"), F.col("id") % 2))))


@query("j04_a04_l01_best_reference_of_items", f"""WITH {QA}, x AS (SELECT id, answer, unnest(refs) AS ref FROM qa), s AS (SELECT id, len(list_intersect({TOKENS.format('answer')}, {TOKENS.format('ref')})) / greatest(len({TOKENS.format('ref')}), 1) AS s FROM x)
    SELECT id, round(max(s), 6) AS score, CASE WHEN max(s) > 0.5 THEN 0 ELSE 1 END AS label FROM s GROUP BY id""")
def _(spark, d):
    pairs = asked(spark, d).select("id", "answer", F.explode_outer("refs").alias("ref"))
    score = T.overlap(F.col("answer"), F.col("ref")) / F.greatest(F.size(T.tokens(F.col("ref"))), F.lit(1))
    return L.best_reference(pairs.withColumn("s", score), "id", "s").select("id", F.round("score", 6).alias("score"), "label")


@query("t31_t32_spans_of_items", rf"""WITH {QA}, s AS (SELECT id, array_to_string(w[1:14], ' ') AS s, CASE id % 3 WHEN 0 THEN array_to_string(w[3:5], ' ') WHEN 1 THEN w[3] || ' ' || w[4] END AS there, array_to_string(w[3:5], ' ') AS raw FROM qa)
    SELECT id, CAST(instr(lower(s), lower(there)) - 1 AS INT) AS start, CAST(instr(lower(s), lower(there)) - 1 + length(there) AS INT) AS "end"
    , CASE id % 3 WHEN 0 THEN raw WHEN 1 THEN CASE WHEN instr(lower(s), lower(raw || '.')) > 0 THEN raw || '.' ELSE regexp_replace(raw || '.', '\.+$', '') END END AS valid FROM s""")
def _(spark, d):
    """Passages as they stand, with other white space between their words, and not there; extracted answers in quotes, with a stop, and none."""
    said = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    kind = F.col("id") % 3
    span = F.when(kind == 0, said(3, 3)).when(kind == 1, F.concat(F.get("w", F.lit(2)), F.lit(" \t "), F.get("w", F.lit(3)))).otherwise("0zq 0qz")
    raw = F.when(kind == 0, F.concat(F.lit('"'), said(3, 3), F.lit('"'))).when(kind == 1, F.concat(said(3, 3), F.lit("."))).otherwise("NONE")
    at = T.locate(said(1, 14), span)
    return asked(spark, d).select("id", at["start"].alias("start"), at["end"].alias("end"), T.validated(raw, said(1, 14)).alias("valid"))


@query("a22_extraction_of_items", f"""WITH {QA}, q AS (SELECT id, id % 4 <> 0 AS extracted, {SQUAD.format('answer')} AS a, list_filter(list_transform(refs, lambda r: {SQUAD.format('r')}), lambda r: r <> '') AS s FROM qa)
    , m AS (SELECT extracted, len(list_filter(s, lambda r: contains(a, r))) > 0 AS gold, extracted AND a <> '' AND len(list_filter(s, lambda r: contains(a, r) OR contains(r, a))) > 0 AS match FROM q)
    SELECT count(*) AS n, count(*) FILTER (extracted) AS extracted, count(*) FILTER (match) AS matched, count(*) FILTER (gold AND extracted AND NOT match) AS wrong_span, count(*) FILTER (gold AND NOT extracted) AS missed_span FROM m""")
def _(spark, d):
    m = T.gold_matches(F.col("answer"), F.col("refs"))
    rows = asked(spark, d).select((F.col("id") % 4 != 0).alias("extracted"), m["inside"].alias("gold"), m["either"].alias("either")).withColumn("match", F.col("extracted") & F.col("either"))
    return rows.agg(F.count("*").alias("n"), F.count_if("extracted").alias("extracted"), F.count_if("match").alias("matched"), F.count_if(F.col("gold") & F.col("extracted") & ~F.col("match")).alias("wrong_span"), F.count_if(F.col("gold") & ~F.col("extracted")).alias("missed_span"))


@query("k05_slopes_by_size", f"WITH {LONG}, b AS (SELECT detector AS feature, regr_slope(y, s) AS w FROM long GROUP BY detector) SELECT feature, round(w, 6) AS weight, row_number() OVER (ORDER BY abs(w) DESC) AS rank FROM b")
def _(spark, d):
    """Weights of the detectors as slopes of the label, largest first: a row per detector."""
    from pyspark.sql import Window

    slopes = long(labelled(spark, d)).groupBy(F.col("detector").alias("feature")).agg(F.regr_slope("y", "s").alias("w"))
    return slopes.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("w").desc())).cast("long")).select("feature", F.round("w", 6).alias("weight"), "rank")


@query("s22_m18_stored_thresholds", f"""WITH {SCORES}, h AS (SELECT round(avg(sep_entropy) + 1e-10, 6) AS h FROM scores)
    SELECT 'written' AS file, floor(600 * h + 0.5) / 1000 AS t_med, h AS t_high FROM h UNION ALL SELECT 'missing', 0.5, 0.74""")
def _(spark, d):
    """Thresholds from the scores, written and read; the defaults where there is no file."""
    from candor.plans.base import TIE

    high = scores(table(spark, d, "documents")).agg(F.round(F.avg("sep_entropy") + TIE, 6)).first()[0]
    path = files.scratch(spark, "thresholds")
    files.write_thresholds(spark, path, int(600 * high + 0.5) / 1000, high)
    return spark.createDataFrame([("written", *files.thresholds(spark, path)), ("missing", *files.thresholds(spark, path + "-none"))], "file string, t_med double, t_high double")


@query("s12_w05_conversations_as_stories", """WITH p AS (SELECT q.conv_id, q.turn, coalesce(q.text, '') AS question, coalesce(a.text, '') AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')
    SELECT CAST(conv_id AS VARCHAR) AS id, CAST(row_number() OVER w - 1 AS INT) AS turn, 'Story ' || conv_id || '.' || coalesce(string_agg(' Q: ' || question || ' A: ' || answer || CASE WHEN answer LIKE '%.' THEN '' ELSE '.' END, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
    , question, [answer, question] AS answers FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(spark, d):
    """Each conversation as a story with questions and answers, in JSON lines, read and flattened to turns with what was said before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = c.where("role = 'user'").join(answers, ["conv_id", "turn"])
    said = lambda x: F.transform("t", lambda t: F.struct(t[x].alias("input_text")))
    stories = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "answer"))).alias("t"))
    story = F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("Story "), "conv_id", F.lit(".")).alias("story"), said("text").alias("questions"), said("answer").alias("answers"), F.create_map(F.lit("0"), said("text")).alias("additional_answers"))
    path = files.scratch(spark, "stories")
    stories.select(F.to_json(F.struct(F.array(story).alias("data"))).alias("value")).write.text(path)
    return qa.coqa(spark, path, lines=True).withColumn("turn", F.col("turn").cast("int"))


MARKED = """m AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[*`]', '', 'g') AS l, turn % 6 AS k FROM conversations)
    , x AS (SELECT id, k, l, string_split(l, ' ') AS w FROM m), y AS (SELECT id, CASE k WHEN 0 THEN '# ' || l WHEN 1 THEN '- **' || w[1] || '** ' || l WHEN 2 THEN '3. `' || w[1] || '` and *' || l || '*' WHEN 3 THEN '**' || w[1] || '*b**' || l WHEN 4 THEN l || ' ** `' ELSE l END AS line FROM x)"""


@query("t37_t38_lines", MARKED.join(["WITH ", r""", t AS (SELECT id, line, regexp_extract_all(line, '\*\*[^\n]+?\*\*|\*[^\n]+?\*|`[^\n]+?`') AS marks FROM y)
    SELECT id, CASE WHEN regexp_matches(line, '^#{1,4}\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^\s*[-•▪▸►]\s+') THEN 'bullet' WHEN regexp_matches(line, '^\s*(?:[0-9]{1,3}[.)]\s+|[a-zA-Z][.)]\s+).+$') THEN 'numbered' WHEN regexp_matches(line, '^\s*\*\s+[^*]') THEN 'bullet' ELSE 'text' END AS kind
    , array_to_string(marks, '|') AS marks, CAST(coalesce(list_sum(list_transform(marks, lambda x: length(x) - CASE WHEN starts_with(x, '**') AND ends_with(x, '**') AND length(x) > 4 THEN 4 ELSE 2 END)), 0) AS BIGINT) AS marked, length(line) AS chars FROM t"""]))
def _(spark, d):
    """Kinds of lines, and their tokens: the tokens with their marks make up the line again."""
    first = F.regexp_replace(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), "[*`]", "")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 6).alias("k"), first.alias("l")).withColumn("w", F.split("l", " ")[0])
    put = lambda *x: F.concat(*(F.lit(v) if v not in ("l", "w") else F.col(v) for v in x))
    line = F.when(F.col("k") == 0, put("# ", "l")).when(F.col("k") == 1, put("- **", "w", "** ", "l")).when(F.col("k") == 2, put("3. `", "w", "` and *", "l", "*")).when(F.col("k") == 3, put("**", "w", "*b**", "l")).when(F.col("k") == 4, put("l", " ** `")).otherwise(F.col("l"))
    rows = rows.select("id", line.alias("line")).withColumn("t", T.inline_tokens(F.col("line")))
    marks = F.filter("t", lambda x: x["kind"] != "plain")
    whole = F.transform(marks, lambda x: F.substr("line", x["start"] + 1, x["end"] - x["start"]))
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("id", T.display_kind(F.col("line")).alias("kind"), F.array_join(whole, "|").alias("marks"), F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("marked"), chars.alias("chars"))
