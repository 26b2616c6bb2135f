"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities: emails, addresses, cards and phones. Then the corpus says which terms
reveal them: a term is a word near an entity's mentions (NEAR characters on either side), and what it reveals of the
entity is the pointwise mutual information log2(c * N / (n * e)), with c mentions of the entity near the term, n uses
of the term, e mentions of the entity and N words in the corpus. A term discloses an entity if it stands near it in at least CONTEXTS
different contexts (copies of a text count once there), at least SHARE of its uses are near it, and the information
reaches GENERALISE bits; from REMOVE bits on it is removed, below it is generalised to its kind. Its uses count as
spans wherever they stand.

Terms whose counts are needed are those near entities often enough; the words of the corpus are counted for these
alone, with sums before the shuffle. Their table is broadcast up to BROADCAST_ROWS rows, else joined by a shuffle.

All of it is built-in functions. The patterns are written so that matching takes time in proportion to the text: a match may only
begin where the greedy run before it doesn't reach (or where the last match ended), and runs are possessive. They match
what the plain patterns match.

Cases: null and empty texts have no spans; rows that repeat doc_id are handled row by row; a term that is part of an entity keeps the
entity's span too; ties in begin go by kind, then end; an empty table gives an empty table; other columns are left aside, whatever their names; null ids matter to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.arrays import running
from candor.llm.common import staged
from candor.llm.native import blocks, bound, cut, occurrences

#: In the order in which spans that begin together are listed.
KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "generalise": "<TERM>", "remove": ""}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TERM = r"[^\p{L}]+"

NEAR, CONTEXTS, SHARE, GENERALISE, REMOVE = 48, 3, 0.5, 4.0, 10.0
BROADCAST_ROWS = 1_000_000
SPAN = "array<struct<start:int,kind:int,end:int,said:string>>"


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _valid(kind: str, said: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(said, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return F.length(_digits(said)).between(12, 19) & F.call_function("luhn_check", _digits(said))
    return F.length(_digits(said)).between(9, 15) if kind == "phone" else F.lit(True)


def _of_kind(text: Column, k: int) -> Column:
    kind = KINDS[k]
    hint = F.instr(text, "@") > 0 if kind == "email" else text.rlike(HINTS[kind])
    good = F.filter(occurrences(text, PATTERNS[kind]), lambda x: _valid(kind, x["said"]))
    spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["said"].alias("said")))
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Entities by the fixed patterns, by begin, then kind: start, kind (number), end (code points), said."""
    return F.array_sort(F.concat(*(_of_kind(text, k) for k in range(4))))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _surroundings(text: Column) -> Column:
    """entity and near (the NEAR characters on either side, in lower case, without words cut by their edge) of each mention."""

    def of(x: Column) -> Column:
        size = F.lit(NEAR)
        before = lambda y: F.regexp_replace(cut(x["parts"], F.greatest(F.lit(0), y["start"] - size), y["start"]), r"^\p{L}++", "")
        after = lambda y: F.regexp_replace(cut(x["parts"], y["end"], y["end"] + size), r"\p{L}++$", "")
        return F.transform(x["spans"], lambda y: F.struct(F.concat_ws(":", y["kind"], F.lower(y["said"])).alias("entity"), F.lower(F.concat(before(y), F.lit(" | "), after(y))).alias("near")))

    return bound(F.struct(blocks(text).alias("parts"), base_spans(text).alias("spans")), of)


def disclosing(docs: DataFrame) -> DataFrame:
    """term, action (`generalise` or `remove`), bits, of terms that disclose an entity."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # what is computed of the text is so before its mentions become rows
    mentions = staged(text.select(F.xxhash64("text").alias("tk"), _surroundings(F.col("text")).alias("found")).select("tk", F.inline("found")), "mentions")
    words = mentions.select("tk", "entity", "near", F.explode(F.array_distinct(F.filter(F.split("near", TERM), lambda w: F.length(w) >= 3))).alias("term"))
    # a term has as many uses at least as there are texts that have it near an entity: where they are too many for its
    # share, as with common words, its uses needn't be counted
    texts = words.groupBy("term").agg(F.countDistinct("tk").alias("texts"))
    pairs = words.groupBy("entity", "term", "near").agg(F.count("*").alias("c")).groupBy("entity", "term").agg(F.sum("c").alias("c"), F.count("*").alias("contexts"))
    pairs = pairs.where(F.col("contexts") >= CONTEXTS).join(texts, "term").where(F.col("c") >= SHARE * F.col("texts"))
    of_entity = mentions.groupBy("entity").agg(F.count("*").alias("e"))
    pairs = staged(pairs.join(of_entity, "entity").select("entity", "term", "c", "e"), "pairs")
    terms = pairs.select("term").distinct()
    if not terms.limit(1).count():
        return pairs.select("term", F.lit("").alias("action"), F.lit(0.0).alias("bits"))
    used = text.select(F.explode(F.split(F.lower("text"), TERM)).alias("term"))
    total = text.agg(F.sum(F.size(F.split("text", TERM)))).first()[0]
    counts = used.join(_checked(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    bits = F.log2(F.col("c") * F.lit(float(total or 1)) / (F.col("n") * F.col("e")))
    strong = pairs.join(counts, "term").withColumn("bits", bits).where((F.col("c") >= SHARE * F.col("n")) & (F.col("bits") >= GENERALISE))
    strong = strong.groupBy("term").agg(F.max("bits").alias("bits"))
    return staged(strong.select("term", F.when(F.col("bits") >= REMOVE, "remove").otherwise("generalise").alias("action"), "bits"), "disclosing")


def find(docs: DataFrame) -> DataFrame:
    """`row` (a struct of all columns of docs, so that no name can clash), `said` (the text; null: empty), `base` and `spans` (base and
    terms, sorted; kind is a number in KINDS), and `actions`, the action of each term found."""
    terms = disclosing(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("said"))
    rows = rows.select("row", "said", F.xxhash64("said").alias("tk"), F.hash("said").alias("tk2"))
    if terms.limit(1).count():
        holds = rows.select("tk", "tk2", F.explode(F.array_distinct(F.split(F.lower("said"), TERM))).alias("term")).join(_checked(terms), "term").distinct()
        holds = staged(holds.groupBy("tk", "tk2").agg(F.sort_array(F.collect_set(F.struct("term", "action"))).alias("actions")), "holds")
        rows = rows.join(_checked(holds), ["tk", "tk2"], "left")
    else:
        rows = rows.withColumn("actions", F.lit(None).cast("array<struct<term:string,action:string>>"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("actions.term", "|"), F.lit(r")(?!\p{L})"))
    terms_of = F.when(F.size("actions") > 0, F.transform(occurrences(F.col("said"), pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), x["said"].alias("said"))))
    rows = rows.withColumn("base", base_spans(F.col("said")))
    return rows.withColumn("spans", F.when(terms_of.isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", terms_of)))).drop("tk", "tk2")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with `text` in which entities are put as their labels and disclosing terms generalised or removed, and, if
    it is there, n_chars of the new text. Where spans overlap, the first one's label stands for both. Null texts stay
    null."""
    found = find(docs)
    label = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]])

    def named(x: Column) -> Column:
        action = F.get(F.filter("actions", lambda a: a["term"] == F.lower(x["said"])), F.lit(0))["action"]
        return F.when(x["kind"] < 4, F.get(label, x["kind"])).when(action == "remove", LABELS["remove"]).otherwise(LABELS["generalise"])

    def put_in(x: Column) -> Column:
        # what is covered before each span: the largest end so far
        ends = running(F.transform(x["spans"], lambda y: y["end"]), F.lit(0), lambda a, e: F.greatest(a, e))
        covered = F.concat(F.array(F.lit(0)), ends)
        pieces = F.zip_with(x["spans"], F.slice(covered, 1, F.size(ends)), lambda y, at: F.when(y["start"] >= at, F.concat(cut(x["parts"], at, y["start"]), y["label"])).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(x["parts"], F.element_at(covered, -1), F.length("said")))

    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), named(x).alias("label")))
    new = bound(F.struct(blocks(F.col("said")).alias("parts"), spans.alias("spans")), put_in)
    out = found.select("row", F.when(F.col("row.text").isNotNull(), F.when(F.size("spans") > 0, new).otherwise(F.col("said"))).alias("new"))
    kinds = dict(docs.dtypes)
    put = {"text": F.col("new").cast(kinds["text"])}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.coalesce(F.length("new").cast(kinds["n_chars"]), F.col("row.n_chars"))
    return out.select(*(put.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
