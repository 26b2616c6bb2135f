"""Text functions on columns: segmentation, claim rules, normalisation, verdicts, spans. Offsets are 0-based and
end-exclusive; texts that are null give null unless stated otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.arrays import bound, running_sum

# Patterns, word lists and limits that define the results. Digits are [0-9], as Spark's and DuckDB's pattern engines
# don't agree on which characters \\d means.
STOP_MARKERS = ["\nQ:", "\nQuestion:", " Q:", "Q:", "Answer the question", "\n\n"]
QUESTION_PROMPT = "Answer the question concisely. Q: %s A:"
BULLET = r"^\s*(?:[-•*▪▸►]|[0-9]{1,3}[.)]\s|[a-zA-Z][.)]\s)"
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st gen gov sgt cpl pvt capt lt col rev hon pres inc corp ltd co llc dept div est assn "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun vs etc approx appt apt "
    "ave blvd rd hwy fig figs eq eqs no nos vol vols al e i"
).split()
FILLERS = [
    "sure", "sure!", "sure.", "sure thing", "of course", "of course!", "of course.", "absolutely", "absolutely!", "absolutely.",
    "certainly", "certainly!", "certainly.", "great question", "great question!", "good question", "good question!",
    "right", "right.", "right!", "okay", "okay.", "ok", "ok.", "yes", "yes.", "yes!", "no", "no.", "no!", "well", "well.", "well,",
    "thanks", "thanks!", "thank you", "thank you!", "you're welcome", "you're welcome!", "here you go", "here you go:", "here you go.",
    "i see", "i see.", "got it", "got it.", "got it!", "exactly", "exactly!", "exactly.", "interesting", "interesting!", "interesting.", "understood", "understood.",
]
META_VERBS = "explain|describe|elaborate|clarify|break|walk|go through|go over|provide|give|outline|discuss|show|list|share|cover|present|summarize|highlight|talk about|review|explore|examine|look at|dive into|address|answer|help|start|begin"
META = [
    rf"^(let me|i'll|i will|i'm going to|i'd like to|allow me to|let's)\s+({META_VERBS})\b",
    r"^here'?s?\s+(what|how|a|an|the|my|some|are)",
    r"^(in summary|to summarize|to sum up|in conclusion|overall|to conclude|in short|in brief)[,:\s]",
    r"^(first|second|third|finally|next|additionally|furthermore|moreover|however|that said)[,:]?\s*$",
    r"^(for example|for instance)[,:]?\s*$",
    r"^(note|please note|keep in mind|remember|it'?s?\s+worth noting|it'?s?\s+important to note)\b",
    r"^(hope this helps|i hope|does that|is there anything|if you have|let me know)\b",
    r"^(as (i|we) (mentioned|discussed|noted|said|stated))\b",
    r"^(feel free to|don'?t hesitate to)\b",
    r"^i('ll| will| am going to)\s+\w+\s+(an overview|a (brief|quick|short|detailed|comprehensive))\b",
    r"^(below (is|are)|the following (is|are|list|table|section))\b",
    r"^(this|that)\s+(is a|means|shows|demonstrates|illustrates|suggests)\s+(good|great|common|typical|important)",
]
ADVISORY = [
    r"\b(may vary|might vary|can vary|varies|vary depending|depends on|it depends)\b",
    r"\b(not necessarily|not always|not guaranteed|no guarantee|your mileage may vary)\b",
    r"\b(consult|seek advice|professional advice|do your own research)\b",
    r"\b(please note that|keep in mind that|bear in mind that|be aware that|be advised that)\b",
    r"\b(this is not|this isn'?t)\s+(financial|medical|legal|professional)\s+(advice)\b",
    r"\b(individual results|results may|experiences may|opinions may)\b",
]
HEDGING = [
    r"^(in my opinion|personally|from my perspective|i think|i believe|i feel|i'd say)\b",
    r"^(it'?s?\s+(hard|difficult|tricky|complicated|complex|subjective|debatable)\s+to)\b",
    r"^(there'?s?\s+no\s+(one|single|simple|definitive|clear))\b",
]
REFUSAL = [
    r"\bI\s+(could\s?n'?t|could\s+not|can'?t|can\s+not|cannot|was\s+unable\s+to|am\s+unable\s+to|was\s+not\s+able\s+to)\s+find\b",
    r"\bI\s+(don'?t|do\s+not|did\s*n'?t)\s+(have|find|know|recognize)\b",
    r"\bI('?m|\s+am)\s+not\s+(aware|familiar|sure|certain)\b",
    r"\bI('?m|\s+am)\s+(sorry|afraid)\b.*\b(don'?t|do\s+not|cannot|can'?t|no|unable)\b",
    r"\b(unfortunately,?\s+)?I\s+(don'?t|do\s+not)\s+have\s+(access|enough|sufficient|any)\b",
    r"\b(there\s+(is|are)\s+no|no)\s+(information|record|records|data|details|mention)\b",
    r"^(it'?s|it\s+is)\s+possible\s+that\b.*(misspelled|different\s+name|lesser-known|obscure|typo)",
    r"^(if\s+you\s+(could|can)\s+provide|could\s+you\s+(provide|clarify)|please\s+provide\s+(more|additional))",
    r"\b(may\s+be\s+a\s+)?(fictional|made-up|non-existent|hypothetical)\s+(character|person|place|entity|topic)\b",
]
QUESTION = r"^(what|who|where|when|why|how|do|does|did|is|are|was|were|can|could|would|should|shall|will|have|has|had)\b.*\?$"
GREETING = r"^(hi|hello|hey|greetings|dear|sincerely|regards|best|cheers)\b"
LABEL = r"^[^:]{3,80}:\s*$"
PROPER_NOUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
FACTUAL = [
    r"(?i)[0-9]+[\.,]?[0-9]*\s*(km|m|cm|mm|miles?|feet|ft|inches?|mph|km/s|m/s|kg|g|lb|lbs|°[CF]|degrees?|percent|%|years?|months?|days?|hours?|minutes?|seconds?|GB|MB|TB|GHz|MHz|Hz)",
    r"[0-9]{2,}",
    r"\$[0-9,.]+|[0-9]+[\.,][0-9]+",
    r"(?i)approximately|roughly|about\s+[0-9]",
]
NEGATIVE_VERDICTS = ["incorrect", "not correct", "not right", "wrong", "false", "does not", "doesn't", "isn't correct", " no ", " no,", " no.", " no\n"]
POSITIVE_VERDICTS = ["correct", " yes", "right", "true", "supported", "accurate"]
CHUNK_WORDS, CHUNK_STRIDE, EVIDENCE_CHARS = 90, 70, 3000
ARTICLES = ["a", "an", "the"]
# End of fixed values.

SENTENCES = "array<struct<sentence:string,start:int,end:int,source:string>>"


def any_of(text: Column, patterns: list[str], prefix: str = "(?i)") -> Column:
    """One alternation, so that the text is matched once."""
    return text.rlike(prefix + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


#: White space as patterns take it.
BLANK = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def clean_answer(text: Column) -> Column:
    """Text before the first stop marker, stripped."""
    places = F.filter(F.array(*(F.instr(text, m) for m in STOP_MARKERS)), lambda i: i > 0)
    return stripped(F.when(F.size(places) > 0, F.substring(text, F.lit(1), F.array_min(places) - 1)).otherwise(text))


def prompt(question: Column) -> Column:
    return F.format_string(QUESTION_PROMPT, question)


def spaced(answer: Column) -> Column:
    """With a leading space, for the steering template."""
    return F.when(F.startswith(answer, F.lit(" ")), answer).otherwise(F.concat(F.lit(" "), answer))


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


_ABBREVIATED = "|".join(ABBREVIATIONS)
#: White space between sentences: after a stop that isn't an abbreviation's or initials'.
BOUNDARY = rf"(?<=[.!?])(?<!\b(?i:{_ABBREVIATED})\.)(?<!\b[A-Z]\.[A-Z]\.)\s+(?=[A-Z\"'(])"
#: A web address with a stop at its end, of any length. A mark put behind it, a character of the private use area, hides the stop
#: from the pattern above.
ADDRESS, MARK = r"((?:https?://|www\.)\S*[.!?])", "\ue000"


def _marked(text: Column) -> Column:
    return F.when(text.rlike(r"https?://|www\."), F.regexp_replace(text, ADDRESS + r"(?=\s)", "$1" + MARK)).otherwise(text)


def _unmarked(part: Column) -> Column:
    return F.when(F.contains(part, F.lit(MARK)), F.regexp_replace(part, ADDRESS + MARK + r"(?=\s|$)", "$1")).otherwise(part)


def _located(text: Column, separator: str, offset: Column, source: Column) -> Column:
    """The parts of text between separators, stripped, with their places; empty ones dropped. Places are running sums of the lengths
    of the parts and separators before."""

    def placed(x: Column, end: Column) -> Column:
        part = stripped(x["part"])
        begin = offset + end - x["step"] + F.length(x["part"]) - F.length(F.ltrim(x["part"], F.lit(BLANK)))
        return F.struct(part.alias("sentence"), begin.cast("int").alias("start"), (begin + F.length(part)).cast("int").alias("end"), source.alias("source"))

    gaps = F.transform(F.regexp_extract_all(text, F.lit(separator), F.lit(0)), lambda g: F.length(g))
    parts = F.zip_with(F.transform(F.split(text, separator), _unmarked), gaps, lambda p, g: F.struct(p.alias("part"), (F.length(p) + F.coalesce(g, F.lit(0))).alias("step")))
    return bound(parts, lambda xs: F.filter(F.zip_with(xs, running_sum(F.transform(xs, lambda x: x["step"])), placed), lambda x: x["sentence"] != ""))


def blocks(text: Column) -> Column:
    """Paragraphs; where a paragraph of several lines has a bullet line, its lines. source: bullet, newline or
    paragraph."""
    paragraphs = _located(text, r"\n\s*\n", F.lit(0), F.lit("paragraph"))

    def lines(p: Column) -> Column:
        parts = F.split(p["sentence"], "\n")
        mixed = (F.size(parts) > 1) & F.exists(parts, lambda x: is_bullet(stripped(x)))
        each = F.transform(_located(p["sentence"], "\n", p["start"], F.lit("newline")), lambda x: F.struct(x["sentence"], x["start"], x["end"], F.when(is_bullet(x["sentence"]), "bullet").otherwise("newline").alias("source")))
        return F.when(mixed, each).otherwise(F.array(p))

    return F.flatten(F.transform(paragraphs, lines))


def sentences(text: Column) -> Column:
    """Sentences with places; bullet lines stay whole. Blank and null texts have none."""
    def split(b: Column) -> Column:
        regex = bound(_marked(b["sentence"]), lambda m: _located(m, BOUNDARY, b["start"], F.lit("regex")))
        return F.when(b["source"] == "bullet", F.array(b)).otherwise(regex)

    return F.when(stripped(F.coalesce(text, F.lit(""))) == "", F.array().cast(SENTENCES)).otherwise(F.flatten(F.transform(blocks(text), split)))


def is_refusal(text: Column) -> Column:
    return any_of(stripped(F.coalesce(text, F.lit(""))), REFUSAL)


def has_facts(text: Column) -> Column:
    return any_of(text, FACTUAL, "")


def fast_pass(sentence: Column) -> Column:
    """False for sentences that are no claims by rule, null for those that need a classifier."""
    no = F.lit(False)

    def rules(x: Column) -> Column:
        t, words, plain = x["t"], x["words"], x["plain"]
        return (
            F.when(words < 3, F.when(t.rlike("[0-9]"), F.lit(None).cast("boolean")).otherwise(no))
            .when(plain.isin(FILLERS) | F.concat(plain, F.lit(".")).isin(FILLERS), no)
            .when(any_of(t, META), no)
            .when(any_of(t, ADVISORY) & ~t.rlike(PROPER_NOUN), no)
            .when(any_of(t, HEDGING), no)
            .when(any_of(t, REFUSAL), no)
            .when(t.rlike(LABEL) & (words <= 10), no)
            .when(any_of(t, [QUESTION]), no)
            .when(any_of(t, [GREETING]) & (words < 6), no)
            .otherwise(F.lit(None).cast("boolean"))
        )

    bare = F.regexp_replace(F.lower(stripped(sentence)), r"[!.,;:?]+$", "")
    return bound(F.struct(stripped(sentence).alias("t"), word_count(sentence).alias("words"), bare.alias("plain")), rules)


def classified(top_is_claim: Column, score: Column, sentence: Column) -> Column:
    """A classifier's verdict with the rescue of sentences that hold facts; without a verdict, a claim."""
    return F.coalesce((top_is_claim & (score > 0.5)) | has_facts(sentence), F.lit(True))


def is_claim(sentence: Column, verdict: Column | None = None) -> Column:
    """Rules first, then a classifier's verdict (null: none), else a claim. Empty: no claim."""
    rule = fast_pass(sentence)
    return F.when(stripped(F.coalesce(sentence, F.lit(""))) == "", False).otherwise(F.coalesce(rule, verdict if verdict is not None else F.lit(None).cast("boolean"), F.lit(True)))


def norm(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and space to space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def squad_norm(text: Column) -> Column:
    """Lower case, ASCII punctuation to space, articles dropped, single spaces."""
    words = F.split(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(ARTICLES)), " ")


def reference_label(claim: Column, refs: Column) -> Column:
    """0 if any reference is in the claim (both normalised), else 1."""
    given = F.transform(F.coalesce(refs, F.array().cast("array<string>")), norm)
    return F.when(bound(norm(claim), lambda c: F.exists(given, lambda r: (r != "") & F.contains(c, r))), 0).otherwise(1)


def gold_matches(answer: Column, refs: Column) -> dict[str, Column]:
    """equal: any reference equals the answer; either: either is in the other; inside: any reference is in the answer."""
    given = F.transform(refs, squad_norm)
    each = lambda test: bound(squad_norm(answer), lambda a: F.coalesce(F.exists(given, lambda r: (r != "") & test(a, r)), F.lit(False)))
    return {"equal": each(lambda a, r: r == a), "either": each(lambda a, r: (a != "") & (F.contains(a, r) | F.contains(r, a))), "inside": each(F.contains)}


def verdict(reply: Column) -> Column:
    """1 unless the reply is positive and nothing in it negative."""
    r = F.concat(F.lit(" "), stripped(F.lower(F.coalesce(reply, F.lit("")))), F.lit(" "))
    has = lambda marks: reduce(lambda a, b: a | b, (F.contains(r, F.lit(m)) for m in marks))
    return F.when(has(NEGATIVE_VERDICTS), 1).when(has(POSITIVE_VERDICTS), 0).otherwise(1)


def grounded_verdict(reply: Column) -> Column:
    """0 if the first twelve characters say yes and not no, else 1."""
    head = F.substring(stripped(F.lower(F.coalesce(reply, F.lit("")))), 1, 12)
    return F.when(F.contains(head, F.lit("yes")) & ~F.contains(head, F.lit("no")), 0).otherwise(1)


def chunks(text: Column, size: int = CHUNK_WORDS, stride: int = CHUNK_STRIDE) -> Column:
    """Windows of `size` words every `stride` words, until the end is covered."""
    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (n > 0) & ((s == 0) | (s + (size - stride) < n)))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def best_chunks(claim: Column, candidates: Column, k: int = 4) -> Column:
    """The k candidates with the largest overlap, ties in their order."""
    shared = lambda c, said: -F.size(F.array_intersect(tokens(c), said))
    keyed = bound(tokens(claim), lambda said: F.transform(candidates, lambda c, i: F.struct(shared(c, said).alias("o"), i.alias("i"), c.alias("c"))))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["c"])


def evidence(parts: Column) -> Column:
    return F.substring(F.array_join(parts, " "), 1, EVIDENCE_CHARS)


def gold_string(refs: Column, fallback: str = "(unknown)") -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(refs, lambda r: F.trim(r) != ""), "; "), F.lit("")), F.lit(fallback))


def locate(sentence: Column, span: Column) -> Column:
    """(start, end) of span in sentence, whatever the case, else with any white space between its words; null if not
    there."""
    needle = stripped(span)
    direct = F.call_function("locate", F.lower(needle), F.lower(sentence)) - 1
    words = F.transform(F.filter(F.split(needle, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)"), F.array_join(words, r"\s+"))
    found = F.regexp_substr(sentence, pattern)
    at = F.call_function("locate", found, sentence) - 1
    span_of = lambda start, size: F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"))
    return F.when((F.coalesce(sentence, F.lit("")) == "") | (F.coalesce(needle, F.lit("")) == ""), None).when(direct >= 0, span_of(direct, F.length(needle))).when(found.isNotNull(), span_of(at, F.length(found)))


def validated(raw: Column, sentence: Column) -> Column:
    """An extracted answer without quotes, if it stands in the sentence (perhaps without a last stop); else null."""
    quoted = stripped(F.regexp_replace(stripped(F.coalesce(raw, F.lit(""))), "^[\"“”']+|[\"“”']+$", ""))
    bare = stripped(F.regexp_replace(quoted, r"\.+$", ""))
    return F.when((quoted == "") | (F.upper(quoted) == "NONE"), None).when(locate(sentence, quoted).isNotNull(), quoted).when((bare != "") & locate(sentence, bare).isNotNull(), bare)


def token_range(lengths: Column, prompt_len: Column, start: Column, end: Column) -> Column:
    """Token numbers [a, b) that cover characters [start, end), from the answer's decoded length after each token; an
    empty answer gives (prompt_len, prompt_len)."""
    def of(x: Column) -> Column:
        n, size = F.size(lengths), F.element_at(lengths, -1)
        token = lambda c: F.coalesce(F.array_min(F.filter(F.transform(lengths, lambda v, i: F.when(v > c, i)), lambda i: i.isNotNull())), n - 1)
        a, b = F.greatest(F.lit(0), F.least(x["start"], size - 1)), F.least(x["end"], size)
        return F.struct((prompt_len + token(a)).alias("a"), (prompt_len + token(F.greatest(a + 1, b) - 1) + 1).alias("b"))

    none = F.struct(prompt_len.alias("a"), prompt_len.alias("b"))
    return F.when(F.size(lengths) == 0, none).otherwise(of(F.struct(start.alias("start"), end.alias("end"))))


def step_window(a: Column, b: Column, n: Column) -> Column:
    """[a, b) widened to two steps at least, inside [0, n)."""
    hi = F.least(n, F.greatest(b, a + 2))
    return F.struct(F.greatest(F.lit(0), F.least(a, hi - 2)).alias("a"), hi.alias("b"))


def first_words(text: Column, n: int = 128) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", " ")


def highlighted(sentences_: Column, scores: Column, threshold: float = 0.5) -> Column:
    """Sentences joined, those from the threshold on in marks."""
    return F.array_join(F.zip_with(sentences_, scores, lambda s, p: F.when(p >= threshold, F.concat(F.lit("[["), s, F.lit("]]"))).otherwise(s)), " ")


def display_kind(line: Column) -> Column:
    """heading, bullet, numbered or text."""
    return (
        F.when(line.rlike(r"^#{1,4}\s+.+$"), "heading")
        .when(line.rlike(r"^\s*[-•▪▸►]\s+"), "bullet")
        .when(line.rlike(r"^\s*(?:[0-9]{1,3}[.)]\s+|[a-zA-Z][.)]\s+).+$"), "numbered")
        .when(line.rlike(r"^\s*\*\s+[^*]"), "bullet")
        .otherwise("text")
    )


def needs_new_line(line: Column) -> Column:
    return stripped(line).rlike(r"^(#{1,4}\s|[-•▪▸►*]\s|\s*[0-9]{1,3}[.)]\s|[a-zA-Z][.)]\s)")


INLINE = r"\*\*.+?\*\*|\*.+?\*|`.+?`"
TOKENS = "array<struct<kind:string,start:int,end:int,text:string>>"


def inline_tokens(line: Column) -> Column:
    """All of a line in order as plain, bold, italic and code tokens: place, and text without marks. Marks close as early as they can,
    whatever is between."""
    def token(kind: Column, start: Column, end: Column, said: Column) -> Column:
        return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), said.alias("text"))

    def marked(x: Column) -> Column:
        bold, size = F.startswith(x, F.lit("**")) & F.endswith(x, F.lit("**")) & (F.length(x) > 4), F.length(x)
        kind = F.when(F.startswith(x, F.lit("`")), "code").when(bold, "bold").otherwise("italic")
        return F.struct(kind.alias("kind"), F.when(bold, F.substr(x, F.lit(3), size - 4)).otherwise(F.substr(x, F.lit(2), size - 2)).alias("text"), size.alias("size"))

    def placed(x: Column) -> Column:
        pairs = F.zip_with(x["plain"], x["marks"], lambda p, m: F.struct(p.alias("p"), m.alias("m"), (F.length(p) + F.coalesce(m["size"], F.lit(0))).alias("step")))

        def both(y: Column, end: Column) -> Column:
            size = F.coalesce(y["m"]["size"], F.lit(0))
            return F.array(token(F.lit("plain"), end - y["step"], end - size, y["p"]), token(y["m"]["kind"], end - size, end, y["m"]["text"]))

        every = bound(pairs, lambda ys: F.flatten(F.zip_with(ys, running_sum(F.transform(ys, lambda y: y["step"])), both)))
        return F.filter(every, lambda t: t["end"] > t["start"]).cast(TOKENS)

    marks = F.transform(F.regexp_extract_all(line, F.lit(INLINE), F.lit(0)), marked)
    return bound(F.struct(F.split(line, INLINE, -1).alias("plain"), marks.alias("marks")), placed)


def inline_marks(line: Column) -> Column:
    """Bold, italic and code spans of a line with their marks, in order."""
    return F.regexp_extract_all(line, F.lit(f"({INLINE})"), F.lit(1))


def short_label(text: Column, n: int = 18) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def truthy(text: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "0", "false", "no")


def plain_url(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "/+$", "")
