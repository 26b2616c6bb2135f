"""Sentences by pluggable segmenters in tiers, as a table function for SQL.

A tier is a name and a loader; the loader imports what it needs and returns a function from a block's text to its sentences.
The first tier that loads on an executor is used; where none does, and for each text that it fails on, the pattern tier's sentences come
out, which `functions.text` finds without Python. Bullet lines stay whole in every tier.

    register(spark, [("pysbd", pysbd)])
    with_blocks(docs, "text").createOrReplaceTempView("d")
    spark.sql("SELECT doc_id, s.* FROM d, LATERAL segments(blocks, pattern) s")

Cases: a text without sentences has no row; a sentence that a segmenter altered, so that it isn't in its block from the last one's end on, is a failure
of that text, as its place would be a guess; blank sentences are dropped, others stripped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as T

Segmenter = Callable[[str], list[str]]
ROWS = "n int, sentence string, start int, end int, source string"


def spacy() -> Segmenter:
    """Rule-based sentence ends of spaCy, where it is installed."""
    from spacy.lang.en import English

    nlp = English()
    nlp.add_pipe("sentencizer")
    return lambda text: [s.text for s in nlp(text).sents]


def pysbd() -> Segmenter:
    import pysbd as library

    segmenter = library.Segmenter(language="en", clean=False)
    return segmenter.segment


#: The tiers in order; the pattern tier is behind all.
TIERS = [("sentencizer", spacy), ("pysbd", pysbd)]


def loaded(tiers: list[tuple[str, Callable[[], Segmenter]]]) -> tuple[str, Segmenter] | None:
    """The first tier whose library is there."""
    for name, load in tiers:
        try:
            return name, load()
        except ImportError:
            continue
    return None


def placed(block: str, parts: list[str], begin: int, source: str) -> list[tuple[str, int, int, str]]:
    """Each part with its place, looked for from the end of the one before."""
    out, cursor = [], 0
    for part in parts:
        part = part.strip(T.BLANK)
        if part:
            at = block.index(part, cursor)
            cursor = at + len(part)
            out.append((part, begin + at, begin + cursor, source))
    return out


def register(spark: SparkSession, tiers: list[tuple[str, Callable[[], Segmenter]]] = TIERS, name: str = "segments") -> None:
    """Makes name(blocks, pattern) a table function of SQL: n, sentence, start, end, source."""

    class Segments:
        def __init__(self) -> None:
            self.tier = loaded(tiers)

        def eval(self, blocks, pattern):  # noqa: ANN001, ANN202 - lists of rows
            rows = [(s["sentence"], s["start"], s["end"], s["source"]) for s in pattern]
            if self.tier:
                try:
                    source, segment = self.tier
                    rows = []
                    for b in blocks:
                        whole = b["source"] == "bullet"
                        rows += [(b["sentence"], b["start"], b["end"], "bullet")] if whole else placed(b["sentence"], segment(b["sentence"]), b["start"], source)
                except Exception:  # noqa: BLE001 - whatever a plug-in raises, the text has its pattern sentences
                    rows = [(s["sentence"], s["start"], s["end"], s["source"]) for s in pattern]
            yield from ((i, *r) for i, r in enumerate(rows))

    spark.udtf.register(name, F.udtf(Segments, returnType=ROWS))


def with_blocks(docs: DataFrame, column: str) -> DataFrame:
    """docs with the arguments of the table function: blocks, and the sentences of the pattern tier."""
    blank = T.stripped(F.coalesce(F.col(column), F.lit(""))) == ""
    return docs.withColumns({"blocks": F.when(blank, F.array().cast(T.SENTENCES)).otherwise(T.blocks(F.col(column))), "pattern": T.sentences(F.col(column))})


def segmented(docs: DataFrame, column: str, key: str, tiers: list[tuple[str, Callable[[], Segmenter]]] = TIERS) -> DataFrame:
    """key, n, sentence, start, end, source of the texts in a column."""
    spark = docs.sparkSession
    register(spark, tiers, "candor_segments")
    return spark.sql(f"SELECT d.`{key}`, s.* FROM {{d}} AS d, LATERAL candor_segments(d.blocks, d.pattern) AS s", d=with_blocks(docs, column).select(key, "blocks", "pattern"))
