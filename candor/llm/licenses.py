"""License scans by diagonal voting.

Templates are license notices and short phrases, as words. All rolling GRAM-word hashes of every text are joined with the positions
that the templates have them at. A hit at word p with template offset o votes for diagonal p - o, where the template would begin;
votes are distinct offsets, so no template position counts twice. Words put in or left out move the rest of a
notice to a neighbouring diagonal: votes within DRIFT diagonals are added up, bands with VOTES of a template's grams stay, and
neighbouring ones merge to one candidate. Candidates are verified on the words themselves, by the longest common subsequence
of template and span, over the mean of both lengths, from SIMILAR on. Where verified notices overlap, the best one stays: licenses
share much of their wording.

Phrases (templates that are marked exact) need all grams on one diagonal and all words equal; each place counts, and none gives
way to a notice.

Hits are counted by text, not by row, so copies are one group; a text's votes are bounded by its length. Templates are a parameter; their
positions are broadcast up to BROADCAST_ROWS and joined by a shuffle beyond, like candidates.

Cases: null texts count as empty and have no words; texts with fewer words than a template have none of its phrases, and may have
most of a notice; templates of fewer words than a gram are an error; rows that repeat doc_id or have none are handled row by row;
ties in score go to the label that is first in alphabetical order; an empty table gives an empty table; other columns are left aside; a very
long text is a row of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.llm.common import slices, small_batches, staged, utf8
from candor.llm.words import bytes_of, find_words, lowered, sequences_hashed

GRAM, DRIFT, VOTES, SIMILAR = 3, 4, 0.34, 0.85
#: Text of a batch worked on at once, in bytes.
SLICE = 1 << 20
BROADCAST_ROWS = 100_000

# Phrases, and notices as their licenses word them.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]
# End of fixed values.

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = bytes_of(*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
SPANS = "array<struct<label:string,start:int,end:int,score:double,exact:boolean>>"


class Template:
    def __init__(self, label: str, text: str, exact: bool) -> None:
        raw, offsets = utf8(pa.array([text]))
        self.label, self.exact = label, exact
        self.hashes, _, start, end = find_words(raw, offsets, lower=True, apart=_APART)
        self.words = [lowered(raw)[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        if len(self.words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least: {text!r}")


def templates(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    return [Template(*x, True) for x in phrases] + [Template(*x, False) for x in notices]


def _positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """h, template, offset, exact, needed: every gram of every template."""
    rows = []
    for i, t in enumerate(known):
        grams = sequences_hashed(t.hashes, GRAM).view(np.int64).tolist()
        needed = len(grams) if t.exact else max(1, int(np.ceil(VOTES * len(grams))))
        rows += [(h, i, o, t.exact, needed) for o, h in enumerate(grams)]
    return spark.createDataFrame(rows, "h long, template int, offset int, exact boolean, needed int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            hashes, text, _, _ = find_words(*utf8(part.column("text")), lower=True, apart=_APART)
            grams = sequences_hashed(hashes, GRAM)
            at = np.flatnonzero(text[: len(grams)] == text[GRAM - 1 :]) if len(grams) else np.zeros(0, np.int64)
            place = at - np.searchsorted(text, text[at])  # words before it in its text
            own = pa.array(text[at])
            yield pa.RecordBatch.from_arrays([part.column("t1").take(own), part.column("t2").take(own), pa.array(place.astype(np.int32)), pa.array(grams[at].view(np.int64))], ["t1", "t2", "place", "h"])


def aligned(template: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and where one of that length begins and ends in words."""
    said, table = np.array(words, object), np.zeros((len(template) + 1, len(words) + 1), np.int32)
    for i, w in enumerate(template):
        np.maximum.accumulate(np.maximum(table[i, 1:], np.where(said == w, table[i, :-1] + 1, 0)), out=table[i + 1, 1:])
    i, j, first, last = len(template), len(words), 0, 0
    while i and table[i, j]:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            first, last = j, last or j + 1
    return int(table[-1, -1]), first, last


def _verified(known: list[Template], words: list[bytes], candidates: list[dict]) -> list[dict]:
    """Spans of a text, by begin: phrases that are there word by word, and the best of notices that overlap."""
    exact, loose = [], []
    for c in candidates:
        t = known[c["template"]]
        lo, hi = max(0, c["low"]), min(len(words), c["high"] + len(t.words))
        if t.exact:
            if words[lo:hi] == t.words:
                exact.append({"label": t.label, "start": lo, "end": hi, "score": 1.0, "exact": True})
            continue
        same, first, last = aligned(t.words, words[lo:hi])
        score = 2 * same / (len(t.words) + last - first)
        if score >= SIMILAR:
            loose.append({"label": t.label, "start": lo + first, "end": lo + last, "score": score, "exact": False})
    best: list[dict] = []
    for x in sorted(loose, key=lambda x: (-x["score"], x["start"] - x["end"], x["label"])):
        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in best):
            best.append(x)
    return sorted(exact + best, key=lambda x: (x["start"], x["end"], x["label"]))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and spans (label, start and end in words, score, exact) of every row of docs."""
    spark, known = docs.sparkSession, known or templates()
    small_batches(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    grams = rows.select("t1", "t2", "text").mapInArrow(_grams, "t1 long, t2 long, place int, h long")
    hits = grams.join(_few(_positions(spark, known)), "h").withColumn("diagonal", F.col("place") - F.col("offset"))
    votes = hits.groupBy("t1", "t2", "template", "exact", "needed", "diagonal").agg(F.size(F.collect_set("offset")).alias("votes"))
    of = Window.partitionBy("t1", "t2", "template").orderBy("diagonal")
    band = F.when(F.col("exact"), F.col("votes")).otherwise(F.sum("votes").over(of.rangeBetween(-DRIFT, DRIFT)))
    strong = votes.withColumn("band", band).where("band >= needed")
    apart = F.col("exact") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(of), F.lit(-(1 << 31)).cast("long")) > DRIFT)
    merged = strong.withColumn("nth", F.sum(apart.cast("int")).over(of)).groupBy("t1", "t2", "template", "nth").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    candidates = staged(merged.groupBy("t1", "t2").agg(F.collect_list(F.struct("template", "low", "high")).alias("found")), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, offsets = utf8(part.column("text"))
                _, owner, start, end = find_words(raw, offsets, lower=True, apart=_APART)
                low, at = lowered(raw), np.searchsorted(owner, np.arange(part.num_rows + 1))
                spans = []
                for i, found in enumerate(part.column("found").to_pylist()):
                    words = [low[a:b].tobytes() for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]], strict=True)]
                    spans.append(_verified(known, words, found))
                yield pa.RecordBatch.from_pydict({"t1": part.column("t1"), "t2": part.column("t2"), "spans": pa.array(spans, SPAN_TYPE)})

    held = rows.select("t1", "t2", "text").join(_few(candidates), ["t1", "t2"])
    spans = staged(held.mapInArrow(verify, f"t1 long, t2 long, spans {SPANS}").where(F.size("spans") > 0).dropDuplicates(["t1", "t2"]), "spans")
    out = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), "t1", "t2").join(_few(spans), ["t1", "t2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("exact", pa.bool_())]))
