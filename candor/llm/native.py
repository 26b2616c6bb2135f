"""Expressions for texts that the native operators share; all are built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.arrays import running_sum

#: Code points of a block.
BLOCK = 4096
SPANS = "array<struct<start:int,end:int,said:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also where use puts it into a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case words between white space; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, k: int) -> Column:
    """64-bit hashes of each k consecutive words, by place."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    # the words of a shingle one by one: cutting them out as an array costs several times as much
    shingle = lambda h: lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))
    none = F.array().cast("array<bigint>")
    return bound(hashed, lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), shingle(h))).otherwise(none))


def occurrences(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches: begin and end in code points, and what was matched. The running sum of the lengths of the
    text between matches and of the matches themselves gives the places, so the time follows the text and its matches."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(said: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, rx, -1), 1, F.size(said)), said, lambda b, s: F.length(b) + F.length(s))
        span = lambda s, end: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("said"))
        return F.when(F.size(said) > 0, F.zip_with(said, running_sum(steps), span)).otherwise(F.array().cast(SPANS))

    return bound(F.regexp_extract_all(text, rx, F.lit(0)), placed)


def blocks(text: Column) -> Column:
    """The text in parts of BLOCK code points, from which `cut` takes pieces without going through the text from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, begin: Column, end: Column) -> Column:
    """Code points [begin, end) of a text in blocks."""
    first = F.floor(begin / BLOCK).cast("int")
    last = F.floor((F.greatest(end, begin + 1) - 1) / BLOCK).cast("int")
    return F.substr(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), begin - first * BLOCK + 1, F.greatest(end - begin, F.lit(0)))
