"""Building blocks of expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palinode.functions import tables as T

HIT = "struct<original:string,normalized:string,detail:string>"
HITS = f"array<{HIT}>"
#: What every pass gives: the text it leaves, its detections in order, and a ratio for the score.
RESULT = f"struct<text:string,hits:{HITS},ratio:float>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_hits() -> Column:
    """The empty list of detections."""
    return F.array().cast(HITS)


def hit(original: Column, normalized: Column, detail: Column | str) -> Column:
    """One detection."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(original.alias("original"), normalized.alias("normalized"), detail.alias("detail")).cast(HIT)


def result(text: Column, hits: Column, ratio: Column | None = None) -> Column:
    """The outcome of a pass."""
    ratio = F.lit(0.0) if ratio is None else ratio
    return F.struct(text.alias("text"), hits.cast(HITS).alias("hits"), ratio.cast("float").alias("ratio"))


def replaced_if(fired: Column, text: Column, new: Column, detail: Column | str) -> Column:
    """The outcome of a pass that replaces the whole text by ``new`` if it fired."""
    return F.when(fired, result(new, F.array(hit(text, new, detail)))).otherwise(result(text, no_hits()))


def character(point: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0")), "UTF-32")


def is_scalar(point: Column) -> Column:
    """Whether a number is the code point of a character."""
    return point.between(0, 0xD7FF) | point.between(0xE000, 0x10FFFF)


def any_keyword(lowered: Column) -> Column:
    """Whether a text in lower case holds a keyword."""
    return lowered.rlike("|".join(re.escape(k) for k in T.KEYWORDS))


def characters(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def pieces(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    """How many matches a pattern has."""
    return F.regexp_count(text, F.lit(pattern))


def swapped(text: Column, table: dict[str, str]) -> Column:
    """Each character replaced by its entry in a table of single characters."""
    return F.translate(text, "".join(table), "".join(table.values()))

