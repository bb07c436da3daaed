"""One consistent form for texts that look the same.

Strings and code points that a reader cannot tell apart are united by union-find: the Unicode Character Database
gives width forms, joined letters, blanks and composition, a short table and the confusables of the Unicode library give letters of other scripts. Each class is
written as its most frequent member, and texts are rewritten by the longest patterns first with a multi-pattern automaton.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.tables import skeletons
from palinode.sources.shared import written

#: Letters of other scripts (left) that look like the Latin letter (right), case by case.
SAME_LETTER = (
    ("аАαΑ", "aAaA"), ("ВΒ", "BB"), ("сСϲϹ", "cCcC"), ("ԁ", "d"), ("еЕΕ", "eEE"), ("Ԍ", "G"), ("һНΗ", "hHH"), ("іІιΙӀ", "iIiII"),
    ("јЈϳͿ", "jJjJ"), ("КΚ", "KK"), ("МΜ", "MM"), ("ΝԚԛ", "NQq"), ("оОοΟօՕ", "oOoOoO"), ("рРρΡ", "pPpP"), ("ѕЅՏ", "sSS"), ("ТΤ", "TT"),
    ("սՍ", "uU"), ("νѵѴ", "vvV"), ("ԝԜ", "wW"), ("хХΧ", "xXX"), ("уҮΥү", "yYYy"), ("Ζ", "Z"), ("ո", "n"), ("ց", "g"), ("հ", "h"),
)

#: Signs of format that show (they enclose or introduce digits), so they are no invisible characters.
_SHOWN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Code points without a glyph that are not of the category of format characters.
_NO_GLYPH = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}


def invisible(ch: str) -> bool:
    """Whether a character shows nothing and takes no room."""
    cp = ord(ch)
    if cp in _NO_GLYPH:
        return True
    kind = unicodedata.category(ch)
    return kind == "Cf" and cp not in _SHOWN_FORMAT or kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x85"


@lru_cache(1)
def _nothing_shown() -> re.Pattern[str]:
    """A pattern of runs of invisible characters."""
    spans: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        if invisible(chr(cp)):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


class UnionFind:
    """Disjoint classes of hashable things."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.parent:
            by.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in by.values() if len(c) > 1]


def _confusable() -> Iterator[tuple[str, str]]:
    """Letters that look like one other letter of the same case, by the Unicode library; the hand list goes first.

    Letters with a decomposition (accents, bold and script forms) are left to the Unicode data.
    """
    known = {a for foreign, _ in SAME_LETTER for a in foreign}
    for ch, to in skeletons(SparkSession.getActiveSession()).items():
        if ch.isascii() or ch in known or len(to) != 1 or invisible(ch) or unicodedata.decomposition(ch) or unicodedata.decomposition(to):
            continue
        kind = unicodedata.category(ch)
        if kind in ("Lu", "Lo") and to == "l" and (kind == "Lu" or unicodedata.name(ch, "").startswith("LISU")):
            to = "I"  # the library writes both as l
        if kind in ("Lu", "Ll", "Lo") and unicodedata.category(to) in (kind, *(("Lu", "Ll") if kind == "Lo" else ())):
            yield ch, to


@lru_cache(1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """The classes of strings that look the same, closed under transitivity. Texts are decomposed before these apply."""
    same = UnionFind()
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or invisible(ch):
            continue
        if unicodedata.category(ch) == "Zs" or cp == 0x2800:
            same.union(ch, " ")
            continue
        kind, _, codes = unicodedata.decomposition(ch).partition("> ")
        whole = unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in codes.split()))
        joined = kind == "<compat" and len(whole) > 1 and all(unicodedata.category(c)[0] in "LM" for c in ch + whole)
        if kind in ("<wide", "<narrow") or joined:
            same.union(ch, whole)
    same.union("\t", " ")
    for foreign, latin in SAME_LETTER:
        for a, b in zip(foreign, latin, strict=True):
            same.union(a, b)
    for ch, to in _confusable():
        same.union(ch, to)
    return tuple(tuple(c) for c in same.classes())


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often each member of a class occurs in ``text`` over all rows; as many entries at most as the classes have members."""
    members = np.array(sorted({ord(x) for c in look_alike_classes() for x in c if len(x) == 1}))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(sys.maxunicode + 1, np.int64)
        for pdf in frames:
            for text in _chunks(pdf["text"].dropna()):
                codes = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
                seen[: len(codes)] += codes
        there = members[seen[members] > 0]
        yield pd.DataFrame({"cp": there.astype(np.int32), "n": seen[there]})

    counts = texts.select("text").mapInPandas(count, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))
    return {chr(r["cp"]): r["n"] for r in counts.collect()}


def _chunks(texts: Iterable[str], size: int = 1 << 20) -> Iterator[str]:
    """Texts put together to about ``size`` characters each."""
    held: list[str] = []
    n = 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield "".join(held)
            held, n = [], 0
    if held:
        yield "".join(held)


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """For each member of a class the most frequent one (at equal counts the least). A joined letter never stands for its letters."""
    single: dict[str, str] = {}
    strings: list[tuple[str, ...]] = []
    for c in look_alike_classes():
        if any(len(x) > 1 for x in c):
            strings.append(c)
            continue
        best = min(c, key=lambda x: (-counts.get(x, 0), x))
        single.update({x: best for x in c if x != best})
    table = dict(single)
    for c in strings:
        # the frequency of a string is that of its rarest part
        spelled = [x for x in c if len(x) > 1]
        best = min(spelled, key=lambda x: (-min(counts.get(y, 0) for y in x), x))
        best = "".join(single.get(x, x) for x in best)
        table.update({x: best for x in c if x != best})
    return table


class Rewriter:
    """Rewrites texts to their consistent form; pickles as its table, the automaton is built once per worker."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table

    def __getstate__(self) -> dict:
        return {"table": self.table}

    def _automaton(self):  # noqa: ANN202
        if not hasattr(self, "_machine"):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for pattern, to in self.table.items():
                machine.add_word(pattern, (len(pattern), to))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def one(self, text: str) -> str:
        """Decompose, drop what is invisible, rewrite the longest patterns from left to right, compose."""
        if text.isascii() and text.isprintable() and not self.ascii_moves():
            return text
        text = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
        bare = _nothing_shown().sub("", text)
        if len(bare) < len(text):
            # dropping may have brought marks together, so their order is settled again
            text = unicodedata.normalize("NFD", bare)
        out, at = [], 0
        for end, (length, to) in self._automaton().iter_long(text):
            out += [text[at : end + 1 - length], to]
            at = end + 1
        return unicodedata.normalize("NFC", "".join([*out, text[at:]]))

    def ascii_moves(self) -> bool:
        """Whether a printable ASCII character is rewritten (another script outnumbers it)."""
        if not hasattr(self, "_moves"):
            self._moves = any(p.isascii() and p.isprintable() for p in self.table)
        return self._moves

    def column(self, text: Column) -> Column:
        """The consistent form of a string column; null stays null, an empty text empty."""

        @F.pandas_udf("string")
        def rewrite(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else self.one(t))

        return rewrite(text)


def fitted(texts: DataFrame) -> Rewriter:
    """The rewriter whose representatives are the most frequent characters of all texts (column ``text``)."""
    return Rewriter(rewriting(character_counts(texts)))


def keyed(texts: DataFrame, rewriter: Rewriter) -> DataFrame:
    """``tbl``, ``id``, ``look``, ``body`` of the rows of ``texts`` (``tbl``, ``id``, ``text``): digests of the consistent form and of the text itself.

    Null texts and texts that show nothing have no row, repeated rows one. Every text is rewritten once; the result is written, and no text goes further.
    """

    @F.pandas_udf("struct<look:binary,body:binary>")
    def digests(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            form = None if t is None else rewriter.one(t)
            shown = form is not None and form.strip(" ") != ""
            rows.append((_digest(form), _digest(t)) if shown else (None, None))
        return pd.DataFrame(rows, columns=["look", "body"])

    # a function that may differ from call to call is not called again for each use of its result
    both = texts.select("tbl", "id", digests.asNondeterministic()("text").alias("d"))
    return written(both.select("tbl", "id", "d.look", "d.body"), "looks").where("look is not null").distinct()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _variants(keys: DataFrame) -> DataFrame:
    """``tbl``, ``look``, ``body``, ``copies`` of the different texts of each class."""
    return keys.groupBy("tbl", "look", "body").agg(F.count(F.lit(1)).alias("copies"))


def classes(keys: DataFrame) -> DataFrame:
    """``tbl``, ``look``, ``variants`` (different texts) and ``rows`` of the classes with more than one text."""
    return _variants(keys).groupBy("tbl", "look").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("rows")).where("variants > 1")


def members(keys: DataFrame) -> DataFrame:
    """``tbl``, ``id``, ``look``, ``variants``, ``links``: one row for each row that looks like another text, with its class and the number of rows that differ from it."""
    of = _variants(keys).join(classes(keys), ["tbl", "look"])
    return keys.join(of, ["tbl", "look", "body"]).select("tbl", "id", "look", "variants", (F.col("rows") - F.col("copies")).alias("links"))


def pairs(keys: DataFrame) -> DataFrame:
    """``tbl``, ``id_a`` < ``id_b``: the rows of ``keyed`` that look the same and whose texts differ. Exact copies of one text are no pair.

    The different texts of a class are paired first and their rows joined to them after, so copies of a text are never compared with each other.
    ``members`` has the same in as many rows as the table.
    """
    mixed = _variants(keys).join(classes(keys).select("tbl", "look"), ["tbl", "look"], "left_semi").select("tbl", "look", "body")
    two = mixed.withColumnRenamed("body", "body_a").join(mixed.withColumnRenamed("body", "body_b"), ["tbl", "look"]).where("body_a < body_b")
    side = lambda s: keys.select("tbl", "look", F.col("body").alias(f"body_{s}"), F.col("id").alias(f"id_{s}"))
    each = two.join(side("a"), ["tbl", "look", "body_a"]).join(side("b"), ["tbl", "look", "body_b"]).where("id_a <> id_b")
    return each.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
