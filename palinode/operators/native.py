"""The passes that built-in expressions state. Each takes a text column and gives ``RESULT``; null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palinode.functions import tables as T
from palinode.functions.config import Config
from palinode.functions.expressions import (
    any_keyword, character, characters, count, hit, is_scalar, let, no_hits, pieces, replaced_if, result, swapped,
)

_NON_ASCII = r"[^\x00-\x7F]"
_HEX_IDENTIFIER = r"^(?=.*[0-9])[0-9A-Fa-f-]+$"


def _points(text: Column, pattern: str, digits: int, most: int | None = None) -> Column:
    found = pieces(text, pattern)
    shown = F.slice(found, 1, most) if most else found
    return F.array_join(F.transform(shown, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), digits, "0"))), ", ")


def invisible_strip(t: Column, cfg: Config) -> Column:
    """Variation selectors and tag characters are removed."""
    n = count(t, T.INVISIBLE)
    more = F.when(n > 12, "...").otherwise("")
    detail = F.concat(F.lit("removed "), n.cast("string"), F.lit(" invisible: ["), _points(t, T.INVISIBLE, 5, 12), more, F.lit("]"))
    return replaced_if(t.rlike(T.INVISIBLE), t, F.regexp_replace(t, T.INVISIBLE, ""), detail)


def bidi_control(t: Column, cfg: Config) -> Column:
    """Direction controls and zero-width characters are removed."""
    detail = F.concat(F.lit("removed: "), _points(t, T.BIDI, 4))
    return replaced_if(t.rlike(T.BIDI), t, F.regexp_replace(t, T.BIDI, ""), detail)


def fullwidth_chars(t: Column, cfg: Config) -> Column:
    """Full-width forms become ASCII, the ideographic space a space."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " "}
    sample = F.array_join(F.slice(pieces(t, T.FULLWIDTH), 1, 8), "")
    return replaced_if(t.rlike(T.FULLWIDTH), t, swapped(t, table), F.concat(F.lit("full-width, such as "), sample))


def _zone(c: Column) -> Column:
    p = F.ascii(c)
    return (
        F.when((p < 0x80) | p.between(0xFF01, 0xFF5E), 0)
        .when(p.between(0x400, 0x52F), 1)
        .when(p.between(0x370, 0x3FF), 2)
        .when(c.rlike(T.CJK), 3)
        .otherwise(4)
    )


def cjk_superposition(t: Column, cfg: Config) -> Column:
    """A text in which the scripts of mirrored positions change within a window is emptied; the passes after it see nothing."""
    w, n = cfg.cjk_super_window, F.length(t)
    share = count(t, T.CJK).cast("float") / n.cast("float")
    gate = (n >= 2 * w) & (share >= F.lit(cfg.cjk_super_min_cjk_frac).cast("float"))

    def entropy(window: Column) -> Column:
        part = lambda k: F.size(F.filter(window, lambda x: x == k)) / float(w)
        return F.aggregate(F.array_distinct(window), F.lit(0.0), lambda h, k: h - part(k) * F.ln(part(k)))

    def spiked(zones: Column) -> Column:
        keys = F.zip_with(zones, F.reverse(zones), lambda a, b: a * 5 + b)
        return let(keys, lambda k: F.exists(F.sequence(F.lit(1), F.size(k) - w + 1), lambda i: entropy(F.slice(k, i, w)) > cfg.cjk_super_threshold))

    fired = F.when(gate, let(F.transform(characters(t), _zone), spiked)).otherwise(False)
    return replaced_if(fired, t, F.when(t.isNotNull(), F.lit("")), "scripts of mirrored positions differ within a window")


def backslash_escape(t: Column, cfg: Config) -> Column:
    """Runs of characters with a backslash each lose the backslashes, if there are three or more."""
    a = r"[\x00-\x09\x0B\x0C\x0E-\x7F]"
    run = rf"(?:(?!\A)\G\\|\\(?={a}\\[\x00-\x7F]))({a})"
    n = count(t, run)
    return replaced_if(F.contains(t, F.lit("\\")) & (n >= 3), t, F.regexp_replace(t, run, "$1"), F.concat(F.lit("backslashes removed: "), n.cast("string")))


def unicode_escape(t: Column, cfg: Config) -> Column:
    """Escapes by hexadecimal and octal numbers are decoded if that shows a keyword, or if there are four."""
    token = r"\\x[0-7][0-9A-Fa-f]|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\[0-3][0-7]{2}|\\[0-7]{1,2}(?![0-7])|[^\\]+|\\"

    def point(x: Column) -> Column:
        escaped = (F.substring(x, 1, 1) == "\\") & (F.length(x) > 1)
        base8 = x.rlike(r"^\\[0-7]")
        digits = F.regexp_extract(x, r"^\\[xu]?\{?([0-9A-Fa-f]+)", 1)
        p = F.when(base8, F.conv(digits, 8, 10)).otherwise(F.conv(digits, 16, 10)).cast("bigint")
        return F.when(escaped & is_scalar(p), p)

    def decoded(tokens: Column) -> Column:
        both = F.transform(tokens, lambda x: let(point(x), lambda p: F.struct(F.coalesce(character(p), x).alias("to"), (p.isNotNull() & ~x.rlike(r"^\\[0-7]$")).alias("counts"))))
        return let(both, finished)

    def finished(b: Column) -> Column:
        out = F.array_join(F.transform(b, lambda x: x["to"]), "")
        n = F.size(F.filter(b, lambda x: x["counts"]))
        found = any_keyword(F.lower(out))
        detail = F.concat(F.lit("escapes decoded: "), n.cast("string"), F.when(found, ", a keyword among them").otherwise(""))
        return replaced_if(((n >= 1) & found) | (n >= 4), t, out, detail)

    return F.when(F.contains(t, F.lit("\\")) & (F.length(t) >= 3), let(pieces(t, token), decoded)).when(t.isNotNull(), result(t, no_hits()))


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TURNED = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"


def rot13(t: Column, cfg: Config) -> Column:
    """Words of four letters or more are rotated by 13, if that shows a keyword that was not there."""
    tokens = pieces(t, rf"[{T.ASCII_SPACE}]+|[^{T.ASCII_SPACE}]+")
    turned = F.array_join(F.transform(tokens, lambda x: F.when(x.rlike(r"^[A-Za-z]{4,}$"), F.translate(x, _LETTERS, _TURNED)).otherwise(x)), "")
    # a keyword that appears stands, at least with one of its words, in the text rotated as a whole
    gate = any_keyword(F.lower(F.translate(t, _LETTERS, _TURNED)))
    words = F.array(*map(F.lit, T.KEYWORDS))

    def judged(new: Column) -> Column:
        shown = F.when(any_keyword(F.lower(new)), F.exists(words, lambda k: F.contains(F.lower(new), k) & ~F.contains(F.lower(t), k))).otherwise(False)
        return replaced_if(shown & (new != t), t, new, "words rotated by 13 show a keyword")

    return F.when(gate, let(turned, judged)).when(t.isNotNull(), result(t, no_hits()))


def url_encoding(t: Column, cfg: Config) -> Column:
    """Runs of percent escapes that decode to a keyword are decoded, each a detection."""
    byte = r"%[0-9A-Fa-f]{2}"
    tokens = pieces(t, rf"(?:{byte})+|[^%]+|%")

    def accepted(x: Column) -> Column:
        raw = F.unhex(F.replace(x, F.lit("%"), F.lit(""))).cast("string")
        long_enough = x.rlike(rf"^(?:{byte}){{{max(1, cfg.url_min_run)},}}$")
        return F.when(long_enough, F.when(F.is_valid_utf8(raw) & any_keyword(F.lower(raw)), raw))

    def decoded(xs: Column) -> Column:
        both = F.transform(xs, lambda x: F.struct(x.alias("from"), accepted(x).alias("to")))
        return let(both, finished)

    def finished(b: Column) -> Column:
        hits = F.transform(F.filter(b, lambda x: x["to"].isNotNull()), lambda x: hit(x["from"], x["to"], "percent escapes decoded"))
        return result(F.array_join(F.transform(b, lambda x: F.coalesce(x["to"], x["from"])), ""), hits)

    return F.when(t.rlike(byte), let(tokens, decoded)).when(t.isNotNull(), result(t, no_hits()))


def html_entities(t: Column, cfg: Config) -> Column:
    """Character references are decoded if there are enough of them and the text then holds a keyword."""
    tokens = pieces(t, r"&(?:amp;?|lt;?|gt;?|quot;?|apos;?)|&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|[^&]+|&")
    named = F.create_map(*[F.lit(x) for kv in {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.items() for x in kv])

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?0*([0-9A-Fa-f]*)", 1)
        base16 = x.rlike("^&#[xX]")
        point = F.when(F.length(digits) > 9, F.lit(-1)).when(digits == "", F.lit(0)).when(base16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
        numeric = let(point, lambda p: F.when(is_scalar(p), character(p)))
        return F.when(x.rlike("^&#."), numeric).when(x.rlike("^&."), F.element_at(named, F.regexp_extract(x, "^&([a-z]+)", 1)))

    def decoded(xs: Column) -> Column:
        both = F.transform(xs, lambda x: F.struct(x.alias("from"), one(x).alias("to")))
        return let(both, finished)

    def finished(b: Column) -> Column:
        n = F.size(F.filter(b, lambda x: x["to"].isNotNull()))
        out = F.array_join(F.transform(b, lambda x: F.coalesce(x["to"], x["from"])), "")
        found = F.when(n >= cfg.html_min_entities, any_keyword(F.lower(out))).otherwise(False)
        return replaced_if(found, t, out, F.concat(F.lit("references decoded: "), n.cast("string")))

    return F.when(F.contains(t, F.lit("&")) & (count(t, "&") >= cfg.html_min_entities), let(tokens, decoded)).when(t.isNotNull(), result(t, no_hits()))


def _script(c: Column) -> Column:
    p = F.ascii(c)
    return (
        F.when(p < 0x80, 0)
        .when(p.between(0x400, 0x52F), 1)
        .when(p.between(0x370, 0x3FF) | p.between(0x1F00, 0x1FFF), 2)
        .when(p.between(0x4E00, 0x9FFF) | p.between(0x3040, 0x30FF), 3)
        .otherwise(4)
    )


def interference(t: Column) -> Column:
    """The share of positions whose script differs from that of the mirrored position."""
    def share(scripts: Column) -> Column:
        differ = F.zip_with(scripts, F.reverse(scripts), lambda a, b: a != b)
        return F.size(F.filter(differ, lambda d: d)).cast("float") / F.size(scripts).cast("float")

    return F.when(t.rlike(_NON_ASCII), let(F.transform(characters(t), _script), share)).otherwise(F.lit(0.0)).cast("float")


def homoglyph(t: Column, cfg: Config, spark: SparkSession) -> Column:
    """Look-alikes of ASCII characters are replaced in words that hold ASCII letters or digits or are look-alikes altogether.

    The ratio is the interference of scripts, measured before the replacement.
    """
    # white space parts words and is never replaced
    table = {c: to for c, to in T.homoglyphs(spark).items() if not re.match(r"\s", c) and to != " "}
    tokens = lambda x: pieces(x, rf"[{T.SPACE}]+|[^{T.SPACE}]+")

    # a word of look-alikes alone has no ASCII before and nothing else after
    eligible = lambda old, new: old.rlike("[A-Za-z0-9]") | (new.rlike(r"^[\x00-\x7F]+$") & old.rlike(r"^[^\x00-\x7F]+$"))

    def chosen(swap: Column) -> Column:
        words = F.zip_with(tokens(t), tokens(swap), lambda old, new: F.when((old != new) & eligible(old, new), new).otherwise(old))
        return F.when(swap == t, t).otherwise(F.array_join(words, ""))

    def replaced(new: Column) -> Column:
        fired = new != t
        hits = F.when(fired, F.array(hit(t, new, "look-alike characters replaced"))).otherwise(no_hits())
        return result(new, hits, interference(t))

    plain = F.when(t.isNotNull(), result(t, no_hits()))
    return F.when(t.rlike(_NON_ASCII), let(let(swapped(t, table), chosen), replaced)).otherwise(plain)


def script_intrusion(t: Column, cfg: Config) -> Column:
    """A word with two ASCII letters or digits holds something foreign that is no accented Latin letter. The text stays."""
    strange = lambda w: (F.length(w) >= 3) & w.rlike(r"[^\x00-\x7F\x{C0}-\x{24F}]") & (count(w, "[A-Za-z0-9]") >= 2)
    fired = F.when(t.rlike(_NON_ASCII), F.exists(F.split(t, rf"[{T.SPACE}]+"), strange)).otherwise(False)
    return F.when(t.isNotNull(), result(t, F.when(fired, F.array(hit(t, t, "foreign character inside an ASCII word"))).otherwise(no_hits())))


def leetspeak(t: Column, cfg: Config) -> Column:
    """Words that are rich in digits and signs for letters are spelt out; the words are then one space apart. The ratio is the share of such signs."""
    leet = "[" + "".join(T.LEET) + "]"
    alpha = lambda w: count(w, r"[\p{IsAlphabetic}\p{N}]")
    words = F.filter(F.split(t, rf"[{T.SPACE}]+"), lambda w: w != "")

    def judged(w: Column) -> Column:
        rich = (alpha(w) >= cfg.leet_min_alpha) & (count(w, "[A-Za-z]") >= 2)
        dense = F.floor(count(w, leet) * 100 / F.greatest(alpha(w), F.lit(1))) >= cfg.leet_min_pct
        return F.when(w.rlike(leet) if cfg.leet_min_pct > 0 else F.lit(True), ~w.rlike(_HEX_IDENTIFIER) & rich & dense).otherwise(False)

    def decoded(ws: Column) -> Column:
        marked = F.transform(ws, lambda w: F.struct(w.alias("w"), judged(w).alias("is")))
        return let(marked, finished)

    def finished(m: Column) -> Column:
        hitwords = F.filter(m, lambda x: x["is"])
        total = lambda f: F.aggregate(hitwords, F.lit(0), lambda a, x: a + f(x["w"]))
        new = F.array_join(F.transform(m, lambda x: F.when(x["is"], swapped(x["w"], T.LEET)).otherwise(x["w"])), " ")
        signs = total(lambda w: count(w, leet))
        ratio = F.least(F.lit(1.0).cast("float"), signs.cast("float") / total(alpha).cast("float"))
        first = F.element_at(hitwords, 1)["w"]
        sample = F.concat(F.lit(", such as "), first, F.lit(" for "), swapped(first, T.LEET))
        return F.when(F.size(hitwords) > 0, result(new, F.array(hit(t, new, F.concat(F.lit("substitutions: "), signs.cast("string"), sample))), ratio)).otherwise(result(t, no_hits()))

    return F.when(t.rlike(leet) if cfg.leet_min_pct > 0 else t.isNotNull(), let(words, decoded)).when(t.isNotNull(), result(t, no_hits()))


def entropy_bigram(t: Column, cfg: Config) -> Column:
    """A long word with too many different characters, or with too few pairs of letters that English has. The text stays."""
    coded = r"[$(){}:\\/]"
    pairs = "(?=" + "|".join(T.BIGRAMS) + ")"

    def english(w: Column) -> Column:
        capitals = F.when(w.rlike(_NON_ASCII), F.array_join(F.transform(characters(w), lambda c: F.substring(F.upper(c), 1, 1)), "")).otherwise(F.upper(w))
        return F.when(count(w, r"\p{IsAlphabetic}") >= T.ENTROPY_MIN_ALPHA, count(capitals, pairs).cast("float") / (F.length(w) - 1).cast("float")).otherwise(F.lit(1.0))

    def unlikely(w: Column) -> Column:
        return (count(w, r"\p{IsAlphabetic}") >= T.ENTROPY_MIN_ALPHA) & (english(w) < F.lit(cfg.entropy_min_english).cast("float"))

    def bits(w: Column) -> Column:
        def of(chars: Column) -> Column:
            part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda h, c: h - part(c) * F.log2(part(c)))

        return let(characters(w), of)

    def entropy(w: Column) -> Column:
        # so many bits need so many different characters
        needed = 2.0 ** min(cfg.entropy_high, 30.0)
        return F.when(F.length(w) > needed - 1, bits(w)).otherwise(F.lit(0.0) if cfg.entropy_high >= 0 else bits(w))

    def odd(w: Column) -> Column:
        looked_at = (F.length(w) >= T.ENTROPY_TOKEN_LEN) & ~w.rlike(coded) & ~w.rlike(_HEX_IDENTIFIER)
        return F.when(looked_at, unlikely(w) | (entropy(w) > cfg.entropy_high)).otherwise(False)

    def told(words: Column) -> Column:
        scored = F.transform(words, lambda w: F.struct(w.alias("w"), F.round(bits(w), 9).alias("bits"), english(w).cast("double").alias("english")))
        first = F.struct(F.lit("").alias("w"), F.lit(-1.0).alias("bits"), F.lit(2.0).alias("english"))
        worst = F.aggregate(scored, first, lambda a, x: F.when((x["bits"] > a["bits"]) | (x["english"] < a["english"]), x).otherwise(a))
        found = F.array(hit(t, t, F.concat(F.lit("a word of unlikely characters: "), worst["w"])))
        return F.when(F.size(words) > 0, result(t, found)).otherwise(result(t, no_hits()))

    n = F.length(t)
    prose = count(t, T.CJK).cast("float") / n.cast("float") <= F.lit(T.ENTROPY_CJK_GATE).cast("float")
    some = let(F.filter(F.split(t, rf"[{T.SPACE}]+"), odd), told)
    return F.when((n >= T.ENTROPY_INPUT_MIN) & prose, some).when(t.isNotNull(), result(t, no_hits()))


def split_string(t: Column, cfg: Config) -> Column:
    """Keywords whose letters stand in order with nothing but other signs between; one detection each. The text stays."""
    words = F.array(*[F.lit(k) for k in T.KEYWORDS if re.fullmatch("[a-z]+", k)])
    letters = F.lower(F.regexp_replace(t, "[^A-Za-z]+", ""))

    def found(x: Column) -> Column:
        hidden = F.filter(words, lambda k: F.contains(x["letters"], k) & ~F.contains(x["lowered"], k))
        return result(t, F.transform(hidden, lambda k: hit(t, t, F.concat(F.lit("keyword in pieces: "), k))))

    # without a keyword in the letters alone there is nothing to look for
    gate = (F.octet_length(t) >= 8) & any_keyword(letters)
    return F.when(gate, let(F.struct(letters.alias("letters"), F.lower(t).alias("lowered")), found)).when(t.isNotNull(), result(t, no_hits()))


__all__ = [
    "backslash_escape", "bidi_control", "cjk_superposition", "entropy_bigram", "fullwidth_chars", "homoglyph", "html_entities",
    "interference", "invisible_strip", "leetspeak", "rot13", "script_intrusion", "split_string", "unicode_escape", "url_encoding",
]
