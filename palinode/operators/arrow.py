"""The passes that no built-in expression states, as functions on strings that run in Arrow batches.

A Python function is evaluated for all rows of a batch whatever condition surrounds it, so each pass is gated by handing it null
for the rows it cannot concern; null costs nothing and gives null.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palinode.functions import tables as T
from palinode.functions.config import Config
from palinode.functions.expressions import RESULT, no_hits, result

Hits = list[tuple[str, str, str]]

_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORD = re.compile(f"[^{_SPACES}]+")
_KEYWORD = re.compile("|".join(map(re.escape, T.KEYWORDS)))


def _pass(function: Callable[[str], tuple[str, Hits]], text: Column, gate: Column) -> Column:
    @F.pandas_udf(RESULT)
    def batch(texts: pd.Series) -> pd.DataFrame:
        done = [function(t) if isinstance(t, str) else (None, None) for t in texts]
        hits = [None if h is None else [dict(zip(("original", "normalized", "detail"), x, strict=True)) for x in h] for _, h in done]
        return pd.DataFrame({"text": [t for t, _ in done], "hits": hits, "ratio": 0.0})

    # outside the gate the text stays as it is
    return F.when(gate, batch(F.when(gate, text))).when(text.isNotNull(), result(text, no_hits()))


def compose(text: str) -> tuple[str, Hits]:
    """Unicode composition (NFC)."""
    new = unicodedata.normalize("NFC", text)
    return (text, []) if new == text else (new, [(text, new, f"composed, {max(0, len(text) - len(new))} characters fewer")])


def punycode_label(label: str) -> str | None:
    """The text of a punycode label without its prefix, or None if it is none (RFC 3492 with 32-bit numbers)."""
    basic, _, tail = label.rpartition("-")
    out, n, i, bias, first = list(basic), 128, 0, 72, True
    at = 0
    while at < len(tail):
        old, weight, k = i, 1, 36
        while True:
            if at >= len(tail):
                return None
            c = tail[at]
            at += 1
            digit = ord(c) - 97 if "a" <= c <= "z" else ord(c) - 22 if "0" <= c <= "9" else 99
            if digit > 35:
                return None
            i += digit * weight
            threshold = min(26, max(1, k - bias))
            if digit < threshold:
                break
            weight *= 36 - threshold
            k += 36
            if i > 0xFFFFFFFF or weight > 0xFFFFFFFF:
                return None
        size = len(out) + 1
        delta = (i - old) // (700 if first else 2)
        first = False
        delta += delta // size
        steps = 0
        while delta > 455:
            delta //= 35
            steps += 36
        bias = steps + 36 * delta // (delta + 38)
        n += i // size
        i %= size
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            return None
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def punycode_of(table: dict[str, str]) -> Callable[[str], tuple[str, Hits]]:
    """Decodes labels that hide a keyword, behind the look-alikes of a table."""
    swap = str.maketrans(table)
    form = re.compile(r"[Xx][Nn]--[A-Za-z0-9-]*")

    def function(text: str) -> tuple[str, Hits]:
        pieces = re.findall(r"[ \t\n\f\r]+|[^ \t\n\f\r]+", text)
        changed = 0
        for k, piece in enumerate(pieces):
            if form.fullmatch(piece):
                shown = (punycode_label(piece.lower()[4:]) or "").translate(swap)
                if _KEYWORD.search(shown.lower()):
                    pieces[k] = shown
                    changed += 1
        if not changed:
            return text, []
        new = "".join(pieces)
        return new, [(text, new, f"labels decoded: {changed}")]

    return function


def base64_text(payload: str) -> str | None:
    """Strictly decoded base64 of printable ASCII, with or without its padding."""
    bare = payload.rstrip("=")
    if len(bare) % 4 == 1 or not bare.isascii():
        return None
    padded = bare + "=" * (-len(bare) % 4)
    try:
        raw = base64.b64decode(padded, validate=True)
    except (binascii.Error, ValueError):
        return None
    # spare bits must be zero
    if base64.b64encode(raw).decode() != padded:
        return None
    return raw.decode("ascii") if all(32 <= b < 127 or b == 10 for b in raw) else None


def base64_of(cfg: Config) -> Callable[[str], tuple[str, Hits]]:
    """Decodes calls with base64, and words of it that hide a keyword."""

    def function(text: str) -> tuple[str, Hits]:
        hits: Hits = []
        new = text
        for call in T.BASE64_CALLS:
            opening = call + '"'
            while (start := new.find(opening)) >= 0:
                a = start + len(opening)
                b = new.find('"', a)
                shown = base64_text(new[a:b]) if b >= 0 else None
                if shown is None:
                    break
                hits.append((new[start : b + 1], shown, f"call decoded: {shown[:60]}"))
                new = new[:start] + shown + new[b + 1 :]
        words = _WORD.findall(new)
        for word in words:
            a, b = 0, len(word)
            while a < b and not (word[a].isalnum() or word[a] in "+/="):
                a += 1
            while a < b and not (word[b - 1].isalnum() or word[b - 1] in "+/="):
                b -= 1
            payload = word[a:b]
            if len(payload.encode()) < cfg.base64_min_len or not re.fullmatch("[A-Za-z0-9+/=]*", payload):
                continue
            shown = base64_text(payload)
            if shown is not None and len(shown) >= 8 and _KEYWORD.search(shown.lower()):
                hits.append((payload, shown, f"word decoded: {shown[:60]}"))
                new = new.replace(payload, shown, 1)
        return new, hits

    return function


def morse_text(signs: str) -> str | None:
    """The letters of Morse signs, if at least two fifths are known and two characters come out."""
    letters, known, total = [], 0, 0
    for k, word in enumerate(signs.split(" / ")):
        if k:
            letters.append(" ")
        for sign in filter(None, word.split(" ")):
            total += 1
            known += sign in T.MORSE
            letters.append(T.MORSE.get(sign, "?"))
    out = "".join(letters)
    if not total or known * 100 // total < 40 or len(out.strip("?").strip(_SPACES)) < 2:
        return None
    return out


def morse_of(cfg: Config) -> Callable[[str], tuple[str, Hits]]:
    """Decodes stretches of Morse signs."""
    span = re.compile(r"[.\-/ ][.\-/ ,;:!]*")
    noise = re.compile("[,;:!]+")

    def function(text: str) -> tuple[str, Hits]:
        hits: Hits = []
        out: list[str] = []
        at = 0
        while m := span.search(text, at):
            out.append(text[at : m.start()])
            run = m[0]
            at = m.end()
            # where the whole run is no Morse, a later part of it may be; it must begin with a sign
            for k in range(len(run)):
                part = run[k:]
                if len(part) < cfg.morse_min_span:
                    out.append(part)
                    break
                if part[0] in ".-/ ":
                    signs = noise.sub("", part)
                    if len(signs) * 100 // len(part) >= cfg.morse_min_morse_pct and (shown := morse_text(signs)) is not None:
                        hits.append((part, shown, f"signs decoded: {shown[:40]}"))
                        out.append(shown)
                        break
                out.append(run[k])
        return ("".join([*out, text[at:]]), hits) if hits else (text, [])

    return function


def skeleton_of(table: dict[str, str]) -> Callable[[str], tuple[str, Hits]]:
    """Reduces a text to what it looks like, if that shows a keyword."""
    swap = str.maketrans(table)

    def function(text: str) -> tuple[str, Hits]:
        lowered = text.lower()
        if lowered.isascii():
            return text, []
        bare = unicodedata.normalize("NFD", unicodedata.normalize("NFD", lowered).translate(swap))
        word = next((k for k in T.KEYWORDS if k in bare and k not in lowered), None)
        return (text, []) if word is None else (bare, [(text, bare, f"looks like keyword {word}")])

    return function


def pre_scan_nfc(t: Column, cfg: Config) -> Column:
    """Composes; texts without a character from U+0300 on, or of a singleton, are composed already."""
    return _pass(compose, t, t.rlike(r"[^\x{0}-\x{2FF}]"))


def punycode(t: Column, cfg: Config, spark: SparkSession) -> Column:
    """Decodes punycode labels that hide a keyword, also behind look-alikes."""
    return _pass(punycode_of(T.homoglyphs(spark)), t, t.rlike("(?i)xn--"))


def base64_pass(t: Column, cfg: Config) -> Column:
    """Decodes base64 in calls, and words of base64 that hide a keyword."""
    return _pass(base64_of(cfg), t, t.rlike(rf'[A-Za-z0-9+/=]{{{max(1, min(cfg.base64_min_len, 12))},}}|(?:b64|base64)\.?decode\("|atob\("'))


def morse_code(t: Column, cfg: Config) -> Column:
    """Decodes stretches of Morse signs."""
    return _pass(morse_of(cfg), t, t.rlike(rf"[.\-/ ][.\-/ ,;:!]{{{max(0, cfg.morse_min_span - 1)},}}"))


def skeleton_match(t: Column, cfg: Config, spark: SparkSession) -> Column:
    """Reduces the text to what it looks like, if that shows a keyword that was not there."""
    return _pass(skeleton_of(T.skeletons(spark)), t, t.rlike(r"[^\x00-\x7F]"))
