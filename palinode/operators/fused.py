"""All passes on one text, for the Arrow stage of the pipeline.

The passes of ``native`` and ``arrow`` are columns, one plan each; nineteen of them in a row make a plan that takes longer than the work, and every
look at single characters makes arrays of them. Here a batch of texts crosses to Python once and every pass begins with a
test that most texts fail. Each function takes a text and gives the text it leaves, its hits and a ratio, as its column does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import regex

from palinode.functions import tables as T
from palinode.functions.config import BASE_CONFIDENCE, Config
from palinode.operators import arrow

Hits = list[tuple[str, str, str]]
Done = tuple[str, Hits, float]


def _class(java: str) -> re.Pattern[str]:
    """A class of characters as written in the tables."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), java))


_INVISIBLE, _BIDI, _FULL, _CJK = map(_class, (T.INVISIBLE, T.BIDI, T.FULLWIDTH, T.CJK))
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32}
_KEYWORD = re.compile("|".join(map(re.escape, T.KEYWORDS)))
_SPACED = _class(f"[{T.SPACE}]+|[^{T.SPACE}]+")
_WORDS = _class(f"[^{T.SPACE}]+")
_LONG = _class(f"[^{T.SPACE}]{{{T.ENTROPY_TOKEN_LEN},}}")
_HEXLIKE = re.compile(r"(?=.*[0-9])[0-9A-Fa-f-]+")
_ALPHABETIC = regex.compile(r"\p{Alphabetic}")
_ALPHANUMERIC = regex.compile(r"[\p{Alphabetic}\p{N}]")


def _units(text: str, points: list[str], digits: int, most: int | None = None) -> str:
    return ", ".join(f"U+{ord(c):0{digits}X}" for c in points[:most])


def _scalar(point: int) -> bool:
    return 0 <= point <= 0xD7FF or 0xE000 <= point <= 0x10FFFF


def nfc(t: str, cfg: Config) -> Done:
    return (t, [], 0.0) if t.isascii() else (*arrow.compose(t), 0.0)


def invisible(t: str, cfg: Config) -> Done:
    if t.isascii() or not (found := _INVISIBLE.findall(t)):
        return t, [], 0.0
    new = _INVISIBLE.sub("", t)
    return new, [(t, new, f"removed {len(found)} invisible: [{_units(t, found, 5, 12)}{'...' if len(found) > 12 else ''}]")], 0.0


def cjk(t: str, cfg: Config) -> Done:
    w = cfg.cjk_super_window
    if t.isascii() and cfg.cjk_super_min_cjk_frac > 0 or len(t) < 2 * w or not t:
        return t, [], 0.0
    if len(_CJK.findall(t)) / len(t) < float(np.float32(cfg.cjk_super_min_cjk_frac)):
        return t, [], 0.0
    zones = [_zone(c) for c in t]
    keys = [a * 5 + b for a, b in zip(zones, reversed(zones), strict=True)]
    for i in range(len(keys) - w + 1):
        h = 0.0
        for n in Counter(keys[i : i + w]).values():
            h -= n / w * math.log(n / w)
        if h > cfg.cjk_super_threshold:
            return "", [(t, "", "scripts of mirrored positions differ within a window")], 0.0
    return t, [], 0.0


def _zone(c: str) -> int:
    p = ord(c)
    if p < 0x80 or 0xFF01 <= p <= 0xFF5E:
        return 0
    return 1 if 0x400 <= p <= 0x52F else 2 if 0x370 <= p <= 0x3FF else 3 if _CJK.match(c) else 4


def bidi(t: str, cfg: Config) -> Done:
    if t.isascii() or not (found := _BIDI.findall(t)):
        return t, [], 0.0
    new = _BIDI.sub("", t)
    return new, [(t, new, f"removed: {_units(t, found, 4)}")], 0.0


def fullwidth(t: str, cfg: Config) -> Done:
    if t.isascii() or not (found := _FULL.findall(t)):
        return t, [], 0.0
    new = t.translate(_WIDE)
    return new, [(t, new, "full-width, such as " + "".join(found[:8]))], 0.0


def backslash(t: str, cfg: Config) -> Done:
    if t.count("\\") < 3:
        return t, [], 0.0
    out, at, n, size = [], 0, 0, len(t)
    inner = lambda k: k < size and t[k].isascii() and t[k] not in "\n\r"
    while (p := t.find("\\", at)) >= 0:
        out.append(t[at:p])
        q = p
        if inner(p + 1) and p + 3 < size and t[p + 2] == "\\" and t[p + 3].isascii():
            while q < size and t[q] == "\\" and inner(q + 1):
                out.append(t[q + 1])
                n += 1
                q += 2
        else:
            out.append("\\")
            q += 1
        at = q
    return ("".join([*out, t[at:]]), [(t, "".join([*out, t[at:]]), f"backslashes removed: {n}")], 0.0) if n >= 3 else (t, [], 0.0)


_ESCAPE = re.compile(r"\\x[0-7][0-9A-Fa-f]|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\[0-3][0-7]{2}|\\[0-7]{1,2}(?![0-7])")


def escapes(t: str, cfg: Config) -> Done:
    if "\\" not in t or len(t) < 3:
        return t, [], 0.0
    n = 0

    def one(m: re.Match[str]) -> str:
        nonlocal n
        x = m[0]
        point = int(x[1:], 8) if x[1] in "01234567" else int(x[2:].strip("{}"), 16)
        if not _scalar(point):
            return x
        n += len(x) > 2
        return chr(point)

    new = _ESCAPE.sub(one, t)
    shown = bool(n) and _KEYWORD.search(new.lower()) is not None
    if shown or n >= 4:
        return new, [(t, new, f"escapes decoded: {n}{', a keyword among them' if shown else ''}")], 0.0
    return t, [], 0.0


_TURN = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM")
_TURNABLE = re.compile(rf"(?<![^{T.ASCII_SPACE}])[A-Za-z]{{4,}}(?![^{T.ASCII_SPACE}])")


def rot13(t: str, cfg: Config) -> Done:
    if not _KEYWORD.search(t.translate(_TURN).lower()):
        return t, [], 0.0
    new = _TURNABLE.sub(lambda m: m[0].translate(_TURN), t)
    if new == t:
        return t, [], 0.0
    shown, there = new.lower(), t.lower()
    if any(k in shown and k not in there for k in T.KEYWORDS):
        return new, [(t, new, "words rotated by 13 show a keyword")], 0.0
    return t, [], 0.0


def url(t: str, cfg: Config) -> Done:
    if "%" not in t:
        return t, [], 0.0
    hits: Hits = []

    def one(m: re.Match[str]) -> str:
        x = m[0]
        if len(x) < 3 * max(1, cfg.url_min_run):
            return x
        try:
            raw = bytes.fromhex(x.replace("%", "")).decode()
        except ValueError:
            return x
        if not _KEYWORD.search(raw.lower()):
            return x
        hits.append((x, raw, "percent escapes decoded"))
        return raw

    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", one, t), hits, 0.0


_REFERENCE = re.compile(r"&(amp|lt|gt|quot|apos);?|&#([xX]?)([0-9A-Fa-f]+);?")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(?:amp;?|lt;?|gt;?|quot;?|apos;?)|&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?")


def entities(t: str, cfg: Config) -> Done:
    if "&" not in t or t.count("&") < cfg.html_min_entities:
        return t, [], 0.0
    n = 0

    def one(m: re.Match[str]) -> str:
        nonlocal n
        name, base16, digits = _REFERENCE.fullmatch(m[0]).groups()
        if name:
            n += 1
            return _NAMED[name]
        digits = digits.lstrip("0")
        point = -1 if len(digits) > 9 else int(digits or "0", 16 if base16 else 10)
        if not _scalar(point):
            return m[0]
        n += 1
        return chr(point)

    new = _ENTITY.sub(one, t)
    if n >= cfg.html_min_entities and _KEYWORD.search(new.lower()):
        return new, [(t, new, f"references decoded: {n}")], 0.0
    return t, [], 0.0


def _scripts() -> np.ndarray:
    """The script of each code point below 0x10000; one more for all others."""
    table = np.full(0x10001, 4, np.uint8)
    for number, spans in enumerate(([(0, 0x7F)], [(0x400, 0x52F)], [(0x370, 0x3FF), (0x1F00, 0x1FFF)], [(0x4E00, 0x9FFF), (0x3040, 0x30FF)])):
        for a, b in spans:
            table[a : b + 1] = number
    return table


_SCRIPT = _scripts()


def interference(t: str) -> float:
    """The share of positions whose script differs from that of the mirrored position."""
    if t.isascii():
        return 0.0
    scripts = _SCRIPT[np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 0x10000)]
    return int(np.count_nonzero(scripts != scripts[::-1])) / len(scripts)


def _homoglyph(table: dict[str, str]) -> Callable[[str, Config], Done]:
    swap = str.maketrans({c: to for c, to in table.items() if not re.match(r"\s", c) and to != " "})
    some = re.compile("[A-Za-z0-9]")

    def function(t: str, cfg: Config) -> Done:
        if t.isascii():
            return t, [], 0.0
        ratio = interference(t)
        if (whole := t.translate(swap)) == t:
            return t, [], ratio
        words = zip(_SPACED.findall(t), _SPACED.findall(whole), strict=True)
        # a word of look-alikes alone has no ASCII before and nothing else after
        new = "".join([b if a != b and (some.search(a) or b.isascii() and not any(c.isascii() for c in a)) else a for a, b in words])
        return (t, [], ratio) if new == t else (new, [(t, new, "look-alike characters replaced")], ratio)

    return function


_STRANGE = re.compile("[^\x00-\x7f\u00c0-\u024f]")


def intrusion(t: str, cfg: Config) -> Done:
    if not t.isascii():
        for w in _WORDS.findall(t):
            if len(w) >= 3 and _STRANGE.search(w) and sum(c.isascii() and c.isalnum() for c in w) >= 2:
                return t, [(t, t, "foreign character inside an ASCII word")], 0.0
    return t, [], 0.0


_LEET = str.maketrans(T.LEET)
_LEET_SIGNS = frozenset(T.LEET)
_LEET_ANY = re.compile("[" + re.escape("".join(T.LEET)) + "]")


def _signs(w: str) -> int:
    return sum(c in _LEET_SIGNS for c in w)


def _alphanumerics(w: str) -> int:
    return sum(c.isalnum() for c in w) if w.isascii() else len(_ALPHANUMERIC.findall(w))


def leet(t: str, cfg: Config) -> Done:
    if cfg.leet_min_pct > 0 and not _LEET_ANY.search(t):
        return t, [], 0.0

    def judged(w: str) -> bool:
        if cfg.leet_min_pct > 0 and not _LEET_ANY.search(w) or _HEXLIKE.fullmatch(w):
            return False
        alpha = _alphanumerics(w)
        rich = alpha >= cfg.leet_min_alpha and sum(c.isascii() and c.isalpha() for c in w) >= 2
        return rich and _signs(w) * 100 // max(alpha, 1) >= cfg.leet_min_pct

    words = _WORDS.findall(t)
    marked = [judged(w) for w in words]
    if not any(marked):
        return t, [], 0.0
    new = " ".join([w.translate(_LEET) if m else w for w, m in zip(words, marked, strict=True)])
    found = [w for w, m in zip(words, marked, strict=True) if m]
    signs, total = sum(map(_signs, found)), sum(map(_alphanumerics, found))
    return new, [(t, new, f"substitutions: {signs}, such as {found[0]} for {found[0].translate(_LEET)}")], min(1.0, signs / total) if total else 1.0


_CODED = re.compile(r"[$(){}:\\/]")
_PAIRS = frozenset(T.BIGRAMS)


def bigrams(t: str, cfg: Config) -> Done:
    if len(t) < T.ENTROPY_INPUT_MIN:
        return t, [], 0.0
    if not t.isascii() and len(_CJK.findall(t)) / len(t) > float(np.float32(T.ENTROPY_CJK_GATE)):
        return t, [], 0.0
    least, needed = float(np.float32(cfg.entropy_min_english)), 2.0 ** min(cfg.entropy_high, 30.0)

    def judged(w: str) -> tuple[float, float] | None:
        """Bits and share of English pairs of a word that is odd."""
        if _CODED.search(w) or _HEXLIKE.fullmatch(w):
            return None
        english = 1.0
        if (sum(c.isalpha() for c in w) if w.isascii() else len(_ALPHABETIC.findall(w))) >= T.ENTROPY_MIN_ALPHA:
            capitals = w.upper() if w.isascii() else "".join([c.upper()[:1] for c in w])
            english = sum(capitals[k : k + 2] in _PAIRS for k in range(len(capitals) - 1)) / (len(w) - 1)
        odd = english < least and english < 1.0
        return (round(_entropy(w), 9), english) if odd or (len(w) > needed - 1 or cfg.entropy_high < 0) and _entropy(w) > cfg.entropy_high else None

    memo: dict[str, tuple[float, float] | None] = {}  # a word that occurs again is judged once
    worst, bits, english = None, -1.0, 2.0
    for w in _LONG.findall(t):
        if w not in memo:
            memo[w] = judged(w)
        if (x := memo[w]) and (x[0] > bits or x[1] < english):
            worst, (bits, english) = w, x
    return (t, [], 0.0) if worst is None else (t, [(t, t, f"a word of unlikely characters: {worst}")], 0.0)


def _entropy(w: str) -> float:
    return -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())


_LETTERS = [k for k in T.KEYWORDS if re.fullmatch("[a-z]+", k)]
_NO_LETTER = re.compile("[^A-Za-z]+")


def split(t: str, cfg: Config) -> Done:
    letters = _NO_LETTER.sub("", t).lower()
    if not _KEYWORD.search(letters) or len(t.encode()) < 8:
        return t, [], 0.0
    lowered = t.lower()
    return t, [(t, t, f"keyword in pieces: {k}") for k in _LETTERS if k in letters and k not in lowered], 0.0


def passes(cfg: Config, homoglyphs: dict[str, str], skeletons: dict[str, str]) -> list[tuple[str, Callable[[str, Config], Done]]]:
    """Every pass by name, in order."""
    punycode, base64, morse, skeleton = arrow.punycode_of(homoglyphs), arrow.base64_of(cfg), arrow.morse_of(cfg), arrow.skeleton_of(skeletons)
    span = re.compile(rf"[.\-/ ][.\-/ ,;:!]{{{max(0, cfg.morse_min_span - 1)},}}")
    coded = re.compile(rf'[A-Za-z0-9+/=]{{{max(1, min(cfg.base64_min_len, 12))},}}|(?:b64|base64)\.?decode\("|atob\("')

    def gated(function: Callable[[str], tuple[str, Hits]], gate: Callable[[str], object]) -> Callable[[str, Config], Done]:
        return lambda t, _: (*function(t), 0.0) if gate(t) else (t, [], 0.0)

    return [
        ("pre-scan-nfc", nfc), ("invisible-strip", invisible), ("cjk-superposition", cjk), ("bidi-control", bidi), ("fullwidth-chars", fullwidth),
        ("backslash-escape", backslash), ("unicode-escape", escapes), ("punycode", gated(punycode, lambda t: "xn--" in t.lower())), ("rot13", rot13),
        ("url-encoding", url), ("html-entities", entities), ("base64", gated(base64, coded.search)), ("morse-code", gated(morse, span.search)),
        ("homoglyph", _homoglyph(homoglyphs)), ("script-intrusion", intrusion), ("leetspeak", leet), ("entropy-bigram", bigrams), ("split-string", split),
        ("skeleton-match", gated(skeleton, lambda t: not t.isascii())),
    ]


def _confidence(kind: str, original: str, normalized: str) -> float:
    n = len(original)
    change = np.float32(min(abs(n - len(normalized)) / n, 1.0)) if n else np.float32(0.0)
    return float(min(np.float32(BASE_CONFIDENCE[kind]) + change * np.float32(0.20), np.float32(1.0)))


class Scanner:
    """The chosen passes one after the other; pickles as its tables, the passes are made once per worker."""

    def __init__(self, kinds: Iterable[str], cfg: Config, homoglyphs: dict[str, str], skeletons: dict[str, str]) -> None:
        self.kinds, self.cfg, self.homoglyphs, self.skeletons = frozenset(kinds), cfg, homoglyphs, skeletons

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_chosen"}

    def chosen(self) -> list[tuple[str, Callable[[str, Config], Done]]]:
        if not hasattr(self, "_chosen"):
            # look-alikes are replaced as long as one of these two is on
            on = self.kinds | ({"homoglyph"} if "script-intrusion" in self.kinds else set())
            self._chosen = [(k, f) for k, f in passes(self.cfg, self.homoglyphs, self.skeletons) if k in on]
        return self._chosen

    def scan(self, text: str) -> dict:
        """``text`` (what is left), ``found`` (detections in order), the two ratios and ``halted``."""
        now, found, ratios, replaced = text, [], {"homoglyph": 0.0, "leetspeak": 0.0}, False
        for kind, function in self.chosen():
            before = now
            now, hits, ratio = function(now, self.cfg)
            if kind == "homoglyph":
                replaced = bool(hits)
            if kind in ratios:
                ratios[kind] = ratio
            if kind == "script-intrusion" and replaced:
                now, hits = before, []
            found += [{"kind": kind, "original": a, "normalized": b, "detail": d, "confidence": _confidence(kind, a, b)} for a, b, d in hits]
            if kind == "cjk-superposition" and hits:
                return {"text": "", "found": found, "mixed": 0.0, "leet": 0.0, "halted": True}
        return {"text": now, "found": found, "mixed": ratios["homoglyph"], "leet": ratios["leetspeak"], "halted": False}

    def score(self, scanned: dict) -> float:
        """The weights of all detections and the two ratios of a scanned text, in single precision and at most 1."""
        if scanned["halted"]:
            return 1.0
        total = np.float32(0.0)
        for d in scanned["found"]:
            total += np.float32(self.cfg.weight(d["kind"]))
        total = total + np.float32(scanned["mixed"]) * np.float32(0.60) + np.float32(scanned["leet"]) * np.float32(0.40)
        return float(min(total, np.float32(1.0)))

    @staticmethod
    def reaches(score: float, threshold: float) -> bool:
        """Whether a score reaches a threshold, both in single precision."""
        return bool(np.float32(score) >= np.float32(threshold))
