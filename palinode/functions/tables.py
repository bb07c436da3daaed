"""Fixed tables of the passes, and the tables that follow from a rule."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed values -------------------------------------------------------------------------------------------------------

PASSES = (
    "pre-scan-nfc", "invisible-strip", "cjk-superposition", "bidi-control", "fullwidth-chars", "backslash-escape",
    "unicode-escape", "punycode", "rot13", "url-encoding", "html-entities", "base64", "morse-code", "homoglyph",
    "script-intrusion", "leetspeak", "entropy-bigram", "split-string", "skeleton-match",
)

KEYWORDS = (
    "ignore", "disregard", "bypass", "system prompt", "instruction", "pwned", "whoami", "exec", "eval", "import",
    "os.system", "child_process", "shell", "bash", "powershell", "system", "prompt", "override", "jailbreak", "forget",
    "reset", "sudo", "admin", "root", "chmod", "curl", "wget", "python", "javascript", "script",
)

LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "!": "i", "$": "s", "+": "t", "|": "l"}

MORSE = {
    ".-": "A", "-...": "B", "-.-.": "C", "-..": "D", ".": "E", "..-.": "F", "--.": "G", "....": "H", "..": "I", ".---": "J",
    "-.-": "K", ".-..": "L", "--": "M", "-.": "N", "---": "O", ".--.": "P", "--.-": "Q", ".-.": "R", "...": "S", "-": "T",
    "..-": "U", "...-": "V", ".--": "W", "-..-": "X", "-.--": "Y", "--..": "Z", "-----": "0", ".----": "1", "..---": "2",
    "...--": "3", "....-": "4", ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9", "-..-.": "/",
    ".-.-.-": ".", "..--..": "?", "--..--": ",", ".-..-": "/",
}

BIGRAMS = (
    "TH", "HE", "IN", "ER", "AN", "RE", "ON", "EN", "AT", "ES", "ED", "IS", "IT", "AL", "AR", "ST", "TO", "NT", "NG", "SE", "HA", "AS",
    "OU", "IO", "LE", "VE", "CO", "ME", "DE", "HI", "ND", "TI", "OR", "TE", "OF", "RI", "RO", "IC", "NE", "EA", "RA", "CE", "LI", "CH",
    "LL", "BE", "MA", "SI", "OM", "UR", "CA", "EL", "TA", "LA", "NS", "DI", "FO", "HO", "PE", "EC", "PR", "NO", "CT", "US", "AC", "OT",
    "IL", "TR", "LY", "NC", "ET", "UT", "SS", "SO", "RS", "UN", "LO", "WA", "GE", "IE", "WH", "EE", "WI", "EM", "AD", "OL", "RT", "PO",
    "WE", "NA", "UL", "NI", "TS", "MO", "OW", "PA", "IM", "MI", "AI", "SH", "IR", "SU", "ID", "OS", "IV", "IA", "AM", "FI", "CI", "VI",
    "PL", "IG", "TU", "EV", "LD", "RY", "MP", "FE", "BL", "DA", "AY", "GH", "TY", "UP", "QU", "SC", "KE", "EX",
)

#: Calls before whose quote a base64 payload stands, in the order in which they are looked for.
BASE64_CALLS = ("b64.decode(", "base64.decode(", "atob(", "b64decode(", "base64decode(")

#: Look-alikes of ASCII that the Unicode library in use has not, or has with another letter, by code point.
LOOK_ALIKES = {
    0x00FE: "p", 0x0192: "f", 0x01BF: "p", 0x03EC: "6", 0x03ED: "o", 0x03F8: "p", 0x0448: "w", 0x04CF: "l", 0x0582: "i",
    0x0969: "3", 0x09E6: "o", 0x0AE9: "3", 0x0B66: "o", 0x0CE6: "O", 0x0D1F: "s", 0x1004: "c", 0x105A: "c", 0x17E0: "o",
    0x2C82: "B", 0x2C93: "i", 0x2C9C: "3", 0x2CA9: "y", 0x2CBB: "-", 0x2CBD: "w", 0x2CC4: "3", 0x2CC7: "/", 0x2CCB: "9",
    0x2CCE: "P", 0x2CCF: "p", 0x2CD3: "6", 0x2CDC: "6", 0x114D0: "o", 0x11DD9: ":", 0x11DDA: "l", 0x11DE0: "O", 0x11DE1: "l",
    0x16EAA: "l", 0x16EB6: "b", 0x1E6E9: "+",
}

ENTROPY_TOKEN_LEN, ENTROPY_MIN_ALPHA, ENTROPY_CJK_GATE, ENTROPY_INPUT_MIN = 8, 6, 0.60, 12

# Classes of characters for regular expressions
INVISIBLE = r"[\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
BIDI = r"[\x{202A}-\x{202E}\x{200B}-\x{200F}\x{FEFF}\x{2060}]"
FULLWIDTH = r"[\x{FF01}-\x{FF5E}\x{3000}]"
CJK = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{3000}-\x{303F}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
    r"\x{FF65}-\x{FF9F}\x{FFA0}-\x{FFBE}]"
)
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ASCII_SPACE = r" \t\n\f\r"

# Tables from a rule -------------------------------------------------------------------------------------------------


_MADE: dict[str, dict[str, dict[str, str]]] = {}


def _looks(spark: SparkSession) -> dict[str, str]:
    checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    points = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000]
    found: dict[str, str] = {}
    # line feeds stand for themselves, so one call serves many characters
    for a in range(0, len(points), 50_000):
        part = points[a : a + 50_000]
        for ch, to in zip(part, checker.getSkeleton("\n".join(part)).split("\n"), strict=True):
            if ch != to:
                found[ch] = to
    return found


def skeletons(spark: SparkSession) -> dict[str, str]:
    """What each character looks like, by the confusables data of the Unicode library that ships with Spark; made once per driver."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, {})
    if "skeletons" not in made:
        made["skeletons"] = _looks(spark)
    return made["skeletons"]


def homoglyphs(spark: SparkSession) -> dict[str, str]:
    """Characters outside ASCII that look like one ASCII character. Full-width forms have a pass of their own."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, {})
    if "homoglyphs" not in made:
        table = {c: t for c, t in skeletons(spark).items() if len(t) == 1 and t.isascii() and not c.isascii() and not 0xFF01 <= ord(c) <= 0xFF5E and c != "\u3000"}
        # digits by their value, enclosed letters and digits by what they enclose
        table |= {chr(first + d): str(d) for first in (0x660, 0x6F0) for d in range(10)}
        table |= {chr(0x2460 + d): str(d + 1) for d in range(9)}
        table |= {chr(0x24B6 + n): chr(65 + n) for n in range(26)} | {chr(0x24D0 + n): chr(97 + n) for n in range(26)}
        made["homoglyphs"] = table | {chr(c): t for c, t in LOOK_ALIKES.items()}
    return made["homoglyphs"]
