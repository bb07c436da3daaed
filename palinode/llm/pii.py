"""Personal information in free text: found, weighed by what the corpus discloses, and replaced by typed placeholders.

Addresses, numbers and mail addresses have a form of their own. Names have none: a run of capitalised words may be a person,
a firm or a street. What tells them apart is learnt from the whole corpus. Every word and every surrounding phrase is a
term; how often it stands together with protected entities (runs of a known given and a known family name) estimates, in bits, how
strongly the term gives a person away. A run whose terms exceed the disclosure threshold is a name, known or not, and is removed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.sources.shared import written

#: Share of a term's occurrences that must be with protected entities, and how many bits above chance that must be unless the
#: share is SURE (where most runs are names, chance is high).
WORD_SHARE, CONTEXT_SHARE, BITS, SURE = 0.25, 0.2, 1.0, 0.5
#: A word is no name if its share plus so many standard errors is under half of WORD_SHARE; a context is sure if its share less as many is SURE.
ERRORS = 2.0
#: A lexicon of so many words is sent to every task; a larger one is joined.
MAX_LEXICON = 500_000
#: So many telling terms are sent to every task; more are joined with the runs that have them.
MAX_TERMS = 200_000
#: Words that a task counts before it passes its counts on.
MANY_WORDS = 2_000_000
Roles = dict[str, set[str]]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

_HID = "[​-‏⁠﻿­]*"
_B = "[    ]"  # a blank within a line
_AT = rf"(?:{_HID}[@＠]{_HID}|{_B}*[\[({{<]{_B}*(?:at|AT|a|arroba){_B}*[\])}}>]{_B}*|&#64;|%40)"
_DOT = rf"(?:{_HID}\.{_HID}|{_B}*[\[({{]{_B}*(?:dot|DOT|punkt|punto|point){_B}*[\])}}]{_B}*)"
_LOCAL = r"[\w%+'-]+"
_LABEL = r"[\w-]+"
_SPELT_DOT = rf"(?:{_B}+(?:dot|DOT){_B}+)"
_TLD = r"[^\W\d_]{2,24}"
_EMAIL = re.compile(
    rf"(?<![\w/.@])(?:{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}{_LABEL}(?:(?:{_DOT}|{_SPELT_DOT}){_LABEL})*(?:{_DOT}|{_SPELT_DOT}){_TLD}"
    rf"|{_LOCAL}(?:(?:\.|{_SPELT_DOT}){_LOCAL})*{_B}+(?:at|AT){_B}+{_LABEL}(?:{_SPELT_DOT}{_LABEL})*{_SPELT_DOT}{_TLD})(?![\w@])"
)
#: Ends of file names that also follow an at-sign (image densities, scripts).
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico", "avif", "pdf"}

#: Every at-sign of _EMAIL: as a sign, in brackets, and spelt before a label and a spelt dot.
_SIGN, _BRACKETED = "[@＠]|&#64;|%40", rf"[\[({{<]{_B}*(?:at|AT|a|arroba){_B}*[\])}}>]"
_SPELT = rf"{_B}(?:at|AT)(?={_B}+{_LABEL}{_SPELT_DOT})"
_AT_SIGNS = {(x, y): re.compile("|".join([_SIGN, *([_BRACKETED] if x else []), *([_SPELT] if y else [])])) for x in (False, True) for y in (False, True)}
_OPENING = re.compile(r"[\[({<]")
#: Longer than any mail address on either side of its sign may be by its standard (254 letters).
_MAIL = 260


def _at_signs(text: str) -> Iterator[re.Match[str]]:
    """The at-signs of a text; forms of which it lacks a part are not looked for."""
    return _AT_SIGNS[_OPENING.search(text) is not None, "dot" in text or "DOT" in text].finditer(text)


_S = "[    .-]"
_PHONE = re.compile(
    rf"(?<![\w+/.,:-])(?:"
    rf"\+\d{{1,3}}(?:{_S}?\(0?\d{{0,4}}\){_S}?|{_S})?\d{{1,5}}(?:{_S}?\d{{1,5}}){{1,6}}"  # international
    rf"|\(\d{{2,5}}\){_B}?\d{{3,5}}(?:{_S}\d{{2,6}}){{0,3}}"  # area in brackets
    rf"|[2-9]\d\d[-.  ][2-9]\d\d[-.  ]\d{{4}}"  # ten digits, North America
    rf"|0\d{{1,4}}[/  -]\d{{3,8}}(?:[  -]\d{{2,6}}){{0,2}}"  # national, area first
    rf"|0\d(?:[ . -]\d\d){{4}}"  # national, pairs
    rf")(?![\w/]|[.,:-]\d)"
)
_I = "[    -]"
_ID = re.compile(
    rf"(?<![\w+/.,:-])(?:"
    rf"[12]{_I}?\d\d{_I}?\d\d{_I}?\d[\dAB]{_I}?\d{{3}}{_I}?\d{{3}}{_I}?\d\d"  # 13 digits and a key of two
    rf"|\d{{3}}([  -])\d\d\1\d{{4}}"  # three, two, four
    rf"|\d\d{_I}\d{{3}}{_I}\d{{3}}{_I}\d{{3}}"  # two and three threes
    rf"|[A-Za-z]{{2}}{_I}?\d\d{_I}?\d\d{_I}?\d\d{_I}?[A-Da-d]"  # two letters, six digits, one letter
    rf"|\d{{8}}-?[A-Za-z]|[XYZ]-?\d{{7}}-?[A-Z]"  # eight digits and a check letter
    rf"|(?P<eleven>\d{{3}}-\d{{3}}-\d{{3}}[  -]\d\d)"  # three threes and a checksum of two
    rf"|(?P<account>[A-Z]{{2}}\d\d(?:{_I}?[A-Z0-9]{{4}}){{2,7}}(?:{_I}?[A-Z0-9]{{1,3}})?)"  # an account number with a checksum
    rf")(?![\w/]|[.,:-]\d|-\w)"
)



def _checks(m: re.Match[str]) -> bool:
    """Whether the checksum of a number is right, where its form has one."""
    if m["eleven"]:
        digits = [int(c) for c in m[0] if c.isdigit()]
        return sum(d * (9 - k) for k, d in enumerate(digits[:9])) % 101 % 100 == digits[9] * 10 + digits[10]
    if m["account"]:
        bare = "".join(c for c in m[0] if c.isalnum())
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    return True


_UP = "A-ZÀ-ÖØ-ÞĀČŁŚŠŻŽА-ЯЁ"
_LO = "a-zß-öø-ÿā-ſа-яё'’�¶"  # the last two as left by a wrong decoding
_CAP = rf"[{_UP}](?:[{_LO}{_UP}]*)"
#: Words for kinds of streets, before or after the name.
_AFTER = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|crescent|way|terrace|square|sq|boulevard|blvd|place|pl|row|hill|gardens|grove|mews"
_BEFORE = (
    "rue|avenue|av|boulevard|bd|chemin|allée|impasse|place|quai|route|cours|passage|calle|c/|avenida|avda|paseo|plaza|camino|carrera|carretera|ronda|travesía"
    "|via|viale|piazza|corso|rua|улица|ул|проспект|пр-т|пр|переулок|пер|набережная|наб|площадь|пл|бульвар|шоссе"
)
_LINK = "de la|de los|de las|de l['’]|de|du|des|del|della|di|da|do|dos|la|le|les|d['’]"
_NO = rf"(?:(?:No|no|NO|Nr|nr|N)\.?[º°]?{_B}?|n\.?[º°єÂ�]{{1,2}}{_B}?|№{_B}?|(?:дом|д\.){_B}?)"
_HOUSE = rf"\d{{1,4}}(?:{_B}?(?:bis|ter|quater|BIS|TER)\b|{_B}?[A-Za-z]\b|[/-]\d{{1,3}}\b)?"
#: Longer house numbers stand only before the name of the street.
_LONG_HOUSE = r"\d{5}(?:[A-Za-z]\b)?"
_NUMBER_FIRST = re.compile(
    rf"{_LONG_HOUSE}{_B}+(?:{_CAP}{_B}+){{1,3}}(?i:(?:{_AFTER})\b)(?:\.(?=\s|,|$))?(?!\w)"
    rf"|{_HOUSE}(?:{_B}+(?:{_CAP}{_B}+){{1,3}}(?i:(?:{_AFTER})\b)(?:\.(?=\s|,|$))?"
    rf"|,?{_B}+(?i:(?:{_BEFORE})\b\.?){_B}+(?:(?i:{_LINK}){_B}*)*{_CAP}(?:[{_B[1:-1]}-]{_CAP})*)(?!\w)"
)
_KIND_FIRST = re.compile(rf"(?<!\w)(?i:(?:{_BEFORE})(?!\w)\.?){_B}*(?:(?i:{_LINK}){_B}+)*{_CAP}(?:{_B}{_CAP}){{0,2}},?{_B}*(?:{_NO})?$")
_NAME_FIRST = re.compile(
    rf"(?<!\w)(?:{_CAP}[-{_B[1:-1]}]){{0,2}}(?:{_CAP})?(?i:stra(?:[^\sa-z]{{1,2}}|ss)e|str\.?|weg|gasse|allee|platz|ring|damm|ufer){_B}+(?:{_NO})?$"
)
#: Endings of German street names.
_ENDINGS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer")
#: Numbers without a form of their own: seven to fifteen digits on a line, or one or two letters and six digits or more.
_LOOSE = re.compile(rf"(?<![\w+/.,:%-])(?:\+?\(?\d(?:{_S}?[()/]?{_S}?\d){{6,14}}|[A-ZА-Я]{{1,2}}{_B}?\d{{6,9}})(?![\w/%]|[.,:-]\d|-\w)")
_NUMBERED = re.compile(rf"(?<!\w){_NO}$")
_HOUSE_AT = re.compile(rf"{_HOUSE}(?!\w)")
_NUMBER = re.compile(r"\d{1,5}(?![\d:%]|[.,]\d)")
_DIGITS = re.compile(r"\d[\d()\s./\xa0\u2009\u202f-]{4,}\d")

#: Particles between given and family name.
_PARTICLE = "van|von|de|del|della|der|den|la|le|da|di|du|dos|das|af|av|zu|ten|ter|el|al|bin|ibn|y|van de|van der|von der|de la"
#: Titles, which are no part of a name.
_TITLES = set("mr mrs ms miss mx dr prof sir lady frau herr fräulein m mme mlle madame monsieur maître sr sra srta don doña señor señora dom dona signor signora".split())
_PART = rf"{_CAP}(?:[-‐]{_CAP})*"
_RUN = re.compile(rf"(?<![\w@.'’-]){_PART}(?:,?{_B}+(?:(?:{_PARTICLE}){_B}+)*(?:[{_UP}]\.(?={_B})|{_PART}))+(?![\w@'’])")
_TOKEN = re.compile(rf"{_PART}\.?|(?:{_PARTICLE})(?=\W)|,")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Letters before a house number in which the name of its street is looked for, and around a run or number for a start; further ones are read if words are longer.
_NEAR, _WINDOW = 120, 48


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for n in _at_signs(text):
        for m in _EMAIL.finditer(text, max(at, n.start() - _MAIL), n.end() + _MAIL):
            if m.start() <= n.start() < m.end() and m[0].rpartition(".")[2].lower() not in _FILES:
                at = m.end()
                yield m.span()
                break


def _streets(text: str) -> Iterator[tuple[int, int]]:
    """Found from the house number, by what stands before and after it."""
    for n in _NUMBER.finditer(text):
        a = n.start()
        if a and (text[a - 1] in ".,/-_" or text[a - 1].isalnum()):
            continue
        if m := _NUMBER_FIRST.match(text, a):
            before = _NUMBERED.search(text, max(0, a - 6), a)
            yield before.start() if before else a, m.end()
            continue
        if len(n[0]) > 4:
            continue
        # most numbers follow an ordinary word
        line = text.rfind("\n", 0, a) + 1
        words = text[max(line, a - _NEAR) : a].rsplit(None, 2)
        last = words[-2] if len(words) > 1 and _NUMBERED.search(words[-1]) else words[-1] if words else ""
        last = last.rstrip(".,")
        if last and (last[0].isupper() or last.lower().endswith(_ENDINGS) or "stra" in last) and (house := _HOUSE_AT.match(text, a)):
            # a street has a few words, so what stands further off can't be part of its name
            low = max(line, a - 2 * _NEAR)
            before = _NAME_FIRST.search(text, low, a) or _KIND_FIRST.search(text, low, a)
            if before and text[before.start()] != " ":
                yield before.start(), house.end()


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Identity and phone numbers, looked for around stretches of digits."""
    for n in _DIGITS.finditer(text):
        a, b = max(0, n.start() - 12), n.end() + 8
        for kind, form in (("id_number", _ID), ("phone", _PHONE)):
            for m in form.finditer(text, a, b):
                if kind == "id_number" and _checks(m) or kind == "phone" and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield kind, *m.span()


def loose_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that may be of a person by what stands around them."""
    at = 0
    for n in _DIGITS.finditer(text):
        for m in _LOOSE.finditer(text, max(at, n.start() - 4), n.end() + 1):
            at = m.end()
            yield m.span()


def fixed_forms(text: str) -> list[tuple[str, int, int]]:
    """Type, start and end of what has a form of its own, in order and without overlap; the earlier type wins."""
    found: list[tuple[str, int, int]] = []
    every = [("email", *s) for s in _emails(text)] + [("street_address", *s) for s in _streets(text)] + sorted(_numbers(text))
    for kind, a, b in every:
        if all(b <= s or e <= a for _, s, e in found):
            found.append((kind, a, b))
    return sorted(found, key=lambda f: f[1])


_PIECE = re.compile(r"\w+|[^\w\s]")


def _beside(text: str, at: int, step: int) -> list[str]:
    """Three words or signs before a place of a line, or two after it."""
    reach = _WINDOW
    while True:
        if step < 0:
            low = max(0, at - reach)
            near, _, line = text[low:at].rpartition("\n")[::-1]
            found = _PIECE.findall(near)
            # the first of a stretch that is cut may be part of a word
            if line or not low or len(found) > 3:
                return found[-3:]
        else:
            near, line, _ = text[at : at + reach].partition("\n")
            found = _PIECE.findall(near)
            if line or at + reach >= len(text) or len(found) > 2:
                return found[:2]
        reach *= 4


def _context(text: str, a: int, b: int) -> list[str]:
    """Terms around a run within its line: one and two words on either side, or that the line ends there."""
    left, right = _beside(text, a, -1), _beside(text, b, 1)
    left = [w for w in left if not w.isdigit()] if len(left) > 1 else left
    terms = ["l1 " + (left[-1] if left else "^"), "r1 " + (right[0] if right else "$")]
    if len(left) > 1:
        terms.append("l2 " + " ".join(left[-2:]))
    if len(right) > 1:
        terms.append("r2 " + " ".join(right[:2]))
    # signs alone disclose nothing: they stand beside everything
    return [t for t in terms if any(c.isalpha() for c in t[3:])]


def _parts(run: str) -> list[tuple[str, int, int, str]]:
    """Pieces of a run: text, start, end and kind (name, initial, particle, comma)."""
    pieces = []
    for m in _TOKEN.finditer(run):
        t = m[0]
        kind = "comma" if t == "," else "particle" if t[0].islower() else "initial" if len(t.rstrip(".")) == 1 else "name"
        end = m.end() - (kind == "name" and t[-1] == ".")
        pieces.append((run[m.start() : end], m.start(), end, kind))
    return pieces


def _key(word: str) -> str:
    return word.lower()


def _spans(pieces: list[tuple[str, int, int, str]], fits: list[bool]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Stretches of a run that may be a name, the longest first: from, to, given names, family names.

    Stretches of more than seven pieces are looked at only where every word ``fits`` a name.
    """
    n = len(pieces)
    a = 0
    while a < n:  # the long ones
        b = a
        while b < n and (fits[b] if pieces[b][3] == "name" else pieces[b][3] != "comma"):
            b += 1
        x, y = a, b
        while x < y and pieces[x][3] != "name":
            x += 1
        while y > x and pieces[y - 1][3] != "name":
            y -= 1
        if y - x > 7 or sum(p[3] == "name" for p in pieces[x:y]) > 4:
            names = [p[0] for p in pieces[x:y] if p[3] == "name"]
            yield x, y, names[:-1], [names[-1]]
        a = max(b, a + 1)
    for size in range(min(n, 7), 1, -1):
        for a in range(n - size + 1):
            part = pieces[a : a + size]
            kinds = [p[3] for p in part]
            if kinds[0] != "name" or kinds[-1] != "name":
                continue
            commas = kinds.count("comma")
            if commas:
                if kinds == ["name", "comma", "name"]:
                    yield a, a + size, [part[2][0]], [part[0][0]]
                continue
            names = [p[0] for p in part if p[3] == "name"]
            if 2 <= len(names) <= 4:
                yield a, a + size, names[:-1], [names[-1]]


FACTS = "kind string, key string, doc string, start int, body string, terms array<string>, n bigint, low bigint"


def scan(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts. Rows of four kinds: ``found`` (fixed forms: type in ``key``), ``number`` (numbers without a form), ``run`` (capitalised
    words), numbers and runs with the terms around them, ``n`` being 0 in a copy, and ``word`` (how often each word is written with and without a capital, per task).

    Copies of a text come to one task, and only the first of them counts as usage of the language."""

    def counted(seen: Counter[str]) -> pd.DataFrame:
        counts: dict[str, list[int]] = {}
        for stretch, n in seen.items():
            for w in _WORDS.findall(stretch):
                counts.setdefault(_key(w), [0, 0])[w[0].islower()] += n
        return pd.DataFrame([("word", w, None, 0, None, None, n, low) for w, (n, low) in counts.items()], columns=columns)

    columns = ["kind", "key", "doc", "start", "body", "terms", "n", "low"]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()  # by stretches between blanks, which words never cross
        texts: set[int] = set()
        for pdf in frames:
            rows = []
            for doc, t, digest in zip(pdf["key"], pdf["text"], pdf["digest"], strict=True):
                first = digest not in texts
                texts.add(digest)
                taken = fixed_forms(t)
                rows += [("found", kind, doc, a, t[a:b], _context(t, a, b) if kind in ("phone", "id_number") else None, int(first), 0) for kind, a, b in taken]
                free = lambda a, b: not any(s < b and a < e for _, s, e in taken)  # noqa: B023, E731
                rows += [("number", None, doc, a, t[a:b], _context(t, a, b), int(first), 0) for a, b in loose_numbers(t) if free(a, b)]
                rest = t
                for _, a, b in reversed(taken):  # words inside addresses are no usage of the language
                    rest = f"{rest[:a]} {rest[b:]}"
                if first:
                    seen.update(rest.split())
                for m in _RUN.finditer(t):
                    a, b = m.span()
                    if free(a, b):
                        rows.append(("run", None, doc, a, m[0], _context(t, a, b), int(first), 0))
            yield pd.DataFrame(rows, columns=columns)
            if len(seen) > MANY_WORDS:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    rows = documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text is not null")
    rows = rows.withColumn("digest", F.xxhash64("text")).repartition("digest")
    return rows.mapInPandas(look, FACTS)


def numbers_told(facts: DataFrame) -> DataFrame:
    """``doc``, ``pii_type``, ``start``, ``surface`` of the numbers without a form that their context gives away.

    A context is a term; of all numbers beside it, the share that have the form of a phone or identity number estimates how strongly it
    tells that a number is one. Where that surely exceeds SURE, numbers without a form beside it are taken for one too.
    """
    numbers = facts.where("kind = 'number' or kind = 'found' and terms is not null")
    each = numbers.where("n > 0").select(F.explode("terms").alias("term"), F.coalesce("key", F.lit("")).alias("type"))
    types = ("phone", "id_number")
    seen = each.groupBy("term").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("type") == t).alias(t) for t in types])
    of = [F.struct(F.lit(t).alias("pii_type"), (F.col(t) / F.col("all")).alias("share")) for t in types]
    told = seen.select("term", "all", F.explode(F.array(*of)).alias("x")).where((F.col("x.share") > 0) & (_bound(F.col("x.share"), F.col("all"), -ERRORS) >= SURE))
    loose = numbers.where("kind = 'number'").select("doc", "start", F.col("body").alias("surface"), F.explode("terms").alias("term"))
    met = loose.join(told.select("term", "x.pii_type", "x.share"), "term").groupBy("doc", "start", "surface")
    return met.agg(F.max(F.struct("share", "pii_type"))["pii_type"].alias("pii_type")).select("doc", "pii_type", "start", "surface")


def _couples(pieces: list[tuple[str, int, int, str]]) -> Iterator[tuple[str, str, str]]:
    """Neighbouring name words of a run as (given, family, word before them)."""
    names = [(_key(t), kind) for t, _, _, kind in pieces if kind in ("name", "comma")]
    for i, (word, kind) in enumerate(names[:-1]):
        following = names[i + 1]
        before = names[i - 1][0] if i and names[i - 1][1] == "name" else ""
        if kind == "name" and following[1] == "name":
            yield word, following[0], before
        elif kind == "name" and i + 2 < len(names):
            yield names[i + 2][0], word, before  # family, given


def _known(roles: Roles, found: Iterable | None) -> Roles:
    """The roles of the words of a run: ``roles`` of a small lexicon, or what a join with a large one ``found`` of them."""
    return roles if found is None else {x["term"]: set(x["roles"]) for x in found}


def co_occurrence(runs: DataFrame, roles: Roles) -> DataFrame:
    """Per task, how often each term stands with a protected entity: ``term``, ``role``, ``near`` (occurrences of a context), ``with``.

    A word is given next to a known family name, family next to a known given name, and a lead right before an entity (a
    title or a word of the frame); a context is what stands around a run.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: Counter[tuple[str, str]] = Counter()
        met: Counter[tuple[str, str]] = Counter()
        for pdf in frames:
            for body, terms, known in zip(pdf["body"], pdf["terms"], pdf["known"], strict=True):
                mine = _known(roles, known)
                entity = False
                for given, family, before in _couples(_parts(body)):
                    known_family = any("family" in mine.get(p, ()) for p in family.split("-"))
                    known_given = "given" in mine.get(given, ())
                    met[given, "given"] += known_family
                    met[family, "family"] += known_given
                    if known_family and known_given:
                        entity = True
                        if before:
                            met[before, "lead"] += 1
                for t in terms:
                    near[t, "context"] += 1
                    met[t, "context"] += entity
        rows = [(t, r, near[t, r], n) for (t, r), n in met.items() if n or r == "context"]
        yield pd.DataFrame(rows, columns=["term", "role", "near", "with"])

    return runs.select("body", "terms", "known").mapInPandas(count, "term string, role string, near bigint, with bigint")


def _bound(share: Column, seen: Column, z: float) -> Column:
    """Wilson's bound of a share, ``z`` standard errors off."""
    return (share + z * z / (2 * seen) + z * F.sqrt(share * (1 - share) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)


def disclosure(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``term``, ``role``, ``share``, ``bits`` of the terms that give a person away, and the words that do not: with role ``capital`` if they
    are never written small, else ``plain``. Contexts and leads that surely stand with entities have the role ``sure`` besides.

    ``share`` is the part of the term's occurrences that stand with a protected entity, shrunk towards none where there are few;
    ``bits`` is its pointwise mutual information with such entities over the whole corpus.
    """
    sums = written(counts.groupBy("term", "role").agg(F.sum("near").alias("near"), F.sum("with").alias("with")), "terms")  # read several times
    each = sums.join(words, "term", "left").withColumn("all", F.when(F.col("role") == "context", F.col("near") + 1.0).otherwise(F.col("n") + F.col("low") + 0.5))
    base = each.groupBy("role").agg((F.sum("with") / F.sum("all")).alias("base"))  # four rows
    told = each.join(F.broadcast(base), "role").withColumn("share", F.col("with") / F.col("all")).withColumn("bits", F.log2(F.col("share") / F.col("base")))
    enough = F.when(F.col("role") == "context", CONTEXT_SHARE).otherwise(WORD_SHARE)
    some = F.col("with") >= F.when(F.col("role") == "lead", 3).otherwise(1)  # a middle name is a lead now and then
    strong = told.where(some & (F.col("share") >= enough) & ((F.col("bits") >= BITS) | (F.col("share") >= SURE))).select("term", "role", "share", "bits")
    named = told.where(F.col("role").isin("given", "family")).groupBy("term").agg(F.max("share").alias("best"))
    sure = told.where(some & F.col("role").isin("context", "lead") & (_bound(F.col("share"), F.col("all"), -ERRORS) >= SURE))
    most = _bound(F.coalesce("best", F.lit(0.0)), F.col("n") + F.col("low") + 0.5, ERRORS)
    weak = (
        words.join(named, "term", "left")
        .where((F.col("low") > F.col("n")) | (most < WORD_SHARE / 2))
        .select("term", F.when(F.col("low") == 0, "capital").otherwise("plain").alias("role"), F.lit(1.0).alias("share"), F.lit(0.0).alias("bits"))
    )
    return strong.unionByName(weak).unionByName(sure.select("term", F.lit("sure").alias("role"), "share", "bits"))


def names_in(run: str, terms: list[str], told: dict[str, dict[str, float]], roles: Roles) -> list[tuple[int, int]]:
    """Start and end of the names in a run. ``told`` has the disclosing terms of the run by role.

    A name needs words on both sides that the lexicon or the corpus knows in that role; or, in a disclosing context, words of
    which none is known to be no name. What is left then is looked at again: where a context is sure, a word that the corpus knows from
    elsewhere, but never writes small, may be a name too.
    """
    pieces = _parts(run)
    out: list[tuple[int, int]] = []
    taken: set[int] = set()

    def side(word: str, role: str) -> bool:
        return any(role in roles.get(p, ()) or role in told.get(p, ()) for p in (_key(word), *re.split("[-‐]", _key(word))))

    def no_name(word: str, sure: bool) -> bool:
        return _key(word) in _TITLES or bool({"plain", "lead", *(() if sure else ("capital",))} & told.get(_key(word), {}).keys())

    fitting = [kind == "name" and (side(w, "given") or side(w, "family")) for w, _, _, kind in pieces]
    spans = list(_spans(pieces, fitting))
    for (a, b, given, family), again in [(s, again) for again in (False, True) for s in spans]:
        if taken and not taken.isdisjoint(range(a, b)):
            continue
        fits = [side(g, "given") for g in given] + [side(f, "family") for f in family]
        beside = [told[t] for t in terms if t in told and (t[0] == "l" and a == 0 or t[0] == "r" and b == len(pieces))]
        if a > 0 and "lead" in (before := told.get(_key(pieces[a - 1][0]), {})):
            beside.append(before)
        near = bool(beside)
        doubtful = [no_name(w, again and any("sure" in x for x in beside)) for w in (*given, *family)]
        if all(fits) and (near or not any(doubtful)) or near and b - a <= 7 and len(fits) <= 4 and not any(d and not f for d, f in zip(doubtful, fits, strict=True)):
            out.append((pieces[a][1], pieces[b - 1][2]))
            taken |= set(range(a, b))
    return sorted(out)


def find(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``pii_type``, ``start`` (characters before it), ``surface``: every piece of personal information.

    ``lexicon`` has known name words (``token``, ``role`` given or family). Types are email, phone, id_number, street_address and
    person_name; pieces never overlap. Null texts and texts of any length are taken as they are. Words and contexts are
    counted over all documents, and the decision on a run sees only the counts of its own terms, by a join.
    """
    kind = dict(documents.dtypes)[key]
    facts = written(scan(documents, key, text), "pii", by="kind")
    fixed = facts.where("kind = 'found'").select("doc", F.col("key").alias("pii_type"), "start", F.col("body").alias("surface"))
    words = written(facts.where("kind = 'word'").groupBy(F.col("key").alias("term")).agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "words")
    # lexicon words that the corpus mostly writes small are ordinary words
    lexicon = lexicon.where("token is not null and role is not null").groupBy(F.lower("token").alias("term")).agg(F.collect_set("role").alias("roles"))
    lexicon = written(lexicon.join(words.where("low > n"), "term", "left_anti"), "lexicon")
    every = facts.where("kind = 'run'").select("doc", "start", "body", "terms", "n")
    inner = F.split(F.lower("body"), "[^\\p{L}'’\ufffd-]+")
    halves = F.split(F.lower("body"), "[^\\p{L}'’\ufffd]+")
    roles: Roles = {}
    found = "array<struct<term:string,roles:array<string>>>"
    if lexicon.count() <= MAX_LEXICON:
        roles = {r["term"]: set(r["roles"]) for r in lexicon.toLocalIterator()}
        every = every.withColumn("known", F.lit(None).cast(found))
    else:  # too many words to send to every task: each run is joined with those it has
        asked = every.select("doc", "start", F.explode(F.array_distinct(F.concat(inner, halves))).alias("term")).where("term <> ''")
        own = asked.join(lexicon, "term").groupBy(F.col("doc").alias("of"), F.col("start").alias("at")).agg(F.collect_list(F.struct("term", "roles")).alias("known"))
        both = every.join(own, F.col("doc").eqNullSafe(F.col("of")) & (F.col("start") == F.col("at")), "left").drop("of", "at")
        every = written(both.withColumn("known", F.coalesce("known", F.array().cast(found))), "runs")
    told = written(disclosure(co_occurrence(every.where("n > 0"), roles), words).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("role", "share"))).alias("shares")), "told")
    runs = every.drop("n")
    shares: dict[str, dict[str, float]] = {}
    if told.count() <= MAX_TERMS:
        shares = {r["term"]: r["shares"] for r in told.toLocalIterator()}
        runs = runs.withColumn("told", F.lit(None).cast("array<struct<term:string,shares:map<string,double>>>"))
    else:  # too many terms to send to every task: each run is joined with those it has
        asked = runs.select("doc", "start", F.explode(F.array_distinct(F.concat("terms", inner, halves))).alias("term")).where("term <> ''")
        # a few terms per run; runs of documents with one key share what is told of theirs
        met = asked.join(told, "term").groupBy(F.col("doc").alias("of"), F.col("start").alias("at")).agg(F.collect_list(F.struct("term", "shares")).alias("told"))
        runs = runs.join(met, F.col("doc").eqNullSafe(F.col("of")) & (F.col("start") == F.col("at")), "left").drop("of", "at")
        runs = runs.withColumn("told", F.coalesce("told", F.array().cast(met.schema["told"].dataType)))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, start, body, terms, known, told_ in zip(*(pdf[c] for c in ("doc", "start", "body", "terms", "known", "told")), strict=True):
                mine = shares if told_ is None else {t["term"]: dict(t["shares"]) for t in told_}
                for a, b in names_in(body, list(terms), mine, _known(roles, known)):
                    rows.append((doc, "person_name", start + a, body[a:b]))
            yield pd.DataFrame(rows, columns=["doc", "pii_type", "start", "surface"])

    names = runs.mapInPandas(decide, "doc string, pii_type string, start int, surface string")
    return fixed.unionByName(numbers_told(facts)).unionByName(names).select(F.col("doc").cast(kind).alias(key), "pii_type", "start", "surface")


def redact(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``redacted``, ``pieces``: every document with what was ``found`` replaced by placeholders of its type.

    Documents are joined by key; rows that share a key are redacted by each other's findings only where the text agrees at the place.
    """
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    spans = found.groupBy(F.col(key).alias("__key")).agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("start", "surface", names[F.col("pii_type")].alias("to"))))).alias("spans")  # the pieces of one text
    )

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, found: list | None) -> str | None:
            if t is None or found is None:
                return t
            out, at = [], 0
            for s in found:
                a, b = s["start"], s["start"] + len(s["surface"])
                if a >= at and t[a:b] == s["surface"]:
                    out += [t[at:a], s["to"]]
                    at = b
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    joined = documents.select(F.col(key), F.col(text).alias("__text")).join(spans, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, replaced("__text", "spans").alias("redacted"), F.coalesce(F.size("spans"), F.lit(0)).alias("pieces"))
