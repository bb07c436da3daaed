"""What the queries must give, as SQL for another engine, written from the semantics of each pass.

The nineteen passes are stated one by one and chained for the queries of the pipeline. Constants are written out here, and look-alikes
and skeletons cover the letters of texts in use, not the whole table.
"""

from __future__ import annotations

import hashlib
import unicodedata

# Fixed values, written out here so that a wrong entry of the engine shows
_KEYWORDS = (
    "ignore", "disregard", "bypass", "system prompt", "instruction", "pwned", "whoami", "exec", "eval", "import", "os.system", "child_process", "shell", "bash",
    "powershell", "system", "prompt", "override", "jailbreak", "forget", "reset", "sudo", "admin", "root", "chmod", "curl", "wget", "python", "javascript", "script",
)
_BIGRAMS = (
    "TH", "HE", "IN", "ER", "AN", "RE", "ON", "EN", "AT", "ES", "ED", "IS", "IT", "AL", "AR", "ST", "TO", "NT", "NG", "SE", "HA", "AS", "OU", "IO", "LE", "VE",
    "CO", "ME", "DE", "HI", "ND", "TI", "OR", "TE", "OF", "RI", "RO", "IC", "NE", "EA", "RA", "CE", "LI", "CH", "LL", "BE", "MA", "SI", "OM", "UR", "CA", "EL",
    "TA", "LA", "NS", "DI", "FO", "HO", "PE", "EC", "PR", "NO", "CT", "US", "AC", "OT", "IL", "TR", "LY", "NC", "ET", "UT", "SS", "SO", "RS", "UN", "LO", "WA",
    "GE", "IE", "WH", "EE", "WI", "EM", "AD", "OL", "RT", "PO", "WE", "NA", "UL", "NI", "TS", "MO", "OW", "PA", "IM", "MI", "AI", "SH", "IR", "SU", "ID", "OS",
    "IV", "IA", "AM", "FI", "CI", "VI", "PL", "IG", "TU", "EV", "LD", "RY", "MP", "FE", "BL", "DA", "AY", "GH", "TY", "UP", "QU", "SC", "KE", "EX",
)
_LEET_FROM, _LEET_TO = "013456789@!$+|", "oieasgtbgaistl"
_INVISIBLE = r"[\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
_BIDI = r"[\x{202A}-\x{202E}\x{200B}-\x{200F}\x{FEFF}\x{2060}]"
_WEIGHTS = {
    "pre-scan-nfc": 0.35, "invisible-strip": 0.75, "cjk-superposition": 1.0, "bidi-control": 0.90, "fullwidth-chars": 0.65, "backslash-escape": 0.80,
    "unicode-escape": 0.80, "punycode": 0.85, "rot13": 0.80, "url-encoding": 0.80, "html-entities": 0.80, "base64": 0.85, "morse-code": 0.80, "homoglyph": 0.55,
    "script-intrusion": 0.40, "leetspeak": 0.30, "entropy-bigram": 0.50, "split-string": 0.70, "skeleton-match": 0.75,
}
_BASES = {
    "pre-scan-nfc": 0.30, "invisible-strip": 0.90, "cjk-superposition": 1.0, "bidi-control": 0.90, "fullwidth-chars": 0.80, "backslash-escape": 0.90,
    "unicode-escape": 0.90, "punycode": 1.0, "rot13": 1.0, "url-encoding": 1.0, "html-entities": 1.0, "base64": 1.0, "morse-code": 1.0, "homoglyph": 0.80,
    "script-intrusion": 0.65, "leetspeak": 0.55, "entropy-bigram": 0.50, "split-string": 0.65, "skeleton-match": 0.80,
}
_KEY = b"a key of the tests"

_K = "[" + ", ".join(f"'{k}'" for k in _KEYWORDS) + "]"
_LETTER_K = "[" + ", ".join(f"'{k}'" for k in _KEYWORDS if k.isalpha()) + "]"
_ANY = f"len(list_filter({_K}, lambda k: contains({{0}}, k))) > 0"
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HEXLIKE = r"(regexp_matches({0}, '[0-9]') and regexp_full_match({0}, '[0-9A-Fa-f-]+'))"


def _whole(new: str, fired: str) -> str:
    """A pass with at most one detection that replaces the text."""
    return f"""
        with b as (select sample_id, text, {new} as new from adversarial), f as (select *, coalesce({fired}, false) as fired from b)
        select sample_id, cast(case when fired then 1 else 0 end as bigint) as n_hits, fired, case when fired then new else text end as normalized from f"""


def _stay(hits: str) -> str:
    """A pass that leaves the text."""
    return f"select sample_id, cast(h as bigint) as n_hits, h > 0 as fired, text as normalized from (select sample_id, text, coalesce({hits}, 0) as h from adversarial)"


def _removed(pattern: str) -> str:
    return _whole(f"regexp_replace(text, '{pattern}', '', 'g')", "new <> text")


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "
_AZ = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NM = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"

_ROT = rf"""array_to_string(list_transform(regexp_extract_all(text, '[ \t\n\f\r]+|[^ \t\n\f\r]+'),
    lambda x: case when regexp_full_match(x, '[A-Za-z]{{4,}}') then translate(x, '{_AZ}', '{_NM}') else x end), '')"""

_URL_OK = f"length(x) >= 9 and x[1] = '%' and {_ANY.format('lower(try(url_decode(x)))')}"
_URL = rf"""
    with b as (select sample_id, text, regexp_extract_all(text, '(?:%[0-9A-Fa-f]{{2}})+|[^%]+|%') as xs from adversarial),
    f as (select sample_id, text, len(list_filter(xs, lambda x: {_URL_OK})) as h,
                 array_to_string(list_transform(xs, lambda x: case when {_URL_OK} then try(url_decode(x)) else x end), '') as new from b)
    select sample_id, cast(coalesce(h, 0) as bigint) as n_hits, coalesce(h, 0) > 0 as fired, case when h > 0 then new else text end as normalized from f"""

_URL_HITS = f"list_filter(regexp_extract_all(text, '(?:%[0-9A-Fa-f]{{2}})+'), lambda x: {_URL_OK})"
_REFERENCE = r"""case when x in ('&amp', '&amp;') then '&' when x in ('&lt', '&lt;') then '<' when x in ('&gt', '&gt;') then '>'
    when x in ('&quot', '&quot;') then '"' when x in ('&apos', '&apos;') then ''''
    when regexp_matches(x, '^&#[xX]') then chr(cast('0x' || regexp_extract(x, '[0-9A-Fa-f]+', 0) as integer))
    when regexp_matches(x, '^&#') then chr(cast(regexp_extract(x, '[0-9]+', 0) as integer)) end"""
_HTML = rf"""
    with b as (select sample_id, text, list_transform(
        regexp_extract_all(text, '&(?:amp;?|lt;?|gt;?|quot;?|apos;?)|&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|[^&]+|&'),
        lambda x: {{'a': x, 'b': {_REFERENCE}}}) as xs from adversarial),
    f as (select sample_id, text, array_to_string(list_transform(xs, lambda x: coalesce(x.b, x.a)), '') as new, len(list_filter(xs, lambda x: x.b is not null)) as n from b),
    g as (select *, coalesce(n >= 4 and {_ANY.format("lower(new)")}, false) as fired from f)
    select sample_id, cast(case when fired then 1 else 0 end as bigint) as n_hits, fired, case when fired then new else text end as normalized from g"""

_ESCAPE = r"""case when regexp_matches(x, '^\\[xu]') then chr(cast('0x' || regexp_extract(x, '^\\[xu]\{?([0-9A-Fa-f]+)', 1) as integer))
    when regexp_matches(x, '^\\[0-7]') then chr(cast(list_reduce(list_transform(string_split(substr(x, 2), ''), lambda c: cast(c as integer)), lambda p, q: p * 8 + q) as integer)) end"""
_UNICODE = rf"""
    with b as (select sample_id, text, list_transform(
        regexp_extract_all(text, '\\x[0-7][0-9A-Fa-f]|\\u\{{[0-9A-Fa-f]{{1,6}}\}}|\\u[0-9A-Fa-f]{{4}}|\\[0-3][0-7]{{2}}|\\[0-7]{{1,2}}|[^\\]+|\\'),
        lambda x: {{'a': x, 'b': {_ESCAPE}}}) as xs from adversarial),
    f as (select sample_id, text, array_to_string(list_transform(xs, lambda x: coalesce(x.b, x.a)), '') as new,
                 len(list_filter(xs, lambda x: x.b is not null and not regexp_full_match(x.a, '\\[0-7]'))) as n from b),
    g as (select *, coalesce((n >= 1 and {_ANY.format("lower(new)")}) or n >= 4, false) as fired from f)
    select sample_id, cast(case when fired then 1 else 0 end as bigint) as n_hits, fired, case when fired then new else text end as normalized from g"""

_LEET_WORD = rf"""not {_HEXLIKE.format("w")} and len(regexp_extract_all(w, '[\p{{L}}\p{{N}}]')) >= 4 and len(regexp_extract_all(w, '[A-Za-z]')) >= 2
    and len(regexp_extract_all(w, '[013456789@!$+|]')) * 100 // greatest(len(regexp_extract_all(w, '[\p{{L}}\p{{N}}]')), 1) >= 35"""
_LEET = rf"""
    with b as (select sample_id, text, regexp_extract_all(text, '{_WS.replace("[", "[^", 1)}+') as ws from adversarial),
    f as (select sample_id, text, coalesce(len(list_filter(ws, lambda w: {_LEET_WORD})) > 0, false) as fired,
                 array_to_string(list_transform(ws, lambda w: case when {_LEET_WORD} then translate(w, '{_LEET_FROM}', '{_LEET_TO}') else w end), ' ') as new from b)
    select sample_id, cast(case when fired then 1 else 0 end as bigint) as n_hits, fired, case when fired then new else text end as normalized from f"""

_INTRUSION = rf"""case when len(list_filter(regexp_extract_all(text, '{_WS.replace("[", "[^", 1)}+'),
    lambda w: length(w) >= 3 and len(regexp_extract_all(w, '[A-Za-z0-9]')) >= 2 and regexp_matches(w, '[^\x00-\x7f\x{{c0}}-\x{{24f}}]'))) > 0 then 1 else 0 end"""

_SPLIT = f"""case when octet_length(encode(text)) < 8 then 0 else len(list_filter({_LETTER_K},
    lambda k: contains(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), k) and not contains(lower(text), k))) end"""

_PAIRS = "[" + ", ".join(f"'{b}'" for b in _BIGRAMS) + "]"
_CJK = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{3000}-\x{303F}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
    r"\x{FF65}-\x{FF9F}\x{FFA0}-\x{FFBE}]"
)
_ENTROPY_OF = """(select -sum(n * 1.0 / length(w) * log2(n * 1.0 / length(w))) from (select count(*) as n from (select unnest(string_split(w, '')) as c) group by c))"""
_ENTROPY = rf"""
    with t as (select sample_id, text, unnest(regexp_extract_all(text, '{_WS.replace("[", "[^", 1)}+')) as w from adversarial
               where length(text) >= 12 and len(regexp_extract_all(text, '{_CJK}')) * 1.0 / length(text) <= 0.6),
    k as (select * from t where length(w) >= 8 and not {_HEXLIKE.format("w")} and not regexp_matches(w, '[$(){{}}:\\/]')),
    bad as (select distinct sample_id from k where
              (len(regexp_extract_all(w, '\p{{L}}')) >= 6 and len(list_filter(range(1, length(w)), lambda i: list_contains({_PAIRS}, substr(upper(w), i, 2)))) * 1.0 / (length(w) - 1) < 0.15)
              or (length(w) >= 37 and {_ENTROPY_OF} > 5.2))
    select a.sample_id, cast(case when bad.sample_id is null then 0 else 1 end as bigint) as n_hits, bad.sample_id is not null as fired, text as normalized
    from adversarial a left join bad on a.sample_id = bad.sample_id"""

_ZONE = """case when unicode(c) < 128 or unicode(c) between 65281 and 65374 then 0 when unicode(c) between 1024 and 1327 then 1
    when unicode(c) between 880 and 1023 then 2 when regexp_matches(c, '{cjk}') then 3 else 4 end""".replace("{cjk}", _CJK)
_CJK_HALT = f"""
    with g as (select sample_id, text from adversarial where length(text) >= 12 and len(regexp_extract_all(text, '{_CJK}')) * 1.0 / length(text) >= 0.4),
    z as (select sample_id, list_transform(string_split(text, ''), lambda c: {_ZONE}) as zs from g),
    p as (select sample_id, list_transform(range(1, len(zs) + 1), lambda i: zs[i] * 5 + zs[len(zs) + 1 - i]) as ks from z),
    w as (select sample_id, i, unnest(list_slice(ks, i, i + 5)) as k from (select sample_id, ks, unnest(range(1, len(ks) - 4)) as i from p)),
    e as (select sample_id, i, -sum(n / 6.0 * ln(n / 6.0)) as h from (select sample_id, i, k, count(*) as n from w group by 1, 2, 3) group by 1, 2),
    hot as (select distinct sample_id from e where h > 0.55)
    select a.sample_id, cast(case when hot.sample_id is null then 0 else 1 end as bigint) as n_hits, hot.sample_id is not null as fired,
           case when hot.sample_id is null then text else '' end as normalized
    from adversarial a left join hot on a.sample_id = hot.sample_id"""

_SCRIPT = """case when unicode(c) < 128 then 0 when unicode(c) between 1024 and 1327 then 1 when unicode(c) between 880 and 1023 or unicode(c) between 7936 and 8191 then 2
    when unicode(c) between 19968 and 40959 or unicode(c) between 12352 and 12543 then 3 else 4 end"""
_INTERFERENCE = f"""
    with z as (select doc_id, text, list_transform(string_split(text, ''), lambda c: {_SCRIPT}) as zs from documents)
    select doc_id, case when text is null or text = '' then 0.0 else
        round(cast(cast(len(list_filter(list_zip(zs, list_reverse(zs)), lambda x: x[1] <> x[2])) as float) / cast(len(zs) as float) as double), 4) end as interference from z"""


# runs of a character with a backslash each: two or more, or one before a backslash that escapes the end of a line
_UNIT = r"\\[\x00-\x09\x0b\x0c\x0e-\x7f]"
_IN_RUN = rf"(regexp_full_match(x, '(?s)({_UNIT})+') and length(x) >= 4)"
_BEFORE_END = rf"regexp_full_match(x, '(?s){_UNIT}\\[\r\n]')"
_BACKSLASH = rf"""
    with b as (select sample_id, text, regexp_extract_all(text, '(?s)(?:{_UNIT}){{2,}}|{_UNIT}\\[\r\n]|[^\\]+|\\') as xs from adversarial),
    f as (select sample_id, text,
                 array_to_string(list_transform(xs, lambda x: case when {_IN_RUN} then regexp_replace(x, '(?s)\\(.)', '\1', 'g') when {_BEFORE_END} then substr(x, 2) else x end), '') as new,
                 coalesce(list_sum(list_transform(xs, lambda x: case when {_IN_RUN} then length(x) // 2 when {_BEFORE_END} then 1 else 0 end)), 0) as n from b)
    select sample_id, cast(case when n >= 3 then 1 else 0 end as bigint) as n_hits, n >= 3 as fired, case when n >= 3 then new else text end as normalized from f"""

# a call with a payload between quotes; what it decodes to takes the place of all but its closing bracket
_CALL = r"(?:b64\.decode|base64\.decode|atob|b64decode|base64decode)\("
_TRIMMED = r"regexp_replace(w, '^[^\p{L}\p{N}+/=]+|[^\p{L}\p{N}+/=]+$', '', 'g')"


def _strict(p: str) -> str:
    """What strict base64 of printable signs, with or without padding, stands for; else null."""
    bare = f"regexp_replace({p}, '=+$', '')"
    padded = f"({bare} || repeat('=', (4 - length({bare}) % 4) % 4))"
    right = f"regexp_full_match({p}, '[A-Za-z0-9+/=]*') and length({bare}) % 4 <> 1 and to_base64(try(from_base64({padded}))) = {padded}"
    shown = f"try(decode(from_base64({padded})))"
    return f"case when {right} then case when regexp_full_match({shown}, '[\\x20-\\x7e\\n]*') then {shown} end end"


_QUOTED = f"regexp_extract(x, '^{_CALL}\"([^\"]*)\"', 1)"
_BASE64_CALLS = rf"""
    select sample_id, text, list_transform(regexp_extract_all(text, '{_CALL}"[^"]*"|[^ab]+|.'), lambda x: {{'x': x, 'raw': case when regexp_matches(x, '^{_CALL}"') then {_strict(_QUOTED)} end}}) as xs
    from adversarial where text is not null"""
_BASE64_WORDS = rf"""
    with c as ({_BASE64_CALLS}),
    d as (select sample_id, array_to_string(list_transform(xs, lambda y: coalesce(y.raw, y.x)), '') as text, len(list_filter(xs, lambda y: y.raw is not null)) as calls from c),
    b as (select sample_id, calls, unnest(regexp_extract_all(text, '{_WS}+|{_WS.replace("[", "[^", 1)}+')) as w, generate_subscripts(regexp_extract_all(text, '{_WS}+|{_WS.replace("[", "[^", 1)}+'), 1) as i from d),
    p as (select *, {_TRIMMED} as p from b), s as (select *, case when octet_length(encode(p)) >= 12 then {_strict("p")} end as raw from p)
    select *, case when length(raw) >= 8 and {_ANY.format("lower(raw)")} then raw end as shown from s"""
_BASE64 = f"""
    with k as ({_BASE64_WORDS}),
    f as (select sample_id, any_value(calls) + count(shown) as n, string_agg(case when shown is null then w else replace(w, p, shown) end, '' order by i) as new from k group by 1)
    select a.sample_id, coalesce(n, 0) as n_hits, coalesce(n, 0) > 0 as fired, case when n > 0 then new else text end as normalized from adversarial a left join f using (sample_id)"""


_MIXED = f"""
    select sample_id, coalesce(cast(len(list_filter(list_zip(zs, list_reverse(zs)), lambda x: x[1] <> x[2])) as double) / nullif(len(zs), 0), 0) as ratio
    from (select sample_id, list_transform(string_split(text, ''), lambda c: {_SCRIPT}) as zs from adversarial where text <> '')"""
_LEET_RATIO = rf"""
    select sample_id, case when len(ws) > 0 then least(1.0, list_sum(list_transform(ws, lambda w: len(regexp_extract_all(w, '[013456789@!$+|]')))) * 1.0
                               / list_sum(list_transform(ws, lambda w: len(regexp_extract_all(w, '[\p{{L}}\p{{N}}]'))))) else 0 end as ratio
    from (select sample_id, list_filter(regexp_extract_all(text, '{_WS.replace("[", "[^", 1)}+'), lambda w: {_LEET_WORD}) as ws from adversarial)"""


def _steps(steps: list[tuple[str, str]], table: str, key: str) -> tuple[list[str], dict[str, int]]:
    """Passes one after the other, each on what the one before left; a foreign letter counts only where no look-alike was replaced."""
    at = {kind: k for k, (kind, _) in enumerate(steps)}
    parts = [f"s0 as (select {key} as sample_id, text from {table})"]
    for k, (kind, sql) in enumerate(steps):
        made = sql.replace("adversarial", f"s{k}")
        if kind == "script-intrusion":
            made = f"select i.sample_id, case when h.fired then 0 else i.n_hits end as n_hits, i.fired and not h.fired as fired, i.normalized from ({made}) i join p{at['homoglyph']} h using (sample_id)"
        parts += [f"p{k} as materialized ({made})", f"s{k + 1} as (select sample_id, normalized as text from p{k})"]
    return parts, at


def _each_hit(steps: list[tuple[str, str]], table: str, key: str) -> str:
    """Every detection of the passes with its number within the text."""
    parts, at = _steps(steps, table, key)
    found = []
    for kind, k in at.items():
        start = f"select sample_id, {k} as step, '{kind}' as kind, "
        if kind == "url-encoding":
            found.append(f"{start} j, x as original, url_decode(x) as normalized from (select sample_id, unnest(xs) as x, generate_subscripts(xs, 1) as j from (select sample_id, {_URL_HITS} as xs from s{k}))")
        elif kind == "base64":
            found.append(f"{start} j, y.x as original, y.raw as normalized from (select sample_id, unnest(xs) as y, generate_subscripts(xs, 1) as j from ({_BASE64_CALLS.replace('adversarial', f's{k}')})) where y.raw is not null")
            found.append(f"{start} 1000000 + i as j, p as original, shown as normalized from ({_BASE64_WORDS.replace('adversarial', f's{k}')}) where shown is not null")
        elif kind == "morse-code":
            found.append(f"{start} i as j, substr(x, a) as original, shown as normalized from ({_MORSE_RUNS.replace('adversarial', f's{k}')}) where shown is not null")
        else:
            found.append(f"{start} unnest(range(p.n_hits)) as j, s.text as original, p.normalized from s{k} s join p{k} p using (sample_id) where p.fired")
    return f"""with {", ".join(parts)} select sample_id, cast(row_number() over (partition by sample_id order by step, j) - 1 as integer) as ord, kind, original, normalized
        from ({" union all ".join(found)})"""


def _chained(steps: list[tuple[str, str]], table: str, key: str) -> str:
    """What the passes leave of each text, and the decision."""
    parts, at = _steps(steps, table, key)
    parts += [f"mixed as ({_MIXED.replace('adversarial', f's{at['homoglyph']}')})", f"leet as ({_LEET_RATIO.replace('adversarial', f's{at['leetspeak']}')})"]
    last = len(steps) - 1
    # in single precision, in the order of the passes
    total = "cast(0 as real)"
    for kind, k in at.items():
        total = f"({total} + cast({_WEIGHTS[kind]} as real) * cast(p{k}.n_hits as real))"
    for extra, weight in (("mixed", 0.6), ("leet", 0.4)):
        total = f"({total} + cast(coalesce({extra}.ratio, 0) as real) * cast({weight} as real))"
    kinds = "concat_ws(', ', " + ", ".join(f"case when p{k}.fired then '{kind}' end" for kind, k in at.items()) + ")"
    joins = " ".join(f"join p{k} using (sample_id)" for k in range(len(steps))) + " left join mixed using (sample_id) left join leet using (sample_id)"
    halted = f"p{at['cjk-superposition']}.fired"
    return f"""with {", ".join(parts)},
        j as (select a.sample_id, a.text, p{last}.normalized as normalized, {halted} as halt, least(1.0, cast(case when {halted} then 1 else {total} end as double)) as raw, {kinds} as kinds from s0 a {joins})
        select sample_id, text, normalized, kinds, case when text is not null then round(raw, 4) end as score, case when text is not null then raw >= 0.25 end as should_flag,
               case when text is not null then raw >= cast(cast(0.6 as real) as double) end as should_block, case when text is not null then halt end as halted,
               case when text is null then null when raw >= cast(cast(0.6 as real) as double) then 'BLOCK' when raw >= 0.25 then 'FLAG' else 'pass' end as label,
               case when text is null then null when kinds = '' then 'clean' else printf('score=%.2f  detections=[%s]', floor(raw * 100 + 0.5) / 100, kinds) end as summary from j"""


_CASES = "case kind " + " ".join(f"when '{k}' then {w}" for k, w in _WEIGHTS.items()) + " else 0 end"
_SCORED = f"""
    with f as (select sample_id, kind, min(ord) as o, sum({_CASES}) as w, min((ord, detection_id)) as place from detection where kind is not null group by 1, 2),
    g as (select sample_id, least(1.0, round(cast(sum(w) as double), 4)) as score, string_agg(kind, ', ' order by place) as kinds from f group by 1)
    select sample_id, cast(score as double) as score, score >= 0.25 as should_flag, score >= 0.6 as should_block,
           case when score >= 0.6 then 'BLOCK' when score >= 0.25 then 'FLAG' else 'pass' end as label, printf('score=%.2f  detections=[%s]', score, kinds) as summary from g"""
_CONFIDENT = f"""least(1.0, cast(case kind {" ".join(f"when '{k}' then {w}" for k, w in _BASES.items())} end as double)
        + case when length(original) > 0 then 0.2 * least(1.0, abs(length(original) - length(normalized)) * 1.0 / length(original)) else 0 end)"""
_CONFIDENCE = f"""
    select detection_id, round({_CONFIDENT}, 4) as confidence
    from detection where kind in ({", ".join(f"'{k}'" for k in _BASES)})"""
_RESULTS = """(select r.*, lower(trim(category, ' ')) as category, score >= flag_threshold as f, score >= block_threshold as b
    from normalization_result r left join adversarial using (sample_id))"""


def _js(x: str) -> str:
    return f"coalesce(cast(to_json({x}) as varchar), 'null')"


def _number(x: str) -> str:
    return f"case when {x} is null then 'null' when isnan({x}) then '\"NaN\"' else cast({x} as varchar) end"


_DETECTION = f"""'{{{{"pass":' || {_js("x.pass")} || ',"original_len":' || {_js("x.original_len")} || ',"normalized_len":' || {_js("x.normalized_len")}
    || ',"detail":' || {_js("x.detail")} || ',"confidence":' || {_number("x.confidence")} || '}}}}'""".replace("{{", "{").replace("}}", "}")
_HEAD = f"""'{{"input_hash":' || {_js("input_hash")} || ',"input_len":' || {_js("input_len")} || ',"timestamp":' || {_js('"timestamp"')} || ',"obfuscation_score":' || {_number("obfuscation_score")}
    || ',"halted":' || {_js("halted")} || ',"blocked":' || {_js("blocked")}
    || ',"passes_fired":' || case when passes_fired is null then 'null' else '[' || array_to_string(list_transform(passes_fired, lambda x: {_js("x")}), ',') || ']' end
    || ',"detections":' || case when detections is null then 'null' else '[' || array_to_string(list_transform(detections, lambda x: {_DETECTION}), ',') || ']' end"""


def _hmac(message: str, key: bytes = _KEY) -> str:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in key) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode({message}))))"


_MESSAGE = f"""{_HEAD} || ',"prev_hmac":' || {_js("prev_hmac")} || ',"signature":null}}'"""
_SIGNED = f"""
    with h as (select record_id, {_HEAD} || ',"prev_hmac":' || {_js("prev_hmac")} || ',"signature":' as head from audit_record)
    select record_id, head || '"' || {_hmac("head || 'null}'")} || '"}}' as line from h"""
_CHAIN = f"""
    with recursive r as (select app_id, record_id, {_HEAD} as head, row_number() over (partition by app_id order by record_id) as n from audit_record),
    c as (select app_id, record_id, n, cast(null as varchar) as prev_hmac, {_hmac("""head || ',"prev_hmac":null,"signature":null}'""")} as signature from r where n = 1
          union all
          select r.app_id, r.record_id, r.n, c.signature, {_hmac("""r.head || ',"prev_hmac":"' || c.signature || '","signature":null}'""")}
          from c join r on r.app_id is not distinct from c.app_id and r.n = c.n + 1)
    select record_id, prev_hmac, signature from c"""


#: Look-alikes by script, as they are seen in texts; further ones follow from a rule below.
_ALIKE = (
    ("ЅІЈАВЕЗКМНОРСТУХЬабгеорсухшѕіјѡѴѵҮүһҽӀӏӠԁԌԛԜԝ", "SlJABE3KMHOPCTYXba6reopcyxwsijwVvYyhell3dGqWw"),
    ("\u0374\u037a\u037eͿ΄ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορσυϒϜϨϬϭϱϲϳϸϹϺ", "'i;J'ABEZHlKMNOPTYXayivopouYF26opcjpCM"),
    ("ՍՏՕ՚՝ագզհոռսցւքօ։", "USO''wqqhnnugifo:"),
    ("׀׃וטיןס׳", "l:lv'lo'"),
    ("؍اه٫٭ھہ۔ە", ",lo,*oo-o"),
    ("´¸×þıſƄƍƒƖƦƧƷƼƽƿǀǃȜȢȣɁɑɡɣɩɪɯʋʏʔʹʻʼʽʾ˂˃˄ˆˈˊˋː˗˛˜˴˸", "',xpifbgflR235spl!388?agyiiwuy?'''''<>^^''':-i~':"),
    ("‐‑‒–‘’‚‛․′‵‹›⁁⁃⁄⁎⁓⁚−∕∗∣∨∪∶∼℮", "----'','.''<>/-/*~:-/*lvU:~e"),
)


def _alike() -> dict[str, str]:
    """Characters that look like one of ASCII: the table, mathematical and letter-like forms of what it and ASCII have, digits, enclosed letters."""
    table = {a: b for foreign, to in _ALIKE for a, b in zip(foreign, to, strict=True)}
    seen = {"I": "l", "0": "O", "1": "l"}  # a form is taken for the letter that its plain form is taken for
    for cp in (*range(0x2100, 0x2190), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(cp))
        to = plain if plain.isascii() else table.get(plain, "")
        if len(plain) == 1 and to.isalnum() and to != "m" and chr(cp) not in table:
            table[chr(cp)] = seen.get(to, to)
    table |= {chr(first + d): str(d) for first in (0x660, 0x6F0) for d in range(10)} | {chr(0x2460 + d): str(d + 1) for d in range(9)}
    return table | {chr(0x24B6 + n): chr(65 + n) for n in range(26)} | {chr(0x24D0 + n): chr(97 + n) for n in range(26)}


_TABLE = _alike()
_SEEN = f"translate(text, '{''.join(_TABLE)}', '{''.join(_TABLE.values()).replace(chr(39), chr(39) * 2)}')"
_TOKENS = f"'{_WS}+|{_WS.replace('[', '[^', 1)}+'"
_PICKED = r"case when x[1] <> x[2] and (regexp_matches(x[1], '[A-Za-z0-9]') or (regexp_full_match(x[2], '[\x00-\x7f]+') and regexp_full_match(x[1], '[^\x00-\x7f]+'))) then x[2] else x[1] end"
_HOMOGLYPH = _whole(f"array_to_string(list_transform(list_zip(regexp_extract_all(text, {_TOKENS}), regexp_extract_all({_SEEN}, {_TOKENS})), lambda x: {_PICKED}), '')", "new <> text")


#: What signs of ASCII look like, in lower case, and what further letters of texts do; full-width letters that look like their plain ones.
_SKELETON = {
    '"': "''", "%": "º/₀", "0": "O", "1": "l", "`": "'", "m": "rn", "|": "l", "¢": "c\u0338", "€": "Ꞓ", "…": "...", "æ": "ae", "œ": "oe", "ø": "o\u0338", "ð": "\u2202\u0335",
    "\u0327": "\u0326", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "β": "ß", "δ": "ẟ", "ε": "ꞓ", "η": "n\u0329", "κ": "ĸ", "τ": "ᴛ", "в": "ʙ", "з": "ɜ", "и": "ᴎ", "к": "ĸ", "м": "ʍ",
    "н": "ʜ", "п": "π", "т": "ᴛ", "ф": "ɸ", "ъ": "ˉb", "ы": "ƅi", "ь": "ƅ", "я": "ᴙ", "є": "ꞓ", "ґ": "r'", "＂": "''", "－": "ー", "＼": "\\",
}
_WIDE_SAME = "ａｃｅｇｈｉｊｌｏｐｓｖｘｙ"
_BLANK = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
_NOTHING = "\u00ad\u200b\u200c\u200d\u202e\u2060\ufe0f\ufeff\U000e006b\U000e006f"


def _map(table: dict[str, str]) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return "map([" + ", ".join(map(text, table)) + "], [" + ", ".join(map(text, table.values())) + "])"


def _bare(x: str) -> str:
    """A text in lower case as what it looks like, decomposed."""
    apart = {chr(c): d for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c)}
    looks = {a: b for a, b in _TABLE.items() if a not in "шӏӀ" and not unicodedata.category(a).startswith("N")} | {c: unicodedata.normalize("NFKC", c) for c in _WIDE_SAME}
    looks |= {c: "rn" for c in map(chr, range(0x1D400, 0x1D800)) if unicodedata.normalize("NFKC", c) == "m"} | dict.fromkeys(_NOTHING, "") | dict.fromkeys(_BLANK, " ") | _SKELETON
    one = lambda y, table: f"array_to_string(list_transform(string_split({y}, ''), lambda c: coalesce({_map(table)}[c], c)), '')"
    return one(one(f"lower({x})", apart), looks)


_SKELETONS = f"""
    with b as (select sample_id, text, case when regexp_matches(text, '[^\\x00-\\x7f]') then {_bare("text")} end as bare from adversarial),
    f as (select *, coalesce(len(list_filter({_K}, lambda k: contains(bare, k) and not contains(lower(text), k))) > 0, false) as fired from b)
    select sample_id, cast(case when fired then 1 else 0 end as bigint) as n_hits, fired, case when fired then bare else text end as normalized from f"""

_MORSE = {
    ".-": "A", "-...": "B", "-.-.": "C", "-..": "D", ".": "E", "..-.": "F", "--.": "G", "....": "H", "..": "I", ".---": "J", "-.-": "K", ".-..": "L", "--": "M", "-.": "N",
    "---": "O", ".--.": "P", "--.-": "Q", ".-.": "R", "...": "S", "-": "T", "..-": "U", "...-": "V", ".--": "W", "-..-": "X", "-.--": "Y", "--..": "Z", "-----": "0", ".----": "1",
    "..---": "2", "...--": "3", "....-": "4", ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9", "-..-.": "/", ".-.-.-": ".", "..--..": "?", "--..--": ",",
    ".-..-": "/",
}
_SIGNS = "list_filter(string_split(replace(y, ' / ', ' | '), ' '), lambda z: z <> '' and z <> '|')"
_SPELT = f"array_to_string(list_transform(list_filter(string_split(replace(y, ' / ', ' | '), ' '), lambda z: z <> ''), lambda z: case when z = '|' then ' ' else coalesce({_map(_MORSE)}[z], '?') end), '')"
# a run of signs, or what follows in it, is replaced from the first place on that can be read
_READ = f"""case when length(p) >= 10 and regexp_matches(p, '^[./ -]') and length(y) * 100 // length(p) >= 60 and len({_SIGNS}) > 0
    and len(list_filter({_SIGNS}, lambda z: {_map(_MORSE)}[z] is not null)) * 100 // len({_SIGNS}) >= 40 and length(trim(trim({_SPELT}, '?'), ' ')) >= 2 then {_SPELT} end"""
_MORSE_RUNS = rf"""
    with b as (select sample_id, text, regexp_extract_all(text, '[./ -][./ ,;:!-]*|[^./ -]+') as xs from adversarial where text is not null),
    t as (select sample_id, unnest(xs) as x, generate_subscripts(xs, 1) as i from b),
    k as (select sample_id, i, x, unnest(case when regexp_matches(x, '^[./ -]') and length(x) >= 10 then range(1, length(x) - 8) else [0] end) as a from t),
    p as (select *, substr(x, a) as p, regexp_replace(substr(x, a), '[,;:!]+', '', 'g') as y from k), r as (select *, case when a > 0 then {_READ} end as shown from p)
    select sample_id, i, any_value(x) as x, min(a) filter (shown is not null) as a, arg_min(shown, a) filter (shown is not null) as shown from r group by 1, 2"""
_MORSES = f"""
    with f as (select sample_id, count(shown) as n, string_agg(case when shown is null then x else left(x, a - 1) || shown end, '' order by i) as new from ({_MORSE_RUNS}) group by 1)
    select s.sample_id, coalesce(n, 0) as n_hits, coalesce(n, 0) > 0 as fired, case when n > 0 then new else text end as normalized from adversarial s left join f using (sample_id)"""

# one digit of a label after the other: the state is the text so far, the number and place of the next letter, and the weights of the digits
_DIGIT = "case when c between 'a' and 'z' then unicode(c) - 97 when c between '0' and '9' then unicode(c) - 22 else 99 end"
_EDGE = "least(26, greatest(1, s.k - s.bias))"
_SIZE = "(length(s.out) + 1)"
_DELTA = f"((s.i + d * s.w - s.old) // (case when s.old = 0 and s.n = 128 and s.first then 700 else 2 end))"
_GROWN = f"({_DELTA} + {_DELTA} // {_SIZE})"
_LESS = f"(case when {_GROWN} > 455 * 35 * 35 then 3 when {_GROWN} > 455 * 35 then 2 when {_GROWN} > 455 then 1 else 0 end)"
_REST = f"({_GROWN} // (case {_LESS} when 3 then 42875 when 2 then 1225 when 1 then 35 else 1 end))"
_STEP = f"""case when s.bad or d > 35 then {{'out': s.out, 'n': s.n, 'i': s.i, 'bias': s.bias, 'old': s.old, 'w': s.w, 'k': s.k, 'first': s.first, 'open': s.open, 'bad': true}}
    when d < {_EDGE} then {{'out': left(s.out, (s.i + d * s.w) % {_SIZE}) || chr(cast(s.n + (s.i + d * s.w) // {_SIZE} as integer)) || substr(s.out, (s.i + d * s.w) % {_SIZE} + 1),
        'n': s.n + (s.i + d * s.w) // {_SIZE}, 'i': (s.i + d * s.w) % {_SIZE} + 1, 'bias': 36 * {_LESS} + 36 * {_REST} // ({_REST} + 38), 'old': (s.i + d * s.w) % {_SIZE} + 1,
        'w': cast(1 as bigint), 'k': cast(36 as bigint), 'first': false, 'open': false, 'bad': false}}
    else {{'out': s.out, 'n': s.n, 'i': s.i + d * s.w, 'bias': s.bias, 'old': s.old, 'w': s.w * (36 - {_EDGE}), 'k': s.k + 36, 'first': s.first, 'open': true, 'bad': false}} end"""
_PUNYCODE = rf"""
    with recursive t as (select sample_id, unnest(regexp_extract_all(text, '[ \t\n\f\r]+|[^ \t\n\f\r]+')) as x, generate_subscripts(regexp_extract_all(text, '[ \t\n\f\r]+|[^ \t\n\f\r]+'), 1) as nr
                         from adversarial where regexp_matches(text, '(?i)xn--')),
    l as (select *, lower(substr(x, 5)) as label from t where regexp_full_match(x, '(?i)xn--[a-z0-9-]*')),
    z as (select sample_id, nr, case when contains(label, '-') then regexp_extract(label, '-([^-]*)$', 1) else label end as tail, 1 as pos,
                 {{'out': case when contains(label, '-') then regexp_extract(label, '^(.*)-[^-]*$', 1) else '' end, 'n': cast(128 as bigint), 'i': cast(0 as bigint), 'bias': cast(72 as bigint),
                   'old': cast(0 as bigint), 'w': cast(1 as bigint), 'k': cast(36 as bigint), 'first': true, 'open': false, 'bad': false}} as s from l
          union all
          select sample_id, nr, tail, pos + 1, {_STEP} from (select *, substr(tail, pos, 1) as c, {_DIGIT.replace("c ", "substr(tail, pos, 1) ").replace("(c)", "(substr(tail, pos, 1))")} as d from z where pos <= length(tail))),
    r as (select sample_id, nr, translate(s.out, '{"".join(_TABLE)}', '{"".join(_TABLE.values()).replace(chr(39), chr(39) * 2)}') as shown from z where pos = length(tail) + 1 and not s.bad and not s.open),
    f as (select t.sample_id, count(*) filter ({_ANY.format("lower(shown)")}) as n, string_agg(case when {_ANY.format("lower(shown)")} then shown else x end, '' order by nr) as new
          from t left join r using (sample_id, nr) group by 1)
    select a.sample_id, cast(case when n > 0 then 1 else 0 end as bigint) as n_hits, coalesce(n, 0) > 0 as fired, case when n > 0 then new else text end as normalized from adversarial a left join f using (sample_id)"""


def _passes() -> dict[str, tuple[str, str]]:
    """Query, pass and SQL of the passes that SQL can state."""
    return {
        "nfc_fold": ("pre-scan-nfc", _whole("nfc_normalize(text)", "new <> text")),
        "invisible_strip": ("invisible-strip", _removed(_INVISIBLE)),
        "cjk_halt": ("cjk-superposition", _CJK_HALT),
        "bidi_strip": ("bidi-control", _removed(_BIDI)),
        "fullwidth_fold": ("fullwidth-chars", _whole(f"translate(text, '{_FULL}', '{_PLAIN}')", "new <> text")),
        "backslash_unescape": ("backslash-escape", _BACKSLASH),
        "unicode_unescape": ("unicode-escape", _UNICODE),
        "punycode_decode": ("punycode", _PUNYCODE),
        "rot13_decode": ("rot13", _whole(_ROT, f"len(list_filter({_K}, lambda k: contains(lower(new), k) and not contains(lower(text), k))) > 0")),
        "url_decode": ("url-encoding", _URL),
        "html_decode": ("html-entities", _HTML),
        "base64_decode": ("base64", _BASE64),
        "morse_decode": ("morse-code", _MORSES),
        "homoglyph_fold": ("homoglyph", _HOMOGLYPH),
        "script_intrusion": ("script-intrusion", _stay(_INTRUSION)),
        "leet_fold": ("leetspeak", _LEET),
        "entropy_bigram": ("entropy-bigram", _ENTROPY),
        "split_keyword": ("split-string", _stay(_SPLIT)),
        "skeleton_match": ("skeleton-match", _SKELETONS),
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    passes = _passes()
    detections = _each_hit(list(passes.values()), "adversarial", "sample_id")
    attacks, harmless = (_chained(list(passes.values()), t, "sample_id") for t in ("adversarial", "benign"))
    return {
        **{name: sql for name, (_, sql) in passes.items()},
        "script_interference": _INTERFERENCE,
        "score_decision": f"select sample_id, score, should_flag, should_block, halted, label, summary from ({attacks})",
        "detection_explode": detections,
        "confidence": f"""select kind, count(*) as n, round(min(c), 4) as least, round(max(c), 4) as most from (
            select kind, {_CONFIDENT} as c from ({detections})) group by 1""",
        "left_texts": f"select sample_id, normalized, case when text is not null then kinds end as kinds from ({attacks})",
        "benign_decision": f"select sample_id, score, should_flag, should_block, label from ({harmless})",
        "documents_scan": f"select sample_id as doc_id, score, should_flag, should_block, halted from ({_chained(list(passes.values()), 'documents', 'doc_id')})",
        "corpus_eval": f"""select lower(trim(category, ' ')) as category, count(*) as n, count(*) filter (should_flag) as flagged, count(*) filter (should_block) as blocked
            from adversarial join ({attacks}) using (sample_id) group by 1""",
        "corpus_rates": f"""select corpus, n, flagged, blocked, round(flagged / n, 6) as flag_rate, round(blocked / n, 6) as block_rate from (
            select corpus, count(*) as n, count(*) filter (should_flag) as flagged, count(*) filter (should_block) as blocked
            from (select 'adversarial' as corpus, * from ({attacks}) union all select 'benign', * from ({harmless})) group by 1)""",
        "corpus_missed": f"""
            select 'adversarial' as corpus, sample_id, category, score, a.text from adversarial a join ({attacks}) r using (sample_id) where not should_flag
            union all select 'benign', sample_id, category, score, b.text from benign b join ({harmless}) r using (sample_id) where should_flag""",
        "detections_scored": _SCORED,
        "detection_confidence": _CONFIDENCE,
        "detail_truncated": """select detection_id, case when octet_length(encode(original)) <= 200 then original
            else left(original, list_max(list_filter(range(50, 201), lambda n: octet_length(encode(left(original, n))) <= 200))) || '...' end as detail from detection""",
        "results_rates": f"""select category, n, flagged, blocked, round(flagged / n, 6) as flag_rate, round(blocked / n, 6) as block_rate
            from (select category, count(*) as n, count(*) filter (f) as flagged, count(*) filter (b) as blocked from {_RESULTS} group by 1)""",
        "results_missed": f"select result_id, category, round(cast(score as double), 4) as score, normalized from {_RESULTS} where not b",
        "log_times": "select record_id, strftime(make_timestamp((record_id * 86413 - 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as written_at from audit_record",
        "log_signed": _SIGNED,
        "log_verified": "select record_id, record_id % 3 <> 0 and record_id % 5 <> 0 as verified from audit_record",
        "log_chain": _CHAIN,
        # a record without text has nothing that could be changed
        "audit_sign_verify": "select sample_id, 64 as digits, true as as_signed, false as wrong_key, text is null as changed from adversarial",
        "audit_chain": "select coalesce(lower(trim(category, ' ')), '') as chain, count(*) as n, count(*) as verified, count(*) as linked from adversarial group by 1",
        "log_links": """select record_id, prev_hmac is not distinct from lag(signature) over (partition by app_id order by record_id) as linked from audit_record""",
        "audit_hash": "select doc_id, sha256(text) as input_hash, length(text) as input_len from documents",
    }
