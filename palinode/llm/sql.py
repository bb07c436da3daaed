"""What the queries must give, as SQL for another engine, written from the statement of each problem."""

from __future__ import annotations

_BLANK = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
_CATEGORY = "nullif(regexp_replace(regexp_replace(lower({0}), '^B+|B+$', '', 'g'), '(B|[_-])+', '-', 'g'), '')".replace("B", _BLANK.replace("{", "{{").replace("}", "}}"))
_DIGEST = "regexp_extract(replace(regexp_replace(lower(trim({0}, E' \\t\\r\\n')), '^(sha256:|0x)', ''), ':', ''), '^[0-9a-f]{{64}}$')"
#: The instant in microseconds: the date and time as written, less the offset.
_TIME = """coalesce(
    epoch_us(cast(replace(substr(nullif(trim("timestamp"), ''), 1, 10) || ' ' || regexp_extract("timestamp", '\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?'), 'T', ' ') as timestamp))
      - case when regexp_matches("timestamp", '[+-]\\d\\d:\\d\\d$')
             then (case when substr("timestamp", -6, 1) = '-' then -1 else 1 end)
                  * (cast(substr("timestamp", -5, 2) as bigint) * 60 + cast(substr("timestamp", -2) as bigint)) * 60000000
             else 0 end,
    epoch_us(received_at))"""
_NAMES = (
    "pre-scan-nfc invisible-strip cjk-superposition bidi-control fullwidth-chars backslash-escape unicode-escape punycode rot13 url-encoding "
    "html-entities base64 morse-code homoglyph script-intrusion leetspeak entropy-bigram split-string skeleton-match"
)
_NAME_ROWS = "select unnest(string_split('" + _NAMES + "', ' ')) as kebab"
_SQUASH = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"

_MIX = f"""
    with size as (select cast(floor(count(*) / 2) as decimal(18,0)) as s from adversarial),
    have as (select {_CATEGORY.format("category")} as k, count(*) as n from adversarial group by 1)
    select t.category, t.share, t.min_rows, cast(s as bigint) as size, coalesce(n, 0) as available,
           greatest(t.min_rows, cast(ceil(cast(t.share as decimal(18,12)) * s) as bigint)) as wanted,
           least(coalesce(n, 0), greatest(t.min_rows, cast(ceil(cast(t.share as decimal(18,12)) * s) as bigint))) as quota,
           coalesce(n, 0) < greatest(t.min_rows, cast(ceil(cast(t.share as decimal(18,12)) * s) as bigint)) as exhausted
    from target_mix t cross join size left join have on have.k = {_CATEGORY.format("t.category")}"""

_PAIRS = f"""
    with names as ({_NAME_ROWS}),
    fired as (
      select distinct record_id, kebab from (select record_id, unnest(passes_fired) as p from audit_record)
      join names on replace(kebab, '-', '') = {_SQUASH.format("p")}),
    total as (select count(*) as n from audit_record where len(passes_fired) > 0),
    single as (select kebab, count(*) as m from fired group by 1),
    both_ as (select a.kebab as pass_a, b.kebab as pass_b, count(*) as together
              from fired a join fired b on a.record_id = b.record_id and a.kebab < b.kebab group by 1, 2)
    select pass_a, pass_b, together, x.m as count_a, y.m as count_b, n
    from both_ join single x on x.kebab = pass_a join single y on y.kebab = pass_b cross join total"""

_TOP = f"""
    select {_DIGEST.format("input_hash")} as digest, count(*) as n from audit_record
    where {_DIGEST.format("input_hash")} <> '' group by 1 order by n desc, digest limit 20"""

_MEASURES_WITH = f"""
    with names as ({_NAME_ROWS}),
    log as (select app_id, obfuscation_score, detections, strftime(make_timestamp({_TIME}), '%Y-%m-%d') as on_day from audit_record),
    hits as (select on_day, unnest(detections) as x from log),
    vals as (
      select 'obfuscation_score' as measure, app_id as grp, on_day, obfuscation_score as v from log
      union all
      select 'confidence', kebab, on_day, x.confidence from hits join names on replace(kebab, '-', '') = {_SQUASH.format("x.pass")}),
    kept as (select * from vals where v is not null and not isnan(v) and v >= 0 and v <= 1)"""
_MEASURES_KEPT = f"{_MEASURES_WITH} select * from kept"
_MEASURES = f"""{_MEASURES_WITH},
    ranked as (select *, row_number() over (partition by measure, grp, on_day order by v) as r, count(*) over (partition by measure, grp, on_day) as n from kept)
    select measure, grp, on_day, cast(pct as integer) as pct, cast(round(cast(min(v) as double) * 10000) as bigint) as value_e4
    from ranked cross join (select unnest([50, 90, 99]) as pct) where r * 100 >= pct * n group by 1, 2, 3, 4"""


# Fixed values, as a reader sees them: letters of other scripts and the Latin ones they look like, with accents as far as they are composed
_FOREIGN = "аАαΑВΒсСϲϹԁеЕΕԌһНΗіІιΙӀјЈϳͿКΚМΜΝԚԛоОοΟօՕрРρΡѕЅՏТΤսՍνѵѴԝԜхХΧуҮΥүΖոցհɑɡёЁїЇ"
_LATIN = "aAaABBcCcCdeEEGhHHiIiIIjJjJKKMMNQqoOoOoOpPpPsSSTTuUvvVwWxXXyYYyZnghagëËïÏ"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_UNSEEN = (
    r"[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}"
    r"\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"
)
_BLANKS = r"[\t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{2800}\x{3000}]"
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ǆ", "dž"), ("ǉ", "lj"), ("ǌ", "nj"))


def _look(x: str) -> str:
    """The form in which texts that look the same are equal."""
    out = f"regexp_replace(replace({x}, E'\\r\\n', E'\\n'), '{_UNSEEN}', '', 'g')"
    for one, letters in _LIGATURES:
        out = f"replace({out}, '{one}', '{letters}')"
    out = f"translate(nfc_normalize(regexp_replace({out}, '{_BLANKS}', ' ', 'g')), '{_WIDE}', '{_NARROW}')"
    return f"nfc_normalize(translate({out}, '{_FOREIGN}', '{_LATIN}'))"


_LOOKS = " union all ".join(
    f"select '{t}' as tbl, {i} as id, {c} as text, {_look(c)} as look from {t}"
    for t, i, c in (("adversarial", "sample_id", "text"), ("detection", "detection_id", "original"), ("normalization_result", "result_id", "normalized"))
)
_EVERY = f"select tbl, id, look as canonical from ({_LOOKS})"
_LOOKS = f"(select * from ({_LOOKS}) where trim(look, ' ') <> '')"


def oracle_sql() -> dict[str, str]:
    """SQL by query; the queries without one are tested against brute force."""
    return {
        "p1_found": f"select category from ({_MIX}) where exhausted",
        "p1_report": f"select *, round(quota / (select greatest(sum(quota), 1) from ({_MIX})), 6) as share_reached from ({_MIX})",
        "p1_drawn": f"select category, quota as drawn, quota as different from ({_MIX}) where quota > 0",
        "p2_found": f"""
            with looks as materialized {_LOOKS}
            select a.tbl, a.id as id_a, b.id as id_b from looks a join looks b on a.tbl = b.tbl and a.look = b.look and a.id < b.id and a.text <> b.text""",
        # Latin letters, blanks and ASCII signs are the most frequent of their classes in these tables
        "p2_canonical": _EVERY,
        "p2_links": f"""
            with looks as materialized {_LOOKS},
            of as (select tbl, look, count(*) as n, count(distinct text) as variants from looks group by 1, 2 having count(distinct text) > 1),
            same as (select tbl, look, text, count(*) as copies from looks group by 1, 2, 3)
            select l.tbl, l.id, variants, n - copies as links from looks l join of using (tbl, look) join same using (tbl, look, text)""",
        "p3_found": f"""
            with log as (select record_id, {_DIGEST.format("input_hash")} as digest, {_TIME} as us from audit_record where input_hash is not null),
            old as (select distinct {_DIGEST.format("digest")} as digest from seen_digest)
            select record_id from (
              select record_id, digest, row_number() over (partition by digest order by us, record_id) as nth from log where digest <> '')
            where nth > 1 or digest in (select digest from old)""",
        "p4_found": f"""
            select pass_a, pass_b from ({_PAIRS})
            where together * 100 >= n and cast(together as hugeint) * n >= 3 * cast(count_a as hugeint) * count_b""",
        "p4_pairs": f"""
            select pass_a, pass_b, together, count_a, count_b, n,
                   round(cast(together as double) * n / (cast(count_a as double) * count_b), 6) as lift,
                   case when count_a > together then round((1 - cast(count_b as double) / n) / (1 - cast(together as double) / count_a), 6) end as conviction
            from ({_PAIRS})""",
        "p5_counts": _TOP,
        "p5_bounds": f"select *, true as sure from ({_TOP})",
        "p5_found": f"select digest from ({_TOP})",
        "p6_found": _MEASURES,
        "p6_brackets": f"""
            select measure, grp, cast(pct as integer) as pct, n, true as held from (
              select measure, grp, count(*) as n from ({_MEASURES_KEPT}) group by 1, 2) cross join (select unnest([50, 90, 99]) as pct)""",
        "p7_coverage": """
            select count(*) as documents, cast(sum((n + 4095) // 4096) as bigint) as parts, cast(sum(n) as bigint) as tokens, cast(0 as bigint) as broken, cast(0 as bigint) as too_full, true as tight
            from (select octet_length(encode(text)) + 1 as n from documents where text is not null)""",
        "p7_found": "select doc_id from documents where octet_length(encode(text)) + 1 > 4096",
    }
