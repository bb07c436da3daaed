"""Forms shared by the operators on audit records: digests, instants and pass names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palinode.functions.tables import PASSES

def digest_of(text: Column) -> Column:
    """The 64 lower-case hexadecimal digits of a SHA-256 however written (case, blanks, colons, dashes, ``0x`` or ``sha256:``), else null."""
    bare = F.regexp_replace(F.lower(text), r"[\s ]+", "")
    bare = F.regexp_replace(bare, r"^(?:sha-?256[:=]?|0x)", "")
    bare = F.regexp_replace(bare, r"[:\-_]", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}$"), bare)


def instant_us(written: Column, received: Column) -> Column:
    """Microseconds since 1970 (UTC) of the written instant; of ``received`` where that is null, empty or no instant.

    A written instant without a zone means UTC. Does not depend on the zone of the session.
    """
    text = F.trim(written)
    zoned = F.when(text.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    parsed = F.unix_micros(F.when(F.length(text) > 0, zoned).try_cast("timestamp"))
    return F.coalesce(parsed, ntz_us(received))


def ntz_us(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp that means UTC, with or without a zone in its type."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, at.cast("timestamp_ntz"))


def day_of(us: Column) -> Column:
    """The UTC day (YYYY-MM-DD) of an instant in microseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")).cast("string")


def pass_name(name: Column) -> Column:
    """The kebab form of a pass name written in kebab, Debug, upper case or untidy form; blank names become null.

    Known names are matched by their letters and digits alone; an unknown one is split before its inner capitals.
    """
    squashed = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    known = F.create_map(*[F.lit(x) for p in PASSES for x in (p.replace("-", ""), p)])
    spaced = F.regexp_replace(F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1-$2"), r"[\s_\-]+", "-")
    other = F.regexp_replace(F.lower(spaced), "^-|-$", "")
    return F.when(squashed != "", F.coalesce(F.element_at(known, squashed), other))
