"""Audit records without payloads, their signatures and their chains."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palinode.operators.pipeline import detection_kinds

#: The fields of a record in the order in which it is written.
FIELDS = (
    "input_hash", "input_len", "timestamp", "obfuscation_score", "halted", "blocked", "passes_fired", "detections", "prev_hmac", "signature",
)
_BLOCK = 64
#: Seconds of 400 years, after which the calendar repeats.
_CYCLE = 146_097 * 86_400


def truncated(detail: Column) -> Column:
    """At most 200 bytes of a text, cut between characters, and dots where something is missing."""
    fits = F.array_max(F.filter(F.sequence(F.lit(50), F.lit(200)), lambda n: F.octet_length(F.left(detail, n)) <= 200))
    return F.when(F.octet_length(detail) > 200, F.concat(F.left(detail, fits), F.lit("..."))).otherwise(detail)


def iso_utc(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970, whatever the zone of the session; any bigint or decimal.

    Years past 9999 have more digits, those before 0 a sign and no padding, as ``strftime`` has them.
    """
    seconds = F.floor(seconds)
    whole = lambda a, size: F.call_function("div", a, F.lit(size))
    within = F.pmod(seconds, F.lit(_CYCLE)).cast("bigint")
    cycles = whole(seconds, _CYCLE) - (seconds % _CYCLE < 0).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole(within, 86400).cast("int"))
    year = cycles * 400 + F.year(day)
    digits = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    part = lambda unit, size: F.lpad((whole(within, unit) % size).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    return F.concat(digits, F.substring(day.cast("string"), 5, 6), F.lit("T"), clock, F.lit("Z"))


def records(analyzed: DataFrame, text: str = "text", at: Column | None = None) -> DataFrame:
    """``analyzed`` with the fields of its audit records in place of ``detections``; ``at`` is the time as text, by default now.

    Null texts have a record of nulls. Columns of these names are replaced.
    """
    record = F.transform(
        "detections",
        lambda d: F.struct(
            d["kind"].alias("pass"),
            F.length(d["original"]).cast("bigint").alias("original_len"),
            F.length(d["normalized"]).cast("bigint").alias("normalized_len"),
            truncated(d["detail"]).alias("detail"),
            d["confidence"].alias("confidence"),
        ),
    )
    when = at if at is not None else iso_utc(F.unix_seconds(F.current_timestamp()))
    out = analyzed.withColumns(
        {
            "input_hash": F.sha2(F.col(text), 256),
            "input_len": F.length(text).cast("bigint"),
            "timestamp": when,
            "obfuscation_score": F.col("score"),
            "blocked": F.col("should_block"),
            "passes_fired": detection_kinds(F.col("detections")),
            "prev_hmac": F.lit(None).cast("string"),
            "signature": F.lit(None).cast("string"),
        }
    )
    return out.withColumn("detections", record)


def to_line() -> Column:
    """A record as one line of JSON, fields in order, nulls kept."""
    return F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})


def to_pretty() -> Column:
    """A record as JSON over several lines, for people."""
    return F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false", "pretty": "true"})


def _message() -> Column:
    fields = [F.lit(None).cast("string").alias("signature") if f == "signature" else F.col(f) for f in FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, composed of built-in hashes."""
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def sign(df: DataFrame, key: bytes) -> DataFrame:
    """Records with ``signature`` over all other fields."""
    return df.withColumn("signature", hmac_sha256(_message(), key))


def verify(df: DataFrame, key: bytes, to: str = "verified") -> DataFrame:
    """Adds whether each record's signature is right; false for unsigned and malformed ones. Hexadecimal digits may be of either case."""
    well_formed = F.col("signature").rlike("^[0-9A-Fa-f]{64}$")
    return df.withColumn(to, F.coalesce(well_formed & (F.lower("signature") == hmac_sha256(_message(), key)), F.lit(False)))


def _head() -> Column:
    """The record as text without its last two fields."""
    return F.to_json(F.struct(*[f for f in FIELDS if f not in ("prev_hmac", "signature")]), {"ignoreNullFields": "false"})


def chain(df: DataFrame, key: bytes, by: str, order: str) -> DataFrame:
    """``by``, ``order`` and the fields of records signed one after the other within ``by`` along ``order``, each with the signature before it as ``prev_hmac``.

    A chain is sequential by nature, so one task walks it; it does so in sorted batches, never holding a chain in memory. Only the
    text that is signed goes through it, made before and taken apart after by built-in expressions. Other columns are left out.
    """
    sorted_ = df.select(by, order, _head().alias("head")).repartition(by).sortWithinPartitions(by, order)
    kinds = dict(df.dtypes)
    schema = f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, head string, prev_hmac string, signature string"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), None
        for pdf in frames:
            before, signed = [], []
            for group, text in zip(pdf[by], pdf["head"], strict=True):
                if group != current:
                    current, last = group, None
                before.append(last)
                message = f'{text[:-1]},"prev_hmac":{json.dumps(last)},"signature":null}}'
                last = hmac.new(key, message.encode(), hashlib.sha256).hexdigest()
                signed.append(last)
            yield pdf.assign(prev_hmac=before, signature=signed)

    fields = [f for f in FIELDS if f not in ("prev_hmac", "signature")]
    record = F.from_json("head", ", ".join(f"{f} {kinds[f]}" for f in fields))
    return sorted_.mapInPandas(walk, schema).select(by, order, *[record[f].alias(f) for f in fields], "prev_hmac", "signature")


def check_links(df: DataFrame, by: str, order: str, to: str = "linked") -> DataFrame:
    """Adds whether each record names the signature of the one before it; the first of a chain names none."""
    before = F.lag("signature").over(Window.partitionBy(by).orderBy(order))
    return df.withColumn(to, F.col("prev_hmac").eqNullSafe(before))
