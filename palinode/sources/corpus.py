"""Corpora and audit logs as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palinode.operators.audit import to_line

CORPUS = "category string, text string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``category`` and ``text`` of a JSONL file or folder; blank lines are skipped."""
    return spark.read.schema(CORPUS).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append audit records to a folder of JSONL files, one line each."""
    df.select(to_line().alias("value")).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Audit records from JSONL."""
    detection = "struct<pass:string,original_len:bigint,normalized_len:bigint,detail:string,confidence:float>"
    schema = (
        "input_hash string, input_len bigint, timestamp string, obfuscation_score float, halted boolean, blocked boolean, "
        f"passes_fired array<string>, detections array<{detection}>, prev_hmac string, signature string"
    )
    return spark.read.schema(schema).json(path)
