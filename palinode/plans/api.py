"""The one-call forms: a table of texts in, results out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions import tables as T
from palinode.functions.config import Config
from palinode.operators.fused import Scanner
from palinode.operators.pipeline import DETECTION, Normalizer, detection_kinds, label, summary


def analyze_text(df: DataFrame, text: str = "text", config: Config | None = None) -> DataFrame:
    """``df`` with all results of all passes, their kinds, a summary and the label of the decision."""
    cfg = config or Config()
    out = Normalizer(config=cfg).analyze(df, text)
    found, score = out["detections"], out["score"]
    return out.withColumns({"detection_kinds": detection_kinds(found), "summary": summary(score, found), "label": label(score, cfg)})


def score(df: DataFrame, text: str = "text", config: Config | None = None) -> DataFrame:
    """``df`` with ``score`` alone."""
    return Normalizer(config=config).analyze(df, text).select(*df.columns, "score")


def should_block(df: DataFrame, text: str = "text", config: Config | None = None) -> DataFrame:
    """``df`` with ``should_block`` alone."""
    return Normalizer(config=config).analyze(df, text).select(*df.columns, "should_block")


def analyzed_view(df: DataFrame, name: str, text: str = "text", config: Config | None = None) -> None:
    """Make ``analyze_text`` of a table available to SQL as a temporary view."""
    analyze_text(df, text, config).createOrReplaceTempView(name)


ANALYSIS = f"struct<normalized:string,detections:array<{DETECTION}>,detection_kinds:array<string>,halted:boolean,score:float,should_flag:boolean,should_block:boolean,label:string>"


def register(spark: SparkSession, config: Config | None = None) -> None:
    """Make ``analyze_text(text)``, ``obfuscation_score(text)`` and ``should_block(text)`` known to SQL in this session; null gives null."""
    cfg = config or Config()
    scanner = Scanner(T.PASSES, cfg, T.homoglyphs(spark), T.skeletons(spark))

    def judged(text: str | None) -> dict:
        if text is None:
            return dict.fromkeys(("normalized", "detections", "detection_kinds", "halted", "score", "should_flag", "should_block", "label"))
        got = scanner.scan(text)
        score = scanner.score(got)
        flag, block = scanner.reaches(score, cfg.flag_threshold), scanner.reaches(score, cfg.block_threshold)
        kinds = list(dict.fromkeys(d["kind"] for d in got["found"]))
        return {"normalized": got["text"], "detections": got["found"], "detection_kinds": kinds, "halted": got["halted"], "score": score,
                "should_flag": flag, "should_block": block, "label": "BLOCK" if block else "FLAG" if flag else "pass"}

    @F.pandas_udf(ANALYSIS)
    def analyzed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judged(t) for t in texts])

    @F.pandas_udf("float")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([judged(t)["score"] for t in texts], dtype="float32")

    @F.pandas_udf("boolean")
    def blocked(texts: pd.Series) -> pd.Series:
        return pd.Series([judged(t)["should_block"] for t in texts], dtype="object")

    for name, function in (("analyze_text", analyzed), ("obfuscation_score", scored), ("should_block", blocked)):
        spark.udf.register(name, function)
