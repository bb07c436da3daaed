"""The ordered passes as one plan, their score and the decision."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions import tables as T
from palinode.functions.config import BASE_CONFIDENCE, Config
from palinode.operators import arrow, native
from palinode.operators.fused import Scanner

DETECTION = "struct<kind:string,original:string,normalized:string,detail:string,confidence:float>"

#: What the Arrow stage of all passes gives.
SCANNED = f"struct<text:string,found:array<{DETECTION}>,mixed:float,leet:float,halted:boolean>"

#: The passes in the order in which they run, each with its function; those that take the session need a table made with it.
ORDER: tuple[tuple[str, Callable[..., Column], bool], ...] = (
    ("pre-scan-nfc", arrow.pre_scan_nfc, False),
    ("invisible-strip", native.invisible_strip, False),
    ("cjk-superposition", native.cjk_superposition, False),
    ("bidi-control", native.bidi_control, False),
    ("fullwidth-chars", native.fullwidth_chars, False),
    ("backslash-escape", native.backslash_escape, False),
    ("unicode-escape", native.unicode_escape, False),
    ("punycode", arrow.punycode, True),
    ("rot13", native.rot13, False),
    ("url-encoding", native.url_encoding, False),
    ("html-entities", native.html_entities, False),
    ("base64", arrow.base64_pass, False),
    ("morse-code", arrow.morse_code, False),
    ("homoglyph", native.homoglyph, True),
    ("script-intrusion", native.script_intrusion, False),
    ("leetspeak", native.leetspeak, False),
    ("entropy-bigram", native.entropy_bigram, False),
    ("split-string", native.split_string, False),
    ("skeleton-match", arrow.skeleton_match, True),
)


def run_pass(kind: str, text: Column, cfg: Config, spark: SparkSession) -> Column:
    """One pass on a text column; the result has ``text``, ``hits`` and ``ratio``."""
    for name, function, tables in ORDER:
        if name == kind:
            return function(text, cfg, spark) if tables else function(text, cfg)
    raise ValueError(f"no such pass: {kind}")


def confidence(kind: str, original: Column, normalized: Column) -> Column:
    """The base of the kind and up to 0.20 for the share by which the text's length changed."""
    n = F.length(original).cast("float")
    change = F.when(n > 0, F.least(F.abs(n - F.length(normalized)) / n, F.lit(1.0))).otherwise(F.lit(0.0)).cast("float")
    return F.least(F.lit(BASE_CONFIDENCE[kind]).cast("float") + change * F.lit(0.20).cast("float"), F.lit(1.0).cast("float")).cast("float")


class Normalizer:
    """Chooses passes and thresholds; the set of passes decides the plan, their order never changes.

    ``Normalizer()`` has all passes on; ``Normalizer.bare()`` none.
    """

    def __init__(self, kinds: Iterable[str] = T.PASSES, config: Config | None = None) -> None:
        self.kinds = frozenset(kinds)
        if unknown := self.kinds - set(T.PASSES):
            raise ValueError(f"no such pass: {sorted(unknown)}")
        self.config = config or Config()

    @classmethod
    def bare(cls) -> Normalizer:
        """Without any pass."""
        return cls(())

    def enable(self, kind: str) -> Normalizer:
        """With this pass too."""
        return Normalizer(self.kinds | {kind}, self.config)

    def disable(self, kind: str) -> Normalizer:
        """Without this pass. Look-alikes are still replaced, and reported, as long as homoglyph or script-intrusion is on."""
        return Normalizer(self.kinds - {kind}, self.config)

    def with_config(self, config: Config) -> Normalizer:
        """With other thresholds and weights."""
        return Normalizer(self.kinds, config)

    def analyze(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``normalized``, ``detections``, ``halted``, ``score``, ``should_flag``, ``should_block``; null texts give null.

        All passes run in one Arrow stage. What it gives passes through a generator of one row, so that filters on the results do not run the
        stage a second time, while those on other columns reach the scan. Existing columns of these names are replaced. Works on
        streams: nothing crosses rows.
        """
        spark, cfg = df.sparkSession, self.config
        scanner = Scanner(self.kinds, cfg, T.homoglyphs(spark), T.skeletons(spark))

        @F.pandas_udf(SCANNED)
        def scan(texts: pd.Series) -> pd.DataFrame:
            nothing = dict.fromkeys(("text", "found", "mixed", "leet", "halted"))
            return pd.DataFrame([scanner.scan(t) if isinstance(t, str) else nothing for t in texts], columns=list(nothing))

        out = df.select("*", scan(F.col(text)).alias("__scanned")).select(*df.columns, F.explode(F.array("__scanned")).alias("__scanned"))
        got = F.col("__scanned")
        score = F.when(got["halted"], F.lit(1.0).cast("float")).otherwise(compute_score(got["found"], got["mixed"], got["leet"], cfg))
        out = out.withColumns({"normalized": got["text"], "detections": got["found"], "halted": got["halted"], "score": F.when(got["halted"].isNotNull(), score)})
        return out.drop("__scanned").withColumns(
            {"should_flag": decision_at(F.col("score"), cfg.flag_threshold), "should_block": decision_at(F.col("score"), cfg.block_threshold)}
        )


def compute_score(found: Column, mixed: Column, leet: Column, cfg: Config) -> Column:
    """The weights of all detections, repeated kinds again, and the two ratios, in single precision and at most 1."""
    single = lambda x: F.lit(x).cast("float")
    weights = F.create_map(*[x for k in T.PASSES for x in (F.lit(k), single(cfg.weight(k)))])
    total = F.aggregate(found, single(0.0), lambda a, d: (a + F.element_at(weights, d["kind"])).cast("float"))
    return F.least(((total + mixed * single(0.60)).cast("float") + leet * single(0.40)).cast("float"), single(1.0))


def decision_at(score: Column, threshold: float) -> Column:
    """Whether a score reaches a threshold, both in single precision."""
    return score >= F.lit(threshold).cast("float")


def detection_kinds(found: Column) -> Column:
    """The kinds of the detections, each once, in the order of their first."""
    return F.array_distinct(F.transform(found, lambda d: d["kind"]))


def summary(score: Column, found: Column) -> Column:
    """``clean``, or the score and the kinds."""
    told = F.concat(F.lit("score="), F.format_string("%.2f", score.cast("double")), F.lit("  detections=["), F.array_join(detection_kinds(found), ", "), F.lit("]"))
    return F.when(F.size(found) == 0, "clean").otherwise(told)


def label(score: Column, cfg: Config) -> Column:
    """BLOCK, FLAG or pass."""
    return F.when(decision_at(score, cfg.block_threshold), "BLOCK").when(decision_at(score, cfg.flag_threshold), "FLAG").when(score.isNotNull(), "pass")


def explode_detections(analyzed: DataFrame, *keys: str) -> DataFrame:
    """One row per detection: ``keys``, ``ord`` and the fields of the detection."""
    return analyzed.select(*keys, F.posexplode("detections").alias("ord", "d")).select(*keys, "ord", "d.*")


def evaluate_corpus(analyzed: DataFrame, category: str = "category") -> DataFrame:
    """Per category: ``n``, ``flagged``, ``blocked``."""
    return analyzed.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("should_flag").alias("flagged"), F.count_if("should_block").alias("blocked")
    )


def rates(analyzed: DataFrame, category: str = "category") -> DataFrame:
    """``evaluate_corpus`` with ``flag_rate`` and ``block_rate``."""
    share = lambda c: F.round(F.col(c) / F.col("n"), 6)
    return evaluate_corpus(analyzed, category).withColumns({"flag_rate": share("flagged"), "block_rate": share("blocked")})


def missed(analyzed: DataFrame, decision: str = "should_flag", wanted: bool = True) -> DataFrame:
    """The rows whose ``decision`` is not the ``wanted`` one: of attacks those that passed, of harmless texts (``wanted`` false) the false alarms."""
    return analyzed.where(F.col(decision) != F.lit(wanted))
