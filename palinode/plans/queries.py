"""The queries of the engine's own operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.config import BASE_CONFIDENCE, Config
from palinode.operators import audit, native
from palinode.operators.pipeline import (
    Normalizer, compute_score, decision_at, evaluate_corpus, explode_detections, label, missed, rates, run_pass, summary,
)
from palinode.operators.pipeline import confidence as confidence_of
from palinode.plans.api import analyze_text
from palinode.sources.shared import spread, table

#: The query of each pass.
PASS_QUERIES = {
    "nfc_fold": "pre-scan-nfc", "invisible_strip": "invisible-strip", "cjk_halt": "cjk-superposition", "bidi_strip": "bidi-control",
    "fullwidth_fold": "fullwidth-chars", "backslash_unescape": "backslash-escape", "unicode_unescape": "unicode-escape", "punycode_decode": "punycode",
    "rot13_decode": "rot13", "url_decode": "url-encoding", "html_decode": "html-entities", "base64_decode": "base64", "morse_decode": "morse-code",
    "homoglyph_fold": "homoglyph", "script_intrusion": "script-intrusion", "leet_fold": "leetspeak", "entropy_bigram": "entropy-bigram",
    "split_keyword": "split-string", "skeleton_match": "skeleton-match",
}

KEY = b"a key of the tests"


def _pass_query(kind: str, spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "adversarial").select("sample_id", run_pass(kind, F.col("text"), Config(), spark).alias("r"))
    hits = F.greatest(F.size("r.hits"), F.lit(0)).cast("bigint")
    return now.select("sample_id", hits.alias("n_hits"), (hits > 0).alias("fired"), F.col("r.text").alias("normalized"))


def _rounded(score: Column) -> Column:
    return F.round(score.cast("double"), 4)


def _analyzed(spark: SparkSession, d: str) -> DataFrame:
    return analyze_text(spread(table(spark, d, "adversarial")))


def script_interference(spark: SparkSession, d: str) -> DataFrame:
    """How far the scripts of documents differ from their mirror image."""
    return table(spark, d, "documents").select("doc_id", F.round(native.interference(F.col("text")).cast("double"), 4).alias("interference"))


def score_decision(spark: SparkSession, d: str) -> DataFrame:
    """Score, decision and summary of every sample."""
    return _analyzed(spark, d).select("sample_id", _rounded(F.col("score")).alias("score"), "should_flag", "should_block", "halted", "label", "summary")


def benign_decision(spark: SparkSession, d: str) -> DataFrame:
    """Score and decision of harmless samples."""
    return analyze_text(table(spark, d, "benign")).select("sample_id", _rounded(F.col("score")).alias("score"), "should_flag", "should_block", "label")


def detection_explode(spark: SparkSession, d: str) -> DataFrame:
    """One row per detection."""
    return explode_detections(_analyzed(spark, d), "sample_id").select("sample_id", "ord", "kind", "original", "normalized")


def confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidences by kind."""
    each = explode_detections(_analyzed(spark, d), "sample_id")
    spread = [f(F.round(F.col("confidence").cast("double"), 4)).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *spread)


def corpus_eval(spark: SparkSession, d: str) -> DataFrame:
    """Detection and block counts per category, the misses being n - flagged."""
    named = table(spark, d, "adversarial").withColumn("category", F.lower(F.trim("category")))
    return evaluate_corpus(Normalizer().analyze(spread(named.select("category", "text"))))


def corpus_rates(spark: SparkSession, d: str) -> DataFrame:
    """Overall rates of both corpora; flagged harmless samples are false positives."""
    both = table(spark, d, "adversarial").select(F.lit("adversarial").alias("corpus"), "text")
    both = both.unionByName(table(spark, d, "benign").select(F.lit("benign").alias("corpus"), "text"))
    return rates(Normalizer().analyze(spread(both)), "corpus")


def corpus_missed(spark: SparkSession, d: str) -> DataFrame:
    """Attacks that were not flagged and harmless samples that were, with score and text."""
    sides = (("adversarial", True), ("benign", False))
    each = [missed(Normalizer().analyze(spread(table(spark, d, t))), "should_flag", w).withColumn("corpus", F.lit(t)) for t, w in sides]
    return each[0].unionByName(each[1], allowMissingColumns=True).select("corpus", "sample_id", "category", _rounded(F.col("score")).alias("score"), "text")


def left_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the passes leave of every sample, and their kinds."""
    return _analyzed(spark, d).select("sample_id", "normalized", F.array_join("detection_kinds", ", ").alias("kinds"))


def detections_scored(spark: SparkSession, d: str) -> DataFrame:
    """Score, decision and summary of the detections of each sample in the table."""
    rows = table(spark, d, "detection").where("kind is not null")
    # a sample has a few detections
    of = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", "detection_id", "kind", "original", "normalized", "detail", "confidence"))).alias("found"))
    zero, cfg = F.lit(0.0).cast("float"), Config()
    out = of.withColumn("score", compute_score(F.col("found"), zero, zero, cfg))
    return out.select(
        "sample_id", _rounded(F.col("score")).alias("score"), decision_at(F.col("score"), cfg.flag_threshold).alias("should_flag"),
        decision_at(F.col("score"), cfg.block_threshold).alias("should_block"), label(F.col("score"), cfg).alias("label"), summary(F.col("score"), F.col("found")).alias("summary"),
    )


def detection_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The confidence of every detection in the table by its kind and the change of its text."""
    rows = table(spark, d, "detection").where(F.col("kind").isin(*BASE_CONFIDENCE))
    value = reduce(lambda a, k: F.when(F.col("kind") == k, confidence_of(k, F.col("original"), F.col("normalized"))).otherwise(a), BASE_CONFIDENCE, F.lit(None).cast("float"))
    return rows.select("detection_id", _rounded(value).alias("confidence"))


def detail_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Texts of detections cut as details are."""
    return table(spark, d, "detection").select("detection_id", audit.truncated(F.col("original")).alias("detail"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The results in the table with their decisions and the category of their sample."""
    samples = table(spark, d, "adversarial").select("sample_id", F.lower(F.trim("category")).alias("category"))
    flags = {"should_flag": F.col("score") >= F.col("flag_threshold"), "should_block": F.col("score") >= F.col("block_threshold")}
    return table(spark, d, "normalization_result").withColumns(flags).join(samples, "sample_id", "left")


def results_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the results in the table by category."""
    return rates(_results(spark, d))


def results_missed(spark: SparkSession, d: str) -> DataFrame:
    """Results in the table that were not blocked."""
    return missed(_results(spark, d), "should_block").select("result_id", "category", _rounded(F.col("score")).alias("score"), "normalized")


def log_times(spark: SparkSession, d: str) -> DataFrame:
    """Instants as the log writes them."""
    # the product with a large number is wider than a bigint
    seconds = F.col("record_id").cast("decimal(19,0)") * 86_413 - 100_000_000
    return table(spark, d, "audit_record").select("record_id", audit.iso_utc(seconds).alias("written_at"))


def log_signed(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the log as a line, signed."""
    return audit.sign(table(spark, d, "audit_record"), KEY).select("record_id", audit.to_line().alias("line"))


def log_verified(spark: SparkSession, d: str) -> DataFrame:
    """Records signed anew, every third with a wrong key and every fifth changed after, and whether each is found right."""
    signed = audit.sign(table(spark, d, "audit_record"), KEY).withColumn("other", F.col("signature"))
    other = audit.sign(signed, b"another key").withColumn("signature", F.when(F.col("record_id") % 3 == 0, F.col("signature")).otherwise(F.upper("other")))
    changed = other.withColumn("input_len", F.when(F.col("record_id") % 5 == 0, F.coalesce(F.col("input_len") + 1, F.lit(0).cast("bigint"))).otherwise(F.col("input_len")))
    return audit.verify(changed, KEY).select("record_id", "verified")


def log_chain(spark: SparkSession, d: str) -> DataFrame:
    """The records of each app chained in the order of arrival."""
    return audit.chain(table(spark, d, "audit_record"), KEY, "app_id", "record_id").select("record_id", "prev_hmac", "signature")


def log_links(spark: SparkSession, d: str) -> DataFrame:
    """Whether each record of the log names the signature before it."""
    return audit.check_links(table(spark, d, "audit_record"), "app_id", "record_id").select("record_id", "linked")


def audit_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash and length of every document."""
    texts = table(spark, d, "documents")
    return texts.select("doc_id", F.sha2("text", 256).alias("input_hash"), F.length("text").cast("bigint").alias("input_len"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records timed by the row, so that runs can be compared."""
    rows = spread(table(spark, d, "adversarial"))
    return audit.records(Normalizer().analyze(rows), at=audit.iso_utc(F.col("sample_id") * 61))


def audit_record(spark: SparkSession, d: str) -> DataFrame:
    """The audit record of every sample as a line."""
    made = _records(spark, d)
    return made.select("sample_id", audit.to_line().alias("line"))


def audit_sign_verify(spark: SparkSession, d: str) -> DataFrame:
    """Signed records, checked as they are, with another key and after a change."""
    signed = audit.sign(_records(spark, d), KEY)
    right = audit.verify(signed, KEY, "as_signed")
    wrong = audit.verify(right, b"another key", "wrong_key")
    changed = audit.verify(wrong.withColumn("blocked", ~F.col("blocked")), KEY, "changed")
    return changed.select("sample_id", F.length("signature").alias("digits"), "as_signed", "wrong_key", "changed")


def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Records chained by category, every link and signature checked."""
    rows = _records(spark, d).select("sample_id", F.coalesce(F.lower(F.trim("category")), F.lit("")).alias("chain"), *audit.FIELDS)
    chained = audit.chain(rows, KEY, "chain", "sample_id")
    checked = audit.check_links(audit.verify(chained, KEY), "chain", "sample_id")
    return checked.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"), F.count_if("linked").alias("linked"))


def documents_scan(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on whole documents."""
    out = Normalizer().analyze(spread(table(spark, d, "documents").select("doc_id", "text")))
    return out.select("doc_id", _rounded(F.col("score")).alias("score"), "should_flag", "should_block", "halted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    own = (
        script_interference, score_decision, benign_decision, detection_explode, confidence, corpus_eval, corpus_rates, corpus_missed, audit_hash, audit_record,
        audit_sign_verify, audit_chain, documents_scan, left_texts, detections_scored, detection_confidence, detail_truncated, results_rates, results_missed,
        log_times, log_signed, log_verified, log_chain, log_links,
    )
    return {n: partial(_pass_query, kind) for n, kind in PASS_QUERIES.items()} | {f.__name__: f for f in own}
