"""The queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.llm import heavy, leakage, lookalike, mix, packing, pairs, pii, quantiles
from palinode.llm.common import day_of, digest_of, instant_us, pass_name
from palinode.llm.seen import SeenBefore
from palinode.sources.shared import spread, table

#: Capacity of a container in tokens; the public byte-level tokenizer has a token per UTF-8 byte and one for the end.
CAPACITY = 4096


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix.sample_to_mix(table(spark, d, "adversarial"), table(spark, d, "target_mix"), "category", ["sample_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Target categories of which the sample that was drawn has too few rows."""
    return mix.shortfalls(*_mix(spark, d)).select("category")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample."""
    return _mix(spark, d)[0].select("sample_id", "mix_category", "text")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and drawn rows of each category."""
    return _mix(spark, d)[1]


def p1_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different rows of each category in the sample."""
    drawn = _mix(spark, d)[0].groupBy(F.col("mix_category").alias("category"))
    return drawn.agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("sample_id").alias("different"))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    fields = (("adversarial", "sample_id", "text"), ("detection", "detection_id", "original"), ("normalization_result", "result_id", "normalized"))
    return reduce(
        DataFrame.unionByName,
        [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("id"), F.col(c).alias("text")) for t, i, c in fields],
    )


def _looking(spark: SparkSession, d: str) -> DataFrame:
    texts = _looks(spark, d)
    return lookalike.keyed(texts, lookalike.fitted(texts))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows whose texts look the same and differ."""
    return lookalike.pairs(_looking(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row that looks like another text of its table, with its class and the number of such rows."""
    return lookalike.members(_looking(spark, d)).withColumn("look", F.lower(F.hex("look")))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """The same without the name of the class."""
    return lookalike.members(_looking(spark, d)).drop("look")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    texts = _looks(spark, d)
    return texts.select("tbl", "id", lookalike.fitted(texts).column(F.col("text")).alias("canonical"))


def _seen(spark: SparkSession, d: str, bits: int) -> SeenBefore:
    log = table(spark, d, "audit_record").select(
        F.col("record_id").alias("id"), F.unhex(digest_of(F.col("input_hash"))).alias("key"), instant_us(F.col("timestamp"), F.col("received_at")).alias("us")
    )
    return SeenBefore(log, table(spark, d, "seen_digest").select(F.unhex(digest_of(F.col("digest"))).alias("key")), bits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose digest was met before."""
    return _seen(spark, d, 32).seen().select(F.col("id").alias("record_id"))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rate of wrong answers of the filters of ``p3_found``, measured with absent keys."""
    return _seen(spark, d, 32).audit()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_counts(table(spark, d, "audit_record"), F.transform("passes_fired", pass_name)).withColumnsRenamed({"item_a": "pass_a", "item_b": "pass_b"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passes that fire together much more often than by chance."""
    return pairs.surprising(_pairs(spark, d), 1, 3).select("pass_a", "pass_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of passes with counts, lift and conviction."""
    scores = {c: F.round(c, 6) for c in ("lift", "conviction")}
    return _pairs(spark, d).withColumns(scores)


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "audit_record").select(F.unhex(digest_of(F.col("input_hash"))).alias("key"))
    top = heavy.most_frequent(keys, 20)
    return top.select(F.lower(F.hex("key")).alias("digest"), "n", "lower", "upper", "other")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The 20 digests with most records."""
    return _frequent(spark, d).select("digest")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The 20 digests with their counts."""
    return _frequent(spark, d).select("digest", "n")


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The 20 digests with counts, the bounds of the sketch, and whether both hold."""
    sure = (F.col("n") >= F.col("lower")) & (F.col("n") <= F.col("upper")) & (F.col("n") > F.col("other"))
    return _frequent(spark, d).select("digest", "n", sure.alias("sure"))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "audit_record").select(
        "app_id", "obfuscation_score", "detections", day_of(instant_us(F.col("timestamp"), F.col("received_at"))).alias("on_day")
    )
    scores = log.select(F.lit("obfuscation_score").alias("measure"), F.col("app_id").alias("grp"), "on_day", F.col("obfuscation_score").alias("value"))
    each = log.select("on_day", F.explode("detections").alias("x"))
    confidences = each.select(F.lit("confidence").alias("measure"), pass_name(F.col("x.pass")).alias("grp"), "on_day", F.col("x.confidence").alias("value"))
    # NaN is greater than any number here
    return scores.unionByName(confidences).where("value >= 0 and value <= 1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of scores and confidences per group and day."""
    exact = quantiles.percentiles(_measures(spark, d), ["measure", "grp", "on_day"], [50, 90, 99])
    return exact.select("measure", "grp", "on_day", "pct", F.round(F.col("value").cast("double") * 10_000).cast("bigint").alias("value_e4"))


def p6_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all days, from the merged sketches of the days."""
    days = quantiles.sketches(_measures(spark, d), ["measure", "grp", "on_day"])
    return quantiles.approximate(quantiles.merge(days, ["measure", "grp"]), [50, 90, 99])


def p6_brackets(spark: SparkSession, d: str) -> DataFrame:
    """Whether the bounds that the merged sketches of the days give hold the true percentiles over all days."""
    rows = _measures(spark, d)
    days = quantiles.sketches(rows, ["measure", "grp", "on_day"])
    told = quantiles.approximate(quantiles.merge(days, ["measure", "grp"]), [50, 90, 99]).select("measure", "grp", "pct", "low", "high")
    true = quantiles.percentiles(rows, ["measure", "grp"], [50, 90, 99])
    held = F.col("value").between(F.col("low"), F.col("high"))
    return true.join(told, ["measure", "grp", "pct"]).select("measure", "grp", "pct", "n", held.alias("held"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", F.octet_length("text") + 1, CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were assigned to more than one container, as only those larger than a container are."""
    of = _packed(spark, d).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return of.where("first <> last").select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every part of a document with its container."""
    return _packed(spark, d)


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a right packing must show: every token of every text once, no container too full, hardly more containers than the tokens need."""
    packed = _packed(spark, d)
    # parts of a text that follow each other without gap have these sums
    of = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("tokens"), F.max(F.col("start") + F.col("size")).alias("end"), F.max("n_parts").alias("n_parts"))
    texts = of.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("parts").alias("parts"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.count_if((F.col("tokens") != F.col("end")) | (F.col("parts") != F.col("n_parts"))).alias("broken"),
    )
    held = packed.groupBy("container").agg(F.sum("size").alias("used"))
    containers = held.agg(F.count_if(F.col("used") > CAPACITY).alias("too_full"), (F.count(F.lit(1)) <= F.ceil(F.sum("used") / CAPACITY) * 1.02 + 1).alias("tight"))
    return texts.join(containers)  # one row each


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, d), CAPACITY)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they leak."""
    return leakage.leaked(_texts(spark, d), table(spark, d, "eval_item"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of an item in a document, those included in whose place another item stands."""
    return leakage.leaks(_texts(spark, d), table(spark, d, "eval_item"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items by the number of documents that leak them."""
    found = leakage.leaked(_texts(spark, d), table(spark, d, "eval_item"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information by document and type."""
    return _personal(spark, d).select("doc_id", "pii_type", "surface").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders."""
    return pii.redact(table(spark, d, "documents"), _personal(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}
