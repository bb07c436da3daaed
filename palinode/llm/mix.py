"""Sampling to target category proportions.

Each category keeps a bottom-k reservoir: every row has a pseudo-random priority, and a reservoir of size k is the k rows
of least priority. Such reservoirs merge by taking the least priorities of both, so the state that has to travel is not
the rows but how their priorities are spread: a histogram of fixed width per category, which is added up over partitions in
one pass. Once the final counts are known the quotas are fixed, and every reservoir is trimmed to its quota by a threshold
on the priority, found in the one bin in which it falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palinode.sources.shared import written

#: Bits of the priority that the first histogram tells apart, and further ones within the bins that are cut.
COARSE, FINE = 8, 12


def category_key(name: Column) -> Column:
    """Category names without regard to case, outer blanks and the kind of separator; blank names become null."""
    blanks = r"[\s   -   　]"
    tidy = F.regexp_replace(F.lower(name), rf"^(?:{blanks})+|(?:{blanks})+$", "")
    tidy = F.regexp_replace(tidy, rf"(?:{blanks}|[_\-])+", "-")
    return F.when(tidy != "", tidy)


def _priority(rows: DataFrame, category: str, keys: list[str], seed: int) -> DataFrame:
    """``rows`` with ``__key`` and ``__priority``; rows of equal ``keys`` have the same priority."""
    return rows.select("*", category_key(F.col(category)).alias("__key"), F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).alias("__priority"))


def _bin(shift: int, bits: int) -> Column:
    return F.shiftrightunsigned("__priority", 64 - shift - bits).bitwiseAND((1 << bits) - 1).alias("__bin")


def _upto(hist: DataFrame, by: list[str]) -> DataFrame:
    """``hist`` (``by``, ``__bin``, ``n``) with ``below``, the rows in lower bins. At most as many rows per group as there are bins."""
    lower = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("below", F.coalesce(F.sum("n").over(lower), F.lit(0)))


def _cut(hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """``__key``, the ``cut`` bin in which the row number ``take`` of ``wanted`` falls, and the number ``take`` within it."""
    there = _upto(hist, ["__key"]).join(wanted, "__key").where((F.col("below") < F.col("take")) & (F.col("below") + F.col("n") >= F.col("take")))
    return there.select("__key", F.col("__bin").alias("cut"), (F.col("take") - F.col("below")).alias("take"))


def histogram(rows: DataFrame, category: str, keys: list[str], seed: int = 7) -> DataFrame:
    """``__key``, ``__bin``, ``n``: how the priorities of each category are spread; adds up over partitions, files and days."""
    return _priority(rows, category, keys, seed).groupBy("__key", _bin(0, COARSE)).agg(F.count(F.lit(1)).alias("n"))


def quotas(hist: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per target: ``category`` as written in ``targets``, ``share``, ``min_rows``, ``available``, ``wanted``
    (the larger of ``min_rows`` and share x size, rounded up), ``quota`` (what can be had of it), ``exhausted``
    (fewer rows than wanted) and ``share_reached`` (the quota's part of all quotas, to six digits).

    ``size`` defaults to half the rows, rounded down; rows without a category count for it. A null share or minimum
    counts as 0. Targets without a name are left out; of targets that differ only in spelling the first by text counts.
    """
    size = (hist.agg(F.sum("n")).first()[0] or 0) // 2 if size is None else size
    counts = hist.groupBy("__key").agg(F.sum("n").alias("available"))
    first = Window.partitionBy("__key").orderBy("category")
    wanted = (
        targets.select(
            "category",
            F.coalesce(F.col("share").cast("decimal(20,12)"), F.lit(0).cast("decimal(20,12)")).alias("share"),
            F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0).cast("bigint")).alias("min_rows"),
            category_key(F.col("category")).alias("__key"),
        )
        .where(F.col("__key").isNotNull())
        .withColumn("__nth", F.row_number().over(first))
        .where("__nth = 1")
    )
    aim = (
        wanted.withColumn("size", F.lit(size).cast("decimal(18,0)"))
        .withColumn("wanted", F.greatest("min_rows", F.ceil(F.col("share") * F.col("size")).cast("bigint")))
        .join(counts, "__key", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("quota", F.least("wanted", "available"))
        .withColumn("exhausted", F.col("available") < F.col("wanted"))
    )
    total = F.sum("quota").over(Window.partitionBy(F.lit(1)))  # one row per target
    return aim.select(
        "category", "__key", F.col("share").cast("double").alias("share"), "min_rows", F.col("size").cast("bigint").alias("size"),
        "available", "wanted", "quota", "exhausted", F.round(F.col("quota") / F.greatest(total, F.lit(1)), 6).alias("share_reached"),
    )


def sample_to_mix(rows: DataFrame, targets: DataFrame, category: str, keys: list[str], size: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A sample of ``rows`` with the proportions of ``targets`` (``category``, ``share``, ``min_rows``), and the report.

    ``keys`` identify a row. The sample has all columns of ``rows`` and ``mix_category``, the name as in ``targets`` (a column
    of that name in ``rows`` is replaced). Within a category every row is equally likely; the draw depends on ``seed`` and the keys only. Rows of categories that are not wanted, and
    rows with a null category, are never drawn. Repeated rows are drawn independently of each other, equal ones in any
    order. Empty ``rows`` give an empty sample and a report in which every category with a positive minimum is exhausted.
    The number of target categories is taken to be small (a table that people write).

    Categories and keys are read for the histogram, and once more for the priorities of the bins that are cut (2**-COARSE of the
    rows, which are written); the sample itself is then one filter over one read.
    """
    hist = written(histogram(rows, category, keys, seed), "priorities")
    report = written(quotas(hist, targets, size), "quotas")
    named = report.select("__key", F.col("category").alias("mix_category"), "quota")
    coarse = _cut(hist, named.where("quota > 0").select("__key", F.col("quota").alias("take")))
    edge = _priority(rows.select(category, *[k for k in keys if k != category]), category, keys, seed).join(coarse, "__key").where(_bin(0, COARSE) == F.col("cut"))
    edge = written(edge.select("__key", "__priority", "take"), "edge")
    fine = edge.groupBy("__key", _bin(COARSE, FINE)).agg(F.count(F.lit(1)).alias("n"))
    fine = _cut(fine, edge.groupBy("__key").agg(F.first("take").alias("take")))
    # what is left are 2**-(COARSE + FINE) of a category's rows; rows of one priority come together before they are ranked
    last = edge.drop("take").join(fine, "__key").where(_bin(COARSE, FINE) == F.col("cut"))
    last = last.groupBy("__key", "take", F.col("__priority").alias("__bin")).agg(F.count(F.lit(1)).alias("n"))
    # bins are in the order of unsigned numbers
    order = lambda c: c.bitwiseXOR(F.lit(-(2**63)))
    lower = Window.partitionBy("__key").orderBy(order(F.col("__bin"))).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(lower), F.lit(0))
    last = last.withColumn("below", below).where((F.col("below") < F.col("take")) & (F.col("below") + F.col("n") >= F.col("take")))
    # how many of the rows that tie at the threshold are taken; all, unless keys repeat there
    plan = written(last.select("__key", F.col("__bin").alias("__at"), (F.col("take") - F.col("below")).alias("__ties"), (F.col("n") > F.col("take") - F.col("below")).alias("__some")), "cuts")
    plan = plan.join(named.drop("quota"), "__key")
    kept = _priority(rows.drop("mix_category"), category, keys, seed).join(plan, "__key").where(order(F.col("__priority")) <= order(F.col("__at")))
    tied = F.col("__some") & (F.col("__priority") == F.col("__at"))
    if plan.where("__some").isEmpty():
        drawn = kept
    else:
        # repeated keys at the threshold are numbered piece by piece
        same = written(kept.where(tied).withColumn("__row", F.monotonically_increasing_id()), "ties").withColumn("__piece", F.shiftright("__row", 33))
        pieces = same.groupBy("__key", "__piece").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("__key").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("__key", "__piece").orderBy("__row"))
        numbered = same.withColumn("__nth", nth).join(pieces.select("__key", "__piece", before.alias("__before")), ["__key", "__piece"])
        some = numbered.where(F.col("__nth") + F.col("__before") <= F.col("__ties")).drop("__row", "__piece", "__before", "__nth")
        drawn = kept.where(~tied).unionByName(some)
    return drawn.drop("__key", "__priority", "__at", "__ties", "__some"), report.drop("__key")


def shortfalls(sample: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of ``report`` whose category has fewer rows in ``sample`` than wanted, with ``drawn``."""
    drawn = sample.groupBy(F.col("mix_category").alias("category")).agg(F.count(F.lit(1)).alias("drawn"))
    return report.join(drawn, "category", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < wanted")
