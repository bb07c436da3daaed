"""Percentiles per group from mergeable compactor sketches, and their exact values by a bracketed second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palinode.sources.shared import written

K = 400
#: Rank error that a sketch of size K exceeds about once in a thousand million answers (its standard deviation is about 1 / K).
SIX_SIGMA = 6.5 / K
BROADCAST_ROWS = 200_000


def _kind(rows: DataFrame) -> str:
    """``float`` if single precision holds every value of the column, else ``double``."""
    return "float" if dict(rows.dtypes)["value"] in ("float", "smallint", "tinyint") else "double"


def _kll(what: str, kind: str, *args: object) -> Column:
    return getattr(F, f"kll_{what}_{kind}")(*args)


def sketches(rows: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One compactor hierarchy per group of ``by`` over ``value``: ``by``, ``n``, ``sketch``, in single precision where that holds every value.

    Built with partial aggregation, so a group of any size sends one sketch of bounded size per partition. Null and NaN
    values are left out; groups without a value give no row.
    """
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _kll("sketch_agg", _kind(rows), F.col("value").cast(_kind(rows)), F.lit(k)).alias("sketch"))


def merge(parts: DataFrame, by: list[str], kind: str = "float") -> DataFrame:
    """Sketches of days, partitions or files combined to the coarser groups ``by``, level by level; ``kind`` is their precision, float or double."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), _kll("merge_agg", kind, "sketch").alias("sketch"))


def approximate(parts: DataFrame, percents: list[int], kind: str = "float") -> DataFrame:
    """For each sketch and percent: ``pct``, ``value`` and the bracket ``low``, ``high`` around it that holds the true value but for a chance of about 1e-9."""
    ask = lambda at: _kll("sketch_get_quantile", kind, "sketch", F.lit(min(max(at, 0.0), 1.0)))
    answers = [
        F.struct(F.lit(p).alias("pct"), ask(p / 100).alias("value"), ask(p / 100 - SIX_SIGMA).alias("low"), ask(p / 100 + SIX_SIGMA).alias("high"))
        for p in percents
    ]
    return parts.withColumn("answer", F.explode(F.array(*answers))).select("*", "answer.*").drop("answer", "sketch")


def _ranked(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """The value at its rank, found in the rows of the bracket; ``ok`` is false where the bracket misses it."""
    joined = rows.join(brackets, by)
    below = F.count(F.when(F.col("v") < F.col("low"), 1))
    key = [*by, "pct", "n"]
    # only values inside the bracket stay apart, all others of a group come together in one row
    inside = F.when(F.col("v").between(F.col("low"), F.col("high")), F.col("v"))
    hist = joined.groupBy(*key, inside.alias("v")).agg(F.count(F.lit(1)).alias("m"), below.alias("below"))
    order = Window.partitionBy(*key).orderBy(F.col("v").asc_nulls_first())
    upto = hist.withColumn("sum", F.sum(F.when(F.col("v").isNull(), F.col("below")).otherwise(F.col("m"))).over(order))
    # ceil(pct * n / 100) in whole numbers
    rank = F.expr("(pct * n + 99) div 100")
    return upto.groupBy(*key).agg(
        F.min(F.when(F.col("v").isNotNull() & (F.col("sum") >= rank), F.col("v"))).alias("value"),
        F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("below"))), F.lit(0)).alias("under"),
    ).withColumn("ok", F.col("value").isNotNull() & (F.col("under") < rank))


def percentiles(rows: DataFrame, by: list[str], percents: list[int], k: int = K) -> DataFrame:
    """``by``, ``pct``, ``n``, ``value``: the least value such that at least ``pct`` % of the group's values are at most it.

    Sketches bracket every percentile; a second look at the rows counts those below the bracket and ranks those
    within it, a few per cent of each group. Should a bracket miss, that group's is opened fully and looked at again.
    The brackets are broadcast only up to ``BROADCAST_ROWS`` groups. Null and NaN values are left out, groups of nulls are groups.
    """
    kind = _kind(rows)
    tidy = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in by]
    rows = rows.select(*tidy, F.col("value").cast(kind).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    marks = written(approximate(sketches(rows, by, k), percents, kind), "brackets").drop("value")
    plain = rows.withColumnRenamed("value", "v")
    small = marks.count() <= BROADCAST_ROWS * len(percents)
    first = written(_ranked(plain, F.broadcast(marks) if small else marks, by), "ranked")
    missed = first.where(~F.col("ok")).select(*by, "pct", "n", F.lit(float("-inf")).cast(kind).alias("low"), F.lit(float("inf")).cast(kind).alias("high"))
    result = first.where("ok")
    if not missed.isEmpty():
        result = result.unionByName(_ranked(plain, missed, by))
    back = [F.when(F.col(c) != "\x00", F.col(c)).alias(c) for c in by]
    return result.select(*back, F.col("pct").cast("int").alias("pct"), "n", "value")
