"""Items that appear together, counted once per distinct basket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palinode.sources.shared import written


def baskets(rows: DataFrame, items: Column) -> DataFrame:
    """``basket`` (sorted distinct items without nulls) and ``weight``, the number of rows that have just this basket.

    Rows whose array is null or empty are no baskets. The rows are combined before they are shuffled, so a basket that
    makes up most of the table travels once per partition.
    """
    return (
        rows.where(F.size(items) > 0)
        .select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("basket"))
        .groupBy("basket")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def pair_counts(rows: DataFrame, items: Column) -> DataFrame:
    """For each unordered pair that occurs: ``item_a`` < ``item_b``, ``together``, ``count_a``, ``count_b``, ``n``, ``lift``, ``conviction``.

    ``n`` counts the rows with a non-empty array, an item counts once per row. ``lift`` is how many times more often than
    by chance the pair occurs; ``conviction`` is that of a -> b, null where a never occurs without b.
    Items are compared as they are: tidy them first. Empty input gives no rows.
    """
    distinct = written(baskets(rows, items), "baskets")  # read three times, made once
    total = distinct.agg(F.sum("weight")).first()[0] or 0
    single = distinct.select(F.explode("basket").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("count"))
    pairs = (
        distinct.where(F.size("basket") > 1)
        .select(F.posexplode("basket").alias("at", "item_a"), "basket", "weight")
        .select("item_a", F.explode(F.expr("slice(basket, at + 2, size(basket))")).alias("item_b"), "weight")
        .groupBy("item_a", "item_b")
        .agg(F.sum("weight").alias("together"))
    )
    n, a, b, both = (F.col(c).cast("double") for c in ("n", "count_a", "count_b", "together"))
    return (
        pairs.join(single.select(F.col("item").alias("item_a"), F.col("count").alias("count_a")), "item_a")
        .join(single.select(F.col("item").alias("item_b"), F.col("count").alias("count_b")), "item_b")
        .withColumn("n", F.lit(total).cast("bigint"))
        .select(
            "item_a", "item_b", "together", "count_a", "count_b", "n",
            (both * n / (a * b)).alias("lift"),
            F.when(a > both, (1 - b / n) / (1 - both / a)).alias("conviction"),
        )
    )


def surprising(pairs: DataFrame, support_percent: int, lift: int) -> DataFrame:
    """Of ``pair_counts`` the pairs in at least ``support_percent`` % of the rows and at least ``lift`` times as often as by chance, in exact arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    common = wide("together") * 100 >= wide("n") * support_percent
    # the two quotients are compared cross-wise with 19 digits each
    narrow = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(common & (narrow("together") * narrow("n") >= F.lit(lift).cast("decimal(2,0)") * narrow("count_a") * narrow("count_b")))
