"""Has this key been seen before: sealed batches of keys in ribbon filters, probed generation by generation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.llm import ribbon
from palinode.sources.shared import written

GENERATIONS = 16
#: Records of a generation are equally many to about one in so many of all.
CUT_ACCURACY = 1000
SHARD_ROWS = 120_000
#: The generation of the keys that were there before the first record.
BEFORE = -1

FILTER_SCHEMA = "gen int, shard int, n_keys bigint, filter binary"


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(11), "key")})


def _shard(shards: int) -> F.Column:
    return F.pmod(F.shiftrightunsigned("h1", 7), F.lit(shards)).cast("int").alias("shard")


def seal(keys: DataFrame, bits: int) -> DataFrame:
    """Filters, one per ``gen`` and ``shard``, of the hashed keys (``gen``, ``shard``, ``h1``, ``h2``). ``bits`` is 8, 16 or 32."""

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blob = ribbon.build(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), bits)
        return pd.DataFrame({"gen": [group[0]], "shard": [group[1]], "n_keys": [len(pdf)], "filter": [blob]})

    return keys.select("gen", "shard", "h1", "h2").groupBy("gen", "shard").applyInPandas(one, FILTER_SCHEMA)


def unseen(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """Of the keys (``gen``, ``shard``, ``h1``, ``h2``, ``id``) the ``id`` of those in no filter of an earlier generation."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gen, h1, h2 = left["gen"].to_numpy(), left["h1"].to_numpy(), left["h2"].to_numpy()
        met = np.zeros(len(left), bool)
        for g, blob in zip(right["gen"], right["filter"], strict=True):
            later = np.flatnonzero((gen > g) & ~met)
            if len(later):
                met[later] = ribbon.probe(blob, h1[later], h2[later])
        return pd.DataFrame({"id": left["id"].to_numpy()[~met]})

    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(one, "id bigint")


class SeenBefore:
    """Whether the key of a record occurred in ``before`` or in an earlier record.

    ``records``: ``id`` (bigint, unique), ``key`` (binary or string) and ``us`` (instant in microseconds); ``before``: ``key``.
    Records are earlier by ``us``, then ``id``; without an instant a record is later than all that have one. Records
    without a key are neither seen nor do they make others seen; records without an id are left out. Other columns are
    ignored. Empty tables give empty answers.

    Time is cut into ``generations`` of about equally many records, whatever single instants are far off; each is one sealed batch. Within a batch only the first record
    of each key can be new, which a grouping finds exactly; rows of one key are combined before the shuffle, so a key
    with a third of all records is one row per partition. Those first records are probed in the filters of all earlier
    batches, shard by shard; a shard holds about ``SHARD_ROWS`` keys whatever the input. Answers "new" are always right;
    "seen" is wrong with a probability of at most generations x 2**-bits.
    """

    def __init__(self, records: DataFrame, before: DataFrame, bits: int = 32, generations: int = GENERATIONS) -> None:
        self.bits, self.generations = bits, generations
        self.records = records.select("id", "key", "us").where("key is not null and id is not null")
        shares = [F.lit(k / generations) for k in range(1, generations)]
        cuts, n = self.records.agg(F.percentile_approx("us", F.array(*shares), F.lit(CUT_ACCURACY)), F.count(F.lit(1))).first()
        # instants are dealt to generations by how many cuts they are beyond, so equal ones stay together
        beyond = reduce(lambda a, c: a + F.when(F.col("us") > c, 1).otherwise(0), sorted(set(cuts or ())), F.lit(0))
        gen = F.when(F.col("us").isNull(), generations).otherwise(beyond).cast("int")
        self.shards = max(1, -(-n // SHARD_ROWS))
        at = F.struct(F.col("us").isNull().alias("late"), "us", "id")
        firsts = self.records.groupBy("key", gen.alias("gen")).agg(F.min(at).alias("at"))
        firsts = _hashed(firsts).select("gen", _shard(self.shards), "h1", "h2", F.col("at.id").alias("id"))
        self.firsts = written(firsts, "seen-keys")
        old = _hashed(before.select("key").where("key is not null").distinct()).select(F.lit(BEFORE).alias("gen"), _shard(self.shards), "h1", "h2")
        self.filters = written(seal(self.firsts.drop("id").unionByName(old), bits), "seen-filters")

    def new(self) -> DataFrame:
        """``id`` of the records whose key was not seen before."""
        return unseen(self.firsts, self.filters)

    def seen(self) -> DataFrame:
        """``id`` of the records whose key was seen before."""
        return self.records.select("id").join(self.new(), "id", "left_anti")

    def audit(self, probes: int = 50_000) -> DataFrame:
        """Per generation: ``gen``, ``n_keys``, ``bits_per_key``, ``probes`` with keys that are absent, ``wrong`` answers, ``wrong_rate``, ``expected_rate``,
        and per answer that asks this and all earlier generations ``answers_wrong``, ``answer_rate``, ``expected_answer_rate``.

        The absent keys are texts with a prefix that no digest has, about ``probes`` a shard; they are hashed and dealt to shards as all keys.
        """
        n, bits, gens = probes * self.shards, self.bits, range(BEFORE, self.generations + 1)
        absent = self.records.sparkSession.range(n).select(F.concat(F.lit("absent "), "id").cast(dict(self.records.dtypes)["key"]).alias("key"))
        absent = _hashed(absent).select(_shard(self.shards), "h1", "h2")

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = left["h1"].to_numpy(), left["h2"].to_numpy()
            filters = {g: (k, blob) for g, k, blob in zip(right["gen"], right["n_keys"], right["filter"], strict=True)}
            met, rows = np.zeros(len(left), bool), []
            for g in gens:
                keys, blob = filters.get(g, (0, b""))
                hit = ribbon.probe(blob, h1, h2) if blob else np.zeros(len(left), bool)
                met |= hit
                rows.append((g, keys, len(blob), len(left), int(hit.sum()), int(met.sum())))
            return pd.DataFrame(rows, columns=["gen", "n_keys", "bytes", "probes", "wrong", "answers_wrong"])

        schema = "gen int, n_keys bigint, bytes bigint, probes bigint, wrong bigint, answers_wrong bigint"
        each = absent.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(one, schema)
        sums = each.groupBy("gen").agg(*[F.sum(c).alias(c) for c in ("n_keys", "bytes", "probes", "wrong", "answers_wrong")])
        sums = sums.where("n_keys > 0")
        return sums.select(
            "gen", "n_keys", (8.0 * F.col("bytes") / F.col("n_keys")).alias("bits_per_key"), "probes", "wrong",
            (F.col("wrong") / F.col("probes")).alias("wrong_rate"), F.lit(2.0**-bits).alias("expected_rate"), "answers_wrong",
            (F.col("answers_wrong") / F.col("probes")).alias("answer_rate"), ((F.col("gen") - BEFORE + 1) * 2.0**-bits).alias("expected_answer_rate"),
        )
