"""The most frequent keys of a column with a majority-vote sketch of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.sources.shared import written

DEPTH = 4
WIDTH = 4096
MAX_WIDTH = 1 << 20
#: Tasks that vote at most (larger inputs are read in more rows each), tasks whose cells are merged at once, and rows up to which bounds are broadcast.
MAX_TASKS, FAN, BROADCAST_ROWS = 8192, 256, 200_000
_U = np.uint64

CELLS = "row int, cell int, total bigint, candidate bigint, surplus bigint"


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h.view(np.uint64) ^ _U(0x9E3779B97F4A7C15 * (row + 1) & (2**64 - 1))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return ((x >> _U(32)) % _U(width)).astype(np.int64)


def _vote(total: np.ndarray, cand: np.ndarray, surplus: np.ndarray, at: np.ndarray, h: np.ndarray, votes: np.ndarray, sums: np.ndarray) -> None:
    """Merge other cells (at, h, votes, sums) into the arrays; each cell at most once in ``at``. The lesser vote is cancelled."""
    total[at] += sums
    same = cand[at] == h
    left = np.where(same, surplus[at] + votes, surplus[at] - votes)
    turned = left < 0
    cand[at[turned]] = h[turned]
    surplus[at] = np.abs(left)


def _rounds(cells: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in rounds in which no cell occurs twice; within a cell in the given order."""
    sorted_ = order[np.argsort(cells[order], kind="stable")]
    c = cells[sorted_]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    nth = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    by = np.argsort(nth, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(nth))]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield sorted_[by[a:b]]


def sketch(keys: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """The merged sketch of ``keys`` (``h``, a 64-bit hash): ``depth`` x ``width`` cells at most, whatever the input.

    Each task votes its rows into one array of cells, and there are at most ``MAX_TASKS``; the arrays are merged cell by cell in a tree,
    ``FAN`` tasks at a time. Rows with a null hash don't vote.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cand, surplus = (np.zeros((depth, width), np.int64) for _ in range(3))
        for pdf in frames:
            h, n = np.unique(pdf["h"].to_numpy(), return_counts=True)
            for row in range(depth):
                cells = _cells(h, row, width)
                for some in _rounds(cells, np.argsort(-n, kind="stable")):
                    _vote(total[row], cand[row], surplus[row], cells[some], h[some], n[some], n[some])
        r, c = np.nonzero(total)
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"task": np.int32(task), "row": r.astype(np.int32), "cell": c.astype(np.int32), "total": total[r, c], "candidate": cand[r, c], "surplus": surplus[r, c]})

    def merged(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # a group has 64 cells a row of the sketch of at most FAN tasks
        pdf = pdf.sort_values(["row", "cell", "candidate", "surplus"], ignore_index=True)
        place = (pdf["row"].to_numpy(np.int64) << 32) | pdf["cell"].to_numpy(np.int64)
        places, cells = np.unique(place, return_inverse=True)
        total, cand, surplus = (np.zeros(len(places), np.int64) for _ in range(3))
        h, votes, sums = (pdf[c].to_numpy() for c in ("candidate", "surplus", "total"))
        for some in _rounds(cells, np.arange(len(cells))):
            _vote(total, cand, surplus, cells[some], h[some], votes[some], sums[some])
        return pd.DataFrame({"task": np.int32(group[0]), "row": (places >> 32).astype(np.int32), "cell": (places & 0xFFFFFFFF).astype(np.int32), "total": total, "candidate": cand, "surplus": surplus})

    own = written(keys.select("h").where("h is not null").coalesce(MAX_TASKS).mapInPandas(local, f"task int, {CELLS}"), "votes")
    tasks = (own.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN:  # the arrays of FAN tasks at a time
        tasks = -(-tasks // FAN)
        level = own.groupBy(F.floor(F.col("task") / FAN).cast("int").alias("task"), F.shiftright("cell", 6).alias("part"))
        own = written(level.applyInPandas(merged, f"task int, {CELLS}"), "votes")
    return own.groupBy(F.lit(0).alias("task"), F.shiftright("cell", 6).alias("part")).applyInPandas(merged, f"task int, {CELLS}").drop("task")


def candidates(cells: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> tuple[pd.DataFrame, int]:
    """The candidates with ``lower`` and ``upper`` bounds of their counts, and the most that any other key can have.

    A cell's surplus is a lower bound for its candidate, half of total and surplus an upper one; any other key of the cell has
    at most half of their difference. Takes depth x width cells to the driver, a bound that doesn't grow with the data.
    """
    pdf = cells.toPandas()
    if pdf.empty:
        return pd.DataFrame({"h": [], "lower": [], "upper": []}, dtype=np.int64), 0
    total, cand, surplus = (np.zeros((depth, width), np.int64) for _ in range(3))
    r, c = pdf["row"].to_numpy(), pdf["cell"].to_numpy()
    total[r, c], cand[r, c], surplus[r, c] = pdf["total"], pdf["candidate"], pdf["surplus"]
    h = np.unique(pdf["candidate"].to_numpy())
    lower, upper = np.zeros(len(h), np.int64), np.full(len(h), np.iinfo(np.int64).max)
    for row in range(depth):
        at = _cells(h, row, width)
        mine = cand[row, at] == h
        lower = np.maximum(lower, np.where(mine, surplus[row, at], 0))
        upper = np.minimum(upper, np.where(mine, total[row, at] + surplus[row, at], total[row, at] - surplus[row, at]) // 2)
    other = int(((total - surplus) // 2).max(axis=1).min())
    return pd.DataFrame({"h": h, "lower": lower, "upper": upper}), other


def most_frequent(keys: DataFrame, k: int, depth: int = DEPTH, width: int = WIDTH, max_width: int = MAX_WIDTH) -> DataFrame:
    """The ``k`` most frequent of ``keys`` (``key``): ``key``, ``n``, ``lower``, ``upper``, ``other``; equal counts by key, the least first.

    The sketch yields candidates with bounds; those that can be among the k are counted exactly. ``other`` is the most that any key without
    a row here and not counted can have: rows with more than that are surely right. If a key that is no candidate might be among the k the sketch
    is made again, as much wider as its bounds say, up to ``max_width``; memory stays bounded, so where all keys are about equally frequent, rows with
    ``n`` <= ``other`` are frequent keys, but perhaps not the most frequent. Null keys don't count; fewer than k distinct keys give fewer rows.
    """
    hashed = keys.select("key").where("key is not null").withColumn("h", F.xxhash64("key"))
    while True:
        found, other = candidates(sketch(hashed, depth, width), depth, width)
        floor = int(found["lower"].nlargest(k).min()) if len(found) >= k else 0
        if other < floor or other == 0 or width >= max_width:
            break
        # what strangers can have falls as the width grows
        need = 8 if not floor else min(max_width // width, 2 * (other // floor + 1))
        width = min(max_width, width * (1 << (need - 1).bit_length()))
    near = found[found["upper"] >= floor]
    bounds = keys.sparkSession.createDataFrame(near, "h bigint, lower bigint, upper bigint")  # at most depth x width rows
    counts = hashed.join(F.broadcast(bounds) if len(near) <= BROADCAST_ROWS else bounds, "h").groupBy("key", "lower", "upper").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("key", "n", "lower", "upper", F.lit(other).cast("bigint").alias("other")).orderBy(F.desc("n"), "key").limit(k)
