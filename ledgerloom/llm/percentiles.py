"""Percentiles of large numeric columns by merging centroid digests, certified by a second count.

A digest is a list of centroids (mean, weight) of sorted values; a centroid spans at most one unit of the size
function ``delta / (2 pi) * asin(2 q - 1)``, so they are fine at the tails.  Digests merge by clustering their
centroids again, in a tree of ``FAN_IN`` digests per task; digests of partitions, runs or days
combine the same way (``digest``, ``merge``).  An estimate is moved to the nearest value of the data, and a pass over all values
counts how many are smaller and how many are not larger: the distance of the wanted rank from that
interval, as a share of the values, is its exact rank error.  While one exceeds ``BOUND``, the digests are built again at twice the size (in the
end every centroid is a single value and the estimate exact).

Values are never shuffled by group: the estimates, one row per group, go to them.  Groups with more than their share of ``GROUPS`` are
broadcast (there can be no more than ``GROUPS`` of them); only the small groups beyond are joined by key.  A task holds at most about ``BUFFER`` values, whatever the number of groups.

Defined results: null, NaN, infinite and negative values are not measured and don't count; a group without measured
values gives no row; ties count each; keys that repeat count once (the row greatest in its values); an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

DELTA, FAN_IN, BUFFER, BOUND, GROUPS = 400, 64, 500_000, 0.005, 20_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def cluster(mean: np.ndarray, weight: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted weighted values: neighbours whose middle falls into the same unit of the size function."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    total = weight.sum()
    middle = (np.cumsum(weight) - weight / 2) / total
    unit = np.floor(delta / (2 * math.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    start = np.flatnonzero(np.concatenate([[True], np.diff(unit) != 0]))
    heavy = np.add.reduceat(weight, start)
    return np.add.reduceat(mean * weight, start) / heavy, heavy


def estimate(mean: np.ndarray, weight: np.ndarray, q: float) -> float:
    """Value at rank ``q``, linear between the middles of centroids."""
    middle = np.cumsum(weight) - weight / 2
    return float(np.interp(q * weight.sum(), middle, mean))


def _digest_rows(keys: list[str], group: tuple, part, parts: list) -> pd.DataFrame:
    mean, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({**{k: [v] * len(mean) for k, v in zip(keys, group, strict=True)}, "part": part, "mean": mean, "weight": weight})


def digest(values: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """``(keys, part, mean, weight)``: digests per group and partition of ``values`` (keys, value); no shuffle.

    When a task's buffers are full, they are clustered; if its groups are too many for that to help, their digests leave and the task goes on.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}
        count = 0
        for batch in batches:
            for group, rows in batch.groupby(keys, sort=False):
                held.setdefault(group, []).append((rows["mean"].to_numpy(dtype=float), np.ones(len(rows))))
            count += len(batch)
            if count > BUFFER:
                held = {g: [cluster(*(np.concatenate(x) for x in zip(*parts, strict=True)), delta)] for g, parts in held.items()}
                count = sum(len(parts[0][0]) for parts in held.values())
                if count > BUFFER // 2:
                    for group, parts in held.items():
                        yield _digest_rows(keys, group, part, parts)
                    held, count = {}, 0
        for group, parts in held.items():
            yield _digest_rows(keys, group, part, [cluster(*(np.concatenate(x) for x in zip(*parts, strict=True)), delta)])

    ones = values.select(*keys, F.col("value").cast("double").alias("mean"))
    return ones.mapInPandas(run, _schema(values, keys))


def _by_group(batches, names: list[str]):
    """(group, frames) of rows that come sorted by ``names``; a group may go on in the next batch."""
    key, frames = None, []
    for batch in batches:
        for mine, rows in batch.groupby(names, sort=False):
            if mine != key:
                if frames:
                    yield key, frames
                key, frames = mine, []
            frames.append(rows)
    if frames:
        yield key, frames


def merge(digests: DataFrame, keys: list[str], parts: int, delta: int = DELTA) -> DataFrame:
    """One digest per group from ``parts`` numbered ones, in a tree of ``FAN_IN`` digests of a group at a time; a task holds one group."""
    names = [*keys, "part"]

    def run(batches):
        for group, frames in _by_group(batches, names):
            rows = pd.concat(frames) if len(frames) > 1 else frames[0]
            yield _digest_rows(keys, group[:-1], group[-1], [cluster(rows["mean"].to_numpy(dtype=float), rows["weight"].to_numpy(dtype=float), delta)])

    schema = _schema(digests, keys)
    while True:
        parts = max(1, -(-parts // FAN_IN))
        met = digests.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int") if parts > 1 else F.lit(0)).repartition(*names).sortWithinPartitions(*names)
        digests = met.mapInPandas(run, schema)
        if parts == 1:
            return digests


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", part int, mean double, weight double"


def measured(rows: DataFrame, keys: list[str], group: list[str], metrics: list[str]) -> DataFrame:
    """``(group, metric, value)``: measured values, every key once."""
    once = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(m).cast("double").alias(m) for m in metrics])).alias("m"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m.{m}").alias("value")) for m in metrics])
    long = once.select(*group, F.explode(pairs).alias("p")).select(*group, "p.metric", "p.value")
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf"))
    for g in group:
        good = good & F.col(g).isNotNull()
    return long.filter(good)


def percentiles(values: DataFrame, keys: list[str], scratch: Scratch, quantiles=QUANTILES, bound: float = BOUND, delta: int = DELTA) -> DataFrame:
    """``(keys, quantile, estimate, n, below, upto, error)`` with certified rank errors.

    ``values`` has the keys and ``value``; the estimates are one row per group.
    """
    values = scratch.cut(values)
    tasks = max(1, values.rdd.getNumPartitions())
    while True:
        guesses = scratch.cut(_estimates(merge(digest(values, keys, delta), keys, tasks, delta), keys, quantiles))
        certified = scratch.cut(_certify(values, guesses, keys, len(quantiles)))
        if not certified.filter(F.col("error") > bound).limit(1).count():
            return certified
        scratch.drop(guesses, certified)
        delta *= 2


def _estimates(merged: DataFrame, keys: list[str], quantiles) -> DataFrame:
    def run(batches):
        for group, frames in _by_group(batches, keys):
            rows = pd.concat(frames).sort_values("mean")
            mean, weight = rows["mean"].to_numpy(), rows["weight"].to_numpy()
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, group, strict=True)}, "guess": [[estimate(mean, weight, q) for q in quantiles]], "q": [list(quantiles)], "size": [int(round(weight.sum()))]})

    kinds = dict(merged.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", guess array<double>, q array<double>, size bigint"
    return merged.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _beside(values: DataFrame, groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Values with their group's row.  Groups of ``least`` values or more go to the values; there are at most ``GROUPS`` of those."""
    near = values.join(F.broadcast(groups.filter(F.col("size") >= least)), keys)
    return near if least <= 1 else near.unionByName(values.join(groups.filter(F.col("size") < least).hint("merge"), keys))


def _certify(values: DataFrame, guesses: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Two counting passes: the nearest values of the data, then their exact rank intervals."""
    total = guesses.agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("values")).first()
    least = 1 if total.groups <= GROUPS else -(-total["values"] // GROUPS)
    v = F.col("value")
    joined = _beside(values, guesses, keys, least)
    spots = []
    for i in range(count):
        g = F.col("guess")[i]
        spots += [F.count(F.when(v < g, 1)).alias(f"c{i}"), F.min(F.when(v >= g, v)).alias(f"hi{i}"), F.max(F.when(v < g, v)).alias(f"lo{i}")]
    near = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.first("size").alias("size"), *spots)
    # ranks up to the count belong to the value below the guess, others to that at or above it
    picks = [F.coalesce(F.when(F.col("q")[i] * F.col("n") < F.col(f"c{i}"), F.col(f"lo{i}")), F.col(f"hi{i}"), F.col(f"lo{i}")) for i in range(count)]
    snapped = near.select(*keys, "n", "q", "size", F.array(*picks).alias("pick"))
    joined = _beside(values, snapped, keys, least)
    ranks = [F.struct(F.count(F.when(v < F.col("pick")[i], 1)).alias("below"), F.count(F.when(v <= F.col("pick")[i], 1)).alias("upto")).alias(f"r{i}") for i in range(count)]
    counted = joined.groupBy(*keys).agg(F.first("n").alias("n"), F.first("q").alias("q"), F.first("pick").alias("pick"), *ranks)
    each = F.explode(F.arrays_zip(F.col("q"), F.col("pick"), F.array(*[f"r{i}" for i in range(count)]).alias("r")))
    long = counted.select(*keys, "n", each.alias("e")).select(*keys, F.col("e.q").alias("quantile"), F.col("e.pick").alias("estimate"), "n", F.col("e.r.below").alias("below"), F.col("e.r.upto").alias("upto"))
    rank = F.col("quantile") * F.col("n")
    miss = F.greatest(F.lit(0.0), F.col("below") - rank, rank - F.col("upto"))
    return long.withColumn("error", miss / F.col("n"))
