"""Result tables and run bookkeeping: CSV with any columns, JSON logs, progress and resume.

Writers replace or append whole Parquet or text tables; appends that must not repeat a key filter what is already there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import newest


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV with header; a byte order mark is no part of the first name, empty cells are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_results(frames: list[DataFrame], path: str) -> None:
    """One CSV table of all frames, with every column that any of them has."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, keys: list[str], order: str | None = None) -> int:
    """First write wins: append the rows whose key the table doesn't hold yet; returns how many.

    Of rows with one key the one with the least ``order`` counts, ties (and all without ``order``) by content.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*([F.col(order).alias("_order")] if order else []), *rest, F.lit(1).alias("_one"))).alias("_r")
    fresh = df.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: the row with the greatest ``order`` per key of both tables."""
    keep = [c for c in stored.columns if c not in {*keys, order}]
    both = stored.unionByName(fresh)
    return newest(both, keys, [F.col(order)], [order, *keep])


BUCKETS = 256


def replace_episodes(df: DataFrame, path: str, scratch) -> None:
    """Replace the rows of the episodes that ``df`` has.  The table lies in ``BUCKETS`` folders by a hash of the episode; only theirs are written anew."""
    spark = df.sparkSession
    fresh = scratch.cut(df.withColumn("bucket", F.pmod(F.xxhash64("episode_id"), F.lit(BUCKETS)).cast("int")))
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        kept = stored.filter(F.col("bucket").isin(touched)).join(fresh.select("episode_id").distinct(), "episode_id", "left_anti")
        fresh = scratch.cut(fresh.unionByName(kept.select(*fresh.columns)))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def purge(spark: SparkSession, paths: list[str], episodes: DataFrame) -> None:
    """Physically rewrite tables without the given episodes: erased bytes leave the files.

    A table is written whole beside the old one, which then gives way: a run that dies leaves the old table or the new one, and can be run again.
    """
    gone = episodes.select("episode_id").distinct()
    for path in paths:
        fs, named = _files(spark, path)
        old, new = named(path + ".old"), named(path + ".new")
        if not fs.exists(named(path)) and fs.exists(new):  # an earlier run died between the two renames
            fs.rename(new, named(path))
        spark.read.parquet(path).join(gone, "episode_id", "left_anti").write.mode("overwrite").parquet(path + ".new")
        fs.delete(old, True)
        fs.rename(named(path), old)
        fs.rename(new, named(path))
        fs.delete(old, True)


def pending(work: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """What remains to do: work without a ``done`` row; a later ``failed`` row doesn't undo it."""
    return work.join(progress.filter(F.col("status") == "done").select(*keys).distinct(), keys, "left_anti")


def payloads(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as (keys, payload): the whole row as JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("payload"))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


def _exists(spark: SparkSession, path: str) -> bool:
    fs, named = _files(spark, path)
    return fs.exists(named(path))
