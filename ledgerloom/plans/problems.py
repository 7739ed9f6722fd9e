"""Queries p1_... and p4_... : hierarchies and histories of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import versions as V
from .blocks import newest
from .scratch import Scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def summary_links(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """(id, parent) of all summaries; the archived row with the greatest ``ts`` names the parent."""
    archived = table(spark, folder, "archived_summaries").filter(F.col("summary_id").isNotNull())
    counting = newest(archived, ["summary_id"], [F.coalesce("ts", F.lit(float("-inf")))], ["superseded_by"])
    counting = scratch.cut(counting)
    active = table(spark, folder, "active_summaries").select("summary_id")
    ids = counting.select("summary_id").unionByName(active).filter(F.col("summary_id").isNotNull()).distinct().withColumnRenamed("summary_id", "id")
    ids = scratch.cut(ids)
    refs = counting.filter(F.col("superseded_by").isNotNull()).select(F.col("summary_id").alias("owner"), F.col("superseded_by").alias("ref"))
    links = H.resolve_references(refs, ids).select(F.col("owner").alias("id"), F.col("target").alias("parent"))
    return ids.join(links, "id", "left")


def index_links(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """(id, parent) of all index entries; the row with the greatest ``ts`` lists the children."""
    entries = table(spark, folder, "index_entries").filter(F.col("index_id").isNotNull())
    counting = newest(entries, ["index_id"], [F.coalesce("ts", F.lit(float("-inf")))], ["child_index_ids"])
    counting = scratch.cut(counting)
    ids = counting.select(F.col("index_id").alias("id"))
    refs = counting.select(F.col("index_id").alias("owner"), F.explode("child_index_ids").alias("ref")).filter(F.col("ref").isNotNull())
    links = H.resolve_references(refs, ids).groupBy(F.col("target").alias("id")).agg(F.min("owner").alias("parent"))
    return ids.join(links, "id", "left")


def forests(spark: SparkSession, folder: str, paths: bool = True) -> DataFrame:
    """Both forests in one run: ids carry the forest's name, so that they can't meet."""
    scratch = Scratch(spark, "forests")
    tag = lambda df, name: df.select(*[F.concat(F.lit(name + "\t"), c).alias(c) for c in ("id", "parent")])
    links = tag(summary_links(spark, folder, scratch), "summary").unionByName(tag(index_links(spark, folder, scratch), "index"))
    return H.hierarchy(links, scratch, paths)


def _bare(name: str):
    return F.substring_index(name, "\t", -1)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per node of either forest: root and depth, read off its chain and what lies above it."""
    tree = forests(spark, folder, paths=False)
    return tree.select(
        F.substring_index("id", "\t", 1).alias("forest"),
        _bare("id").alias("node_id"),
        _bare("root").alias("root_id"),
        F.col("depth").cast("int").alias("depth"),
    )


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Per node its path as chain segments (own chain first, ``head<=position``) and its descendants as an interval of the tree's order.

    Where no root is reached, the path ends at the cycle, and the order is that of all nodes that run into it; descendants of
    a node on the cycle are all of them.
    """
    tree = forests(spark, folder)
    words = F.transform("segments", lambda s: F.concat(F.substring_index(s["chain"], "\t", -1), F.lit("<="), s["upto"].cast("string")))
    return tree.select(
        F.substring_index("id", "\t", 1).alias("forest"),
        _bare("id").alias("node_id"),
        _bare("root").alias("root_id"),
        F.col("depth").cast("int").alias("depth"),
        F.array_join(words, " ").alias("path"),
        F.col("first").alias("first_order"),
        F.col("end").alias("end_order"),
        (F.col("end") - F.col("first") - 1).alias("descendants"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the stored projection (rank 0) and of the ledger (rank 1); a stored row's record number is its summary's."""
    stored = table(spark, folder, "fact_history")
    number = F.expr("try_cast(regexp_extract(fact_id, '/[a-z]+([0-9]+)(@[^/#]*)?#', 1) as bigint)")
    noted = table(spark, folder, "fact_ledger")
    return V.claims(stored, "valid_from_turn", 0, number).unionByName(V.claims(noted, "observed_turn", 1, F.col("seq")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per version of a slot."""
    return V.versions(observations(spark, folder)).drop("value")


def p4_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim with its recorded period: superseded claims stay."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = V.ledger(observations(spark, folder))
    return out.select("episode_id", "slot", "turn", "rank", "record", "value", text("superseded_rank").alias("superseded_rank"), text("superseded_record").alias("superseded_record"))


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The bitemporal ledger: rows with a valid and a recorded period (-1: open), superseded rows included."""
    rows = V.intervals(observations(spark, folder), Scratch(spark, "intervals"))
    shut = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    ends = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("until_rank", "until_record")]
    return rows.select("episode_id", "slot", "value", F.col("turn").alias("valid_from_turn"), shut("until"), "rank", "record", *ends).withColumnRenamed("until", "valid_to_turn")


def p4_history(spark: SparkSession, folder: str) -> DataFrame:
    """The versions with their values."""
    return V.versions(observations(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p4_found, p4_history, p4_ledger, p4_intervals)}
