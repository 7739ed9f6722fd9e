"""Queries on the fact ledger: current values, histories, registries, conflicts and overrides.

Latest-of-group results are struct aggregates that combine on the map side; orders run in blocks (``plans.blocks``), so that a
slot or episode may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_digits, split_pair
from ..plans.blocks import carried_by_turn, previous_by_turn, previous_in_order
from ..plans.scratch import Scratch

def placed(ledger: DataFrame) -> DataFrame:
    """Facts with a known turn, one per (episode, slot, turn, seq): ties go to the greatest fact id."""
    known = ledger.filter(F.col("observed_turn").isNotNull() & F.col("slot").isNotNull() & F.col("episode_id").isNotNull())
    best = F.max(F.struct("fact_id", "value", "reason", "erased")).alias("b")
    return known.groupBy("episode_id", "slot", "observed_turn", "seq").agg(best).select("episode_id", "slot", "observed_turn", "seq", "b.*")


def current(ledger: DataFrame) -> DataFrame:
    """Newest fact per slot that isn't erased."""
    live = ledger.filter(~F.col("erased") & F.col("observed_turn").isNotNull() & F.col("slot").isNotNull())
    return live.groupBy("episode_id", "slot").agg(F.max(F.struct("observed_turn", "seq", "fact_id", "value")).alias("m")).select("episode_id", "slot", F.col("m.value").alias("value"), F.col("m.fact_id").alias("fact_id"), F.col("m.observed_turn").alias("observed_turn"))


def projection(ledger: DataFrame, as_of: int | None = None) -> DataFrame:
    """Validity periods per slot: each fact until the next one; facts after ``as_of`` are unknown, so the last stays open."""
    rows = placed(ledger)
    rows = rows if as_of is None else rows.filter(F.col("observed_turn") <= as_of)
    rows = rows.withColumn("_to", F.struct("observed_turn", "fact_id"))
    nxt = previous_by_turn(rows, ["episode_id", "slot"], "_to", "_next", lead=True)
    return nxt.select("episode_id", "slot", "value", "fact_id", F.col("observed_turn").alias("valid_from_turn"), F.col("_next.observed_turn").alias("valid_to_turn"), F.col("_next.fact_id").alias("superseded_by"), "reason", "erased")


def anomalies(stored: DataFrame) -> DataFrame:
    """(episode, slot, kind, n): what is wrong with a stored projection.  Repeated rows count once."""
    keys = ["episode_id", "slot"]
    rows = stored.select(*keys, "valid_from_turn", "valid_to_turn", "value", "fact_id", F.coalesce("erased", F.lit(False)).alias("erased")).filter(F.col("valid_from_turn") >= 0).distinct()
    ends = F.max(F.struct("fact_id", "valid_to_turn")).alias("b")
    points = rows.groupBy(*keys, "valid_from_turn").agg(ends, F.count(F.lit(1)).alias("same")).select(*keys, "valid_from_turn", F.col("b.valid_to_turn").alias("valid_to_turn"), "same")
    nxt = previous_in_order(points, keys, "valid_from_turn", "valid_from_turn", "_next", lead=True)
    per_row = nxt.select(
        *keys,
        F.array_compact(
            F.array(
                F.when(F.col("valid_to_turn") < F.col("valid_from_turn"), "ends_before_start"),
                F.when(F.col("valid_to_turn").isNull() & F.col("_next").isNotNull(), "open_before_another"),
                F.when(F.col("valid_to_turn") > F.col("_next"), "overlap"),
                F.when((F.col("valid_to_turn") < F.col("_next")) & (F.col("valid_to_turn") >= F.col("valid_from_turn")), "gap"),
            )
        ).alias("kinds"),
    ).select(*keys, F.explode("kinds").alias("kind"))
    opens = rows.groupBy(*keys).agg(F.count_if(F.col("valid_to_turn").isNull()).alias("open"), F.count_if(F.col("erased") & (F.coalesce("value", F.lit("")) != "")).alias("kept"))
    per_slot = opens.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("open") > 1, "several_open"), F.when(F.col("open") == 0, "none_open"), F.when(F.col("kept") > 0, "erased_with_value")))).alias("kind"))
    return per_row.unionByName(per_slot).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def registry(summaries: DataFrame, most: int = 12) -> DataFrame:
    """Latest value per slot over the fact keys of live summaries, the newest ``most`` slots per episode."""
    pairs = summaries.select("episode_id", "summary_id", "seq", F.explode("fact_keys").alias("key")).select("episode_id", "summary_id", "seq", split_pair(F.col("key")).alias("p")).filter(F.col("p").isNotNull())
    last = pairs.groupBy("episode_id", F.lower("p.slot").alias("slot")).agg(F.max(F.struct("seq", "summary_id", F.col("p.value").alias("value"))).alias("m"))
    # the aggregate leaves one row per slot; the rank keeps the newest slots only (Spark prunes each task to the limit before the shuffle)
    rank = Window.partitionBy("episode_id").orderBy(F.col("m.seq").desc(), F.col("slot").asc())
    return last.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most).select("episode_id", "slot", F.col("m.value").alias("value"), F.col("m.summary_id").alias("summary_id"), F.col("m.seq").alias("seq"))


def rendered_registry(rows: DataFrame) -> DataFrame:
    """The registry as text, oldest first; at most the registry's limit of entries per episode."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "slot", F.concat("slot", F.lit("="), "value").alias("txt"))))
    return rows.groupBy("episode_id").agg(F.array_join(F.transform(listed, lambda s: s["txt"]), "; ").alias("registry"))


def overrides(ledger: DataFrame, scratch: Scratch) -> DataFrame:
    """(episode_id, summary_id, overrider, at_turn): the first later fact that restates one of a summary's slots with another value.

    Later means by (turn, seq).  Equal neighbours form runs, so the overrider of a fact is the start of the run after its own:
    no self-join of a slot with itself.
    """
    base = placed(ledger.filter(~F.col("erased"))).withColumn("key", letters_digits(F.col("value")))
    base = scratch.cut(base.select("episode_id", "slot", "observed_turn", "seq", "fact_id", "key", F.substring_index("fact_id", "#", 1).alias("summary_id")))
    keys = ["episode_id", "slot"]
    seen = previous_by_turn(base, keys, "key", "_before")
    mine = F.struct("observed_turn", "seq", "summary_id")
    starts = seen.filter(F.col("_before").isNull() | (F.col("_before") != F.col("key"))).select(*keys, "observed_turn", "seq", "fact_id", mine.alias("_start"))
    starts = scratch.cut(starts)
    after = previous_by_turn(starts, keys, "_start", "_next", lead=True).select(*keys, "fact_id", "_next")
    # a fact within a run shares the run's successor: carry it forward from the run's start
    fill = carried_by_turn(scratch.cut(base.join(after, [*keys, "fact_id"], "left")), keys, "_next")
    # the last run has none, and what its facts carry lies before them
    per_fact = fill.filter(F.struct("_next.observed_turn", "_next.seq") > F.struct("observed_turn", "seq"))
    return per_fact.groupBy("episode_id", "summary_id").agg(F.min("_next").alias("o")).select("episode_id", "summary_id", F.col("o.summary_id").alias("overrider"), F.col("o.observed_turn").alias("at_turn"))
