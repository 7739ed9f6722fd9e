"""The stored tables with one row per key: upserts and first-write-wins appends as aggregates.

Every function ignores extra columns, drops rows with a null key and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.blocks import newest
from .versions import slot_key


def _ts():
    return [F.coalesce(F.nanvl("ts", F.lit(float("-inf"))), F.lit(float("-inf")))]


def raw_turns(rows: DataFrame) -> DataFrame:
    """Newest delivery of every raw record; episodes without outer blanks, unset ordinals null."""
    keep = ["episode_id", "turn_index", "user_msg", "agent_msg", "ts"]
    one = newest(rows.filter(F.col("reference_id").isNotNull()), ["reference_id"], _ts(), keep)
    return one.withColumn("episode_id", strip(F.col("episode_id"))).withColumn("turn_index", F.when(F.col("turn_index") >= 0, F.col("turn_index")))


def archived(rows: DataFrame) -> DataFrame:
    """Newest version of every archived summary."""
    keep = ["episode_id", "seq", "text", "override_ids", "ts", "raw_ref_id", "is_overridden", "superseded_by", "archive_reason", "origin", "fact_keys"]
    return newest(rows.filter(F.col("summary_id").isNotNull()), ["summary_id"], _ts(), keep)


def active(rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Active summaries, each once; those that are archived as well (``gone``) are no longer active."""
    keep = ["episode_id", "seq", "text", "override_ids", "ts", "raw_ref_id", "origin", "fact_keys", "index_id"]
    one = newest(rows.filter(F.col("summary_id").isNotNull()), ["summary_id"], _ts(), keep)
    return one if gone is None else one.join(gone.select("summary_id"), "summary_id", "left_anti")


def index_entries(rows: DataFrame) -> DataFrame:
    """Newest version of every index entry."""
    keep = ["episode_id", "seq", "title", "members", "turn_start", "turn_end", "span_start", "span_end", "child_index_ids", "ts"]
    return newest(rows.filter(F.col("index_id").isNotNull()), ["index_id"], _ts(), keep)


def ledger(rows: DataFrame) -> DataFrame:
    """First write of every fact: least (seq, turn, value); slots normalised, unset turns null, erased facts without value."""
    first = F.min(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "observed_turn", "value", "episode_id", "summary_id", "slot", "evidence", "reason", "superseded_by", "residual_mentions", "erased"))
    one = rows.filter(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(first.alias("r")).select("fact_id", "r.*")
    return one.select(
        "fact_id",
        "episode_id",
        "summary_id",
        slot_key(F.col("slot")).alias("slot"),
        "value",
        "seq",
        F.when(F.col("observed_turn") >= 0, F.col("observed_turn")).alias("observed_turn"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("residual_mentions", F.lit(0)).alias("residual_mentions"),
        F.coalesce("erased", F.lit(False)).alias("erased"),
    )


def probes(rows: DataFrame) -> DataFrame:
    """Every probe once."""
    keys = ["run_id", "system", "episode_id", "probe_index"]
    keep = ["probe_type", "fact_key", "question", "gold", "prediction", "correct", "judge_method", "judge_reason", "tool_attempted", "tool_resolved", "tool_unparsable", "context_tokens", "answer_chars", "error"]
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return newest(known, keys, [F.lit(0)], keep)
