"""The same operators on streams: intake of facts, current values, windows of recent turns.

Late rows: intake drops repeats of a fact within the watermark; values and windows order by turn, not by arrival, so a late
turn takes its place as long as its episode's state is kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.versions import slot_key


def intake(facts: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """First write of every fact within the watermark."""
    return facts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fact_id"])


def current_values(facts: DataFrame) -> DataFrame:
    """Newest value per slot (update mode); state is one row per slot."""
    live = facts.filter(~F.coalesce("erased", F.lit(False)) & (F.col("observed_turn") >= 0))
    newest = F.max(F.struct("observed_turn", "seq", "fact_id", "value")).alias("m")
    return live.groupBy("episode_id", slot_key(F.col("slot")).alias("slot")).agg(newest).select("episode_id", "slot", F.col("m.value").alias("value"), F.col("m.observed_turn").alias("observed_turn"))


def activity(facts: DataFrame, event_time: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Facts per reason and window of event time (append mode)."""
    return facts.withWatermark(event_time, delay).groupBy(F.window(event_time, width), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "reason", "n")


def recent_turns(turns: DataFrame, most: int = 4) -> DataFrame:
    """The newest ``most`` turns of every episode after each batch (update mode); the state holds just these."""

    def fold(key, frames, state):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for f in frames:
            for turn, ref in zip(f["turn_index"].tolist(), f["reference_id"].tolist(), strict=True):
                held[turn] = max(ref, held.get(turn, ""))
            held = dict(sorted(held.items())[-most:])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"episode_id": [key[0]] * len(held), "turn_index": list(held), "reference_id": list(held.values())})

    known = turns.filter(F.col("turn_index") >= 0).select("episode_id", F.col("turn_index").cast("int").alias("turn_index"), "reference_id")
    return known.groupBy("episode_id").applyInPandasWithState(fold, "episode_id string, turn_index int, reference_id string", "turns array<int>, refs array<string>", "update", GroupStateTimeout.NoTimeout)
