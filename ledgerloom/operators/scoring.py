"""Scoring of probes: metrics per system, breakdowns and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answers_match, candidate_pairs, evidence_class, is_question
from ..plans.scratch import Scratch
from .retrieval import contains_join

TYPES = {"current_fact": "current", "history_fact": "history", "memory_point": "memory_point", "no_history": "no_history"}


def scored(probes: DataFrame) -> DataFrame:
    """Probes with the verdict of the string scorer."""
    return probes.withColumn("matched", answers_match(F.col("prediction"), F.col("gold")))


def metrics(probes: DataFrame) -> DataFrame:
    """Per system: correct and all probes of each type, tool calls, tokens; null counts are not applicable, not 0."""
    kinds = []
    for kind, name in TYPES.items():
        mine = F.col("probe_type") == kind
        kinds += [F.count_if(mine).alias(f"{name}_n"), F.sum(F.when(mine, F.coalesce("correct", F.lit(0))).otherwise(0)).alias(f"{name}_correct")]
    return probes.groupBy("system").agg(
        F.countDistinct("run_id", "episode_id").alias("episodes"),
        F.count(F.lit(1)).alias("probes"),
        *kinds,
        F.sum("tool_attempted").alias("tool_calls"),
        F.sum("tool_resolved").alias("tool_resolved"),
        F.sum("tool_unparsable").alias("tool_unparsable"),
        F.count("context_tokens").alias("context_n"),
        F.sum("context_tokens").alias("context_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def breakdown(probes: DataFrame) -> DataFrame:
    """Counts by system, probe type, judge method and outcome."""
    outcome = F.when(F.col("correct") == 1, "correct").otherwise("wrong")
    return probes.groupBy("system", "probe_type", "judge_method", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def per_episode(probes: DataFrame) -> DataFrame:
    """Correct and all probes per system and episode, one pair of columns per type."""
    cols = []
    for kind, name in TYPES.items():
        mine = F.col("probe_type") == kind
        cols += [F.count_if(mine & (F.col("correct") == 1)).alias(f"{name}_correct"), F.count_if(mine).alias(f"{name}_n")]
    return probes.groupBy("system", "episode_id").agg(*cols)


def gate_signals(signals: DataFrame) -> DataFrame:
    """The signals of the turns with an ordinal."""
    return signals.filter(F.col("turn").isNotNull())


def all_signals(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """Per turn, with an ordinal or without: evidence class, whether it asks, and the candidate values.

    Written once, as every use reads it again; each message is searched once.
    """
    text = F.coalesce("user_msg", F.lit(""))
    found = scratch.cut(raw.select("episode_id", F.col("turn_index").alias("turn"), "reference_id", "user_msg", candidate_pairs(text).alias("pairs")))
    return scratch.cut(found.select("episode_id", "turn", "reference_id", evidence_class(text, F.col("pairs")).alias("kind"), is_question(text).alias("asks"), "pairs"))


def gate(signals: DataFrame) -> DataFrame:
    """Decisions of the levels pattern and strict per turn; with loose and turns without ordinal: ``gate_levels``.

    A value or slot is known if an earlier turn of the episode stated it: the first turn of each, by a map-side minimum.
    """
    each = signals.select("episode_id", "turn", F.explode("pairs").alias("p"))
    first_value = each.groupBy("episode_id", F.col("p.value").alias("value")).agg(F.min("turn").alias("_first"))
    novel = each.select("episode_id", "turn", F.col("p.value").alias("value")).join(first_value, ["episode_id", "value"]).groupBy("episode_id", "turn").agg(F.max(F.col("_first") == F.col("turn")).alias("novel"))
    states = (F.col("kind") == "change") | ((F.col("kind") == "state") & ~F.col("asks"))
    out = signals.join(novel, ["episode_id", "turn"], "left").withColumn("novel", F.coalesce("novel", F.lit(False)))
    strict = F.when(F.col("kind") == "change", F.col("novel") | (F.size("pairs") == 0)).otherwise(F.col("novel") & ~F.col("asks"))
    return out.select("episode_id", "turn", "reference_id", "kind", "asks", states.alias("keep_pattern"), strict.alias("keep_strict"))


def gate_levels(signals: DataFrame, raw: DataFrame) -> DataFrame:
    """Decisions of the levels off, loose, pattern and strict for every turn; off keeps all.

    Loose keeps what pattern keeps, and turns that mention a slot which an earlier turn stated; each slot counts from its first
    turn, and meets the texts on its last characters.  A turn without ordinal makes nothing known to others, and for it is known
    what any turn with an ordinal stated.
    """
    each = signals.select("episode_id", "turn", "reference_id", F.explode("pairs").alias("p")).select("episode_id", "turn", "reference_id", "p.slot", "p.value")
    dated = each.filter(F.col("turn").isNotNull())
    first_value = dated.groupBy("episode_id", "value").agg(F.min("turn").alias("_first"))
    fresh = F.coalesce(F.col("_first") >= F.col("turn"), F.col("_first").isNull())
    novel = each.join(first_value, ["episode_id", "value"], "left").groupBy("episode_id", "turn", "reference_id").agg(F.max(fresh).alias("novel"))
    # what one delivery of a turn states anew is new for the turn
    by_turn = novel.filter(F.col("turn").isNotNull()).groupBy("episode_id", "turn").agg(F.max("novel").alias("_t"))
    by_reference = novel.filter(F.col("turn").isNull()).select("reference_id", F.col("novel").alias("_r"))
    texts = raw.select("reference_id", F.lower(F.coalesce("user_msg", F.lit(""))).alias("text"))
    slots = dated.filter(F.col("slot") != "").groupBy("episode_id", F.col("slot").alias("value")).agg(F.min("turn").alias("_since"))
    spoken = raw.select("episode_id", F.lower("user_msg").alias("text")).distinct()
    known = contains_join(slots, spoken).groupBy("episode_id", "text").agg(F.min("_since").alias("_since"))
    out = signals.join(by_turn, ["episode_id", "turn"], "left").join(by_reference, "reference_id", "left").withColumn("novel", F.coalesce("_t", "_r", F.lit(False)))
    out = out.join(texts, "reference_id").join(known, ["episode_id", "text"], "left")
    states = (F.col("kind") == "change") | ((F.col("kind") == "state") & ~F.col("asks"))
    mentions = F.coalesce(F.col("_since") < F.col("turn"), F.col("_since").isNotNull())
    strict = F.when(F.col("kind") == "change", F.col("novel") | (F.size("pairs") == 0)).otherwise(F.col("novel") & ~F.col("asks"))
    return out.select("episode_id", "turn", "reference_id", "kind", "asks", F.lit(True).alias("keep_off"), states.alias("keep_pattern"), (states | (mentions & ~F.col("asks"))).alias("keep_loose"), strict.alias("keep_strict"))


def confusion(gated: DataFrame, evidence: DataFrame, levels: list[str]) -> DataFrame:
    """(level, tp, fp, fn, tn) of gates against turns that are evidence of a fact (``evidence``: reference_id): all levels in one aggregate."""
    truth = evidence.select("reference_id", F.lit(True).alias("_fact")).distinct()
    both = gated.join(truth, "reference_id", "left").withColumn("_fact", F.coalesce("_fact", F.lit(False)))
    counts = []
    for level in levels:
        k, t = F.col(f"keep_{level}"), F.col("_fact")
        counts.append(F.struct(F.lit(level).alias("level"), F.count_if(k & t).alias("tp"), F.count_if(k & ~t).alias("fp"), F.count_if(~k & t).alias("fn"), F.count_if(~k & ~t).alias("tn")))
    return both.agg(F.array(*counts).alias("c")).select(F.inline("c"))
