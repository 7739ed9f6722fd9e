"""Integrity of the records, for all episodes at once: five invariants, their report and the batch summary.

I1 every fact's summary exists; I2 every current value is visible; I3 evidence resolves; I4 what was said was
recorded; I5 erasures took effect.  Each check is a join of whole tables and one aggregate per episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_digits, value_matches
from .facts import current
from .retrieval import contains_join


def lost_facts(ledger: DataFrame, summaries: DataFrame) -> DataFrame:
    """I1: facts whose summary is neither active nor archived."""
    return ledger.join(summaries.select("summary_id").distinct(), "summary_id", "left_anti").select("episode_id", "fact_id", "summary_id")


def unresolved_evidence(ledger: DataFrame, raw: DataFrame) -> DataFrame:
    """I3: (episode, fact, missing) of facts that aren't erased, with no evidence or pointers that lead nowhere (``missing`` of them)."""
    live = ledger.filter(~F.col("erased"))
    refs = live.select("episode_id", "fact_id", F.explode("evidence").alias("reference_id"))
    lost = refs.join(raw.select("reference_id"), "reference_id", "left_anti").groupBy("episode_id", "fact_id").agg(F.count(F.lit(1)).alias("missing"))
    bare = live.filter(F.size("evidence") == 0).select("episode_id", "fact_id", F.lit(0).cast("bigint").alias("missing"))
    return lost.unionByName(bare)


def failed_erasures(ledger: DataFrame, raw: DataFrame) -> DataFrame:
    """I5: (episode, fact, problem) of erased facts that keep a value or evidence that no surviving fact needs."""
    gone = ledger.filter("erased")
    needed = ledger.filter(~F.col("erased")).select(F.explode("evidence").alias("reference_id")).distinct()
    refs = gone.select("episode_id", "fact_id", F.explode("evidence").alias("reference_id")).join(needed, "reference_id", "left_anti")
    there = refs.join(raw.select("reference_id"), "reference_id", "left_semi").select("episode_id", "fact_id", F.lit("evidence_resolves").alias("problem")).distinct()
    kept = gone.filter(F.coalesce("value", F.lit("")) != "").select("episode_id", "fact_id", F.lit("value_kept").alias("problem"))
    return kept.unionByName(there)


def visible_text(summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """(episode, text): what an answering model is shown, as separate texts: unfiled summaries, index titles, registry entries."""
    filed = entries.select(F.explode("members").alias("summary_id")).distinct()
    chain = summaries.join(filed, "summary_id", "left_anti").select("episode_id", "text")
    titles = entries.select("episode_id", F.col("title").alias("text"))
    facts = summaries.select("episode_id", F.explode("fact_keys").alias("text"))
    return chain.unionByName(titles).unionByName(facts).filter(F.col("text").isNotNull())


def unreachable_values(ledger: DataFrame, shown: DataFrame) -> DataFrame:
    """I2: current values that stand in none of the shown texts of their episode."""
    now = current(ledger).filter(F.coalesce("value", F.lit("")) != "")
    hit = contains_join(now.select("episode_id", "fact_id", "value"), shown.distinct()).select("fact_id").distinct()
    return now.join(hit, "fact_id", "left_anti").select("episode_id", "slot", "value", "fact_id")


def _held(signals: DataFrame, ledger: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """Candidates of turns with ``hit``: whether one of the ``held`` values of their ``keys`` matches."""
    found = signals.select("episode_id", "turn", "reference_id", "kind", F.posexplode("pairs").alias("n", "p"))
    held = values.groupBy(*keys).agg(F.collect_set("k").alias("held"))
    return found.join(held, keys, "left").withColumn("hit", F.coalesce(value_matches(F.col("p.value"), F.col("held")), F.lit(False)))


def candidates(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates of turns with an ordinal (``signals`` as ``scoring.all_signals`` gives them), and whether the ledger holds them for that turn."""
    values = ledger.filter(F.col("observed_turn").isNotNull()).select("episode_id", F.col("observed_turn").alias("turn"), letters_digits(F.col("value")).alias("k"))
    return _held(signals.filter(F.col("turn").isNotNull()), ledger, ["episode_id", "turn"], values)


def extraction_all(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """I4 on all messages: those without an ordinal count as captured by facts that name the message as evidence."""
    values = ledger.select(F.explode("evidence").alias("reference_id"), letters_digits(F.col("value")).alias("k"))
    lost = _held(signals.filter(F.col("turn").isNull()), ledger, ["reference_id"], values)
    cols = ["episode_id", "kind", "hit"]
    return _recall(candidates(signals, ledger).select(*cols).unionByName(lost.select(*cols)))


def extraction(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """I4 on messages with an ordinal: per episode the candidates found and how many of them the ledger holds for that turn."""
    return _recall(candidates(signals, ledger))


def recalls(rows: DataFrame) -> DataFrame:
    """``extraction`` with recalls in parts per 10000; null where nothing was found."""
    rate = lambda a, b: F.try_divide(F.round(F.try_divide(F.col(a) * F.lit(10000.0), F.col(b))), F.lit(1.0)).cast("int")
    return rows.withColumns({"strict_recall": rate("strict_captured", "strict_candidates"), "all_recall": rate("all_captured", "all_candidates")})


def gaps(signals: DataFrame, ledger: DataFrame, most: int = 20) -> DataFrame:
    """(episode, rank, turn, reference, slot, value): the first ``most`` candidates of turns with a change verb that the ledger lacks."""
    open_ = candidates(signals, ledger).filter((F.col("kind") == "change") & ~F.col("hit"))
    order = Window.partitionBy("episode_id").orderBy("turn", "reference_id", "p.slot", "p.value")
    return open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("episode_id", "rank", "turn", "reference_id", "p.slot", "p.value")


def full_report(rows: DataFrame, extracted: DataFrame, least_recall: int = 0) -> DataFrame:
    """The report with I4; an episode whose recall of strong candidates is under ``least_recall`` parts per 10000 isn't clean."""
    both = rows.join(recalls(extracted), "episode_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("strict_candidates", "strict_captured", "all_candidates", "all_captured")]
    enough = F.coalesce(F.col("strict_recall") >= least_recall, F.lit(True))
    return both.select(*[c for c in rows.columns if c != "clean"], *zero, F.coalesce("strict_recall", F.lit(-1)).alias("strict_recall"), enough.alias("i4_ok"), (F.col("clean") & enough).alias("clean"))


def _recall(both: DataFrame) -> DataFrame:
    strict = F.col("kind") == "change"
    return both.groupBy("episode_id").agg(
        F.count_if(strict).alias("strict_candidates"),
        F.count_if(strict & F.col("hit")).alias("strict_captured"),
        F.count(F.lit(1)).alias("all_candidates"),
        F.count_if(F.col("hit")).alias("all_captured"),
    )


def report(ledger: DataFrame, summaries: DataFrame, entries: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per episode with ledger facts: counts per invariant and whether all of I1, I2, I3 and I5 hold."""
    per = lambda df, name, agg=None: df.groupBy("episode_id").agg((agg if agg is not None else F.count(F.lit(1))).alias(name))
    base = ledger.groupBy("episode_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if("erased").alias("erased_facts"), F.sum(F.when(F.col("erased"), F.col("residual_mentions")).otherwise(0)).alias("residual_mentions"))
    evidence = unresolved_evidence(ledger, raw)
    parts = [
        per(lost_facts(ledger, summaries), "missing"),
        per(unreachable_values(ledger, visible_text(summaries.filter("live"), entries)), "unreachable"),
        evidence.groupBy("episode_id").agg(F.count_if(F.col("missing") > 0).alias("unresolved"), F.count_if(F.col("missing") == 0).alias("without_evidence")),
        failed_erasures(ledger, raw).groupBy("episode_id").agg(F.count_if(F.col("problem") == "value_kept").alias("value_kept"), F.count_if(F.col("problem") == "evidence_resolves").alias("evidence_resolves")),
    ]
    for part in parts:
        base = base.join(part, "episode_id", "left")
    names = ["missing", "unreachable", "unresolved", "without_evidence", "value_kept", "evidence_resolves"]
    base = base.select("episode_id", "facts", "erased_facts", "residual_mentions", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    clean = sum((F.col(n) for n in names), F.lit(0)) == 0
    return base.withColumn("clean", clean)


def summary(rows: DataFrame) -> DataFrame:
    """The batch: episodes, clean ones, failures per invariant and totals (one row)."""
    hit = lambda *names: F.count_if(sum((F.col(n) for n in names), F.lit(0)) > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("clean").alias("clean_episodes"),
        hit("missing").alias("i1_failures"),
        hit("unreachable").alias("i2_failures"),
        hit("unresolved", "without_evidence").alias("i3_failures"),
        hit("value_kept", "evidence_resolves").alias("i5_failures"),
        F.coalesce(F.sum("facts"), F.lit(0)).alias("ledger_facts"),
        F.coalesce(F.sum("erased_facts"), F.lit(0)).alias("erased_facts"),
        F.coalesce(F.sum("residual_mentions"), F.lit(0)).alias("residual_mentions"),
        F.coalesce(F.sum("unreachable"), F.lit(0)).alias("unreachable_values"),
    )


def silent_loss(gold: DataFrame, ledger: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per episode: gold (slot, value) pairs and how many the ledger holds with a summary that exists."""
    kept = ledger.join(summaries.select("summary_id").distinct(), "summary_id", "left_semi").select("episode_id", "slot", letters_digits(F.col("value")).alias("key"), F.lit(1).alias("_hit")).distinct()
    return gold.join(kept, ["episode_id", "slot", "key"], "left").groupBy("episode_id").agg(F.count(F.lit(1)).alias("gold_facts"), F.count("_hit").alias("captured"))


def residual_mentions(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(episode, fact, mentions): texts of the episode that hold a fact's value (two letters or digits, or more)."""
    long = facts.filter(F.length(letters_digits(F.col("value"))) >= 2).select("episode_id", "fact_id", "value")
    return contains_join(long, texts).groupBy("episode_id", "fact_id").agg(F.sum("copies").alias("mentions"))


def erasure_plan(ledger: DataFrame, doomed: DataFrame) -> DataFrame:
    """(reference, action) for the evidence of facts to erase: ``delete``, or ``keep`` where a surviving fact needs it."""
    refs = ledger.join(doomed.select("fact_id"), "fact_id", "left_semi").select(F.explode("evidence").alias("reference_id")).distinct()
    needed = ledger.join(doomed.select("fact_id"), "fact_id", "left_anti").filter(~F.col("erased")).select(F.explode("evidence").alias("reference_id"), F.lit(True).alias("_needed")).distinct()
    return refs.join(needed, "reference_id", "left").select("reference_id", F.when(F.col("_needed"), "keep").otherwise("delete").alias("action"))


def erase(ledger: DataFrame, doomed: DataFrame) -> DataFrame:
    """The ledger with tombstones: values of doomed facts blanked, evidence kept for the check."""
    flag = doomed.select("fact_id", F.lit(True).alias("_doomed")).distinct()
    out = ledger.join(flag, "fact_id", "left")
    gone = F.col("erased") | F.coalesce("_doomed", F.lit(False))
    return out.withColumn("value", F.when(gone, "").otherwise(F.col("value"))).withColumn("erased", gone).drop("_doomed")
