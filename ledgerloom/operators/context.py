"""What fits into a context: sliding windows, token budgets and baselines, per turn or per episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import token_estimate
from ..plans.blocks import carried_in_order, running_total_in_order
from ..plans.scratch import Scratch


def turn_costs(raw: DataFrame) -> DataFrame:
    """(episode, turn, cost): estimated tokens of a turn, each turn once (its costliest delivery)."""
    cost = token_estimate(F.coalesce("user_msg", F.lit(""))) + token_estimate(F.coalesce("agent_msg", F.lit("")))
    known = raw.filter(F.col("turn_index").isNotNull())
    return known.groupBy("episode_id", F.col("turn_index").alias("turn")).agg(F.max(cost).cast("bigint").alias("cost"))


def last_turns(raw: DataFrame, most: int = 4) -> DataFrame:
    """The newest ``most`` deliveries of every episode, with their position: a turn under several references takes several places.

    The rank is limited, so Spark keeps ``most`` rows per episode and task before the shuffle.
    """
    known = raw.filter(F.col("turn_index").isNotNull())
    order = Window.partitionBy("episode_id").orderBy(F.col("turn_index").desc(), F.col("reference_id").desc())
    return known.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("episode_id", "position", "reference_id", "turn_index")


def newest_turns(raw: DataFrame, most: int = 4) -> DataFrame:
    """The newest ``most`` distinct turns of every episode, each once by its greatest reference.

    A struct aggregate leaves one row per turn before the limited rank.
    """
    known = raw.filter(F.col("turn_index").isNotNull())
    one = known.groupBy("episode_id", "turn_index").agg(F.max("reference_id").alias("reference_id"))
    order = Window.partitionBy("episode_id").orderBy(F.col("turn_index").desc())
    return one.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("episode_id", "position", "reference_id", "turn_index")


def ranked(costs: DataFrame) -> DataFrame:
    """Turns with their dense rank ``position`` = 0, 1, ... within the episode, counted in blocks."""
    one = costs.withColumn("_one", F.lit(1).cast("bigint"))
    run = running_total_in_order(one, ["episode_id"], "turn", "_one", "_n")
    return run.withColumn("position", F.col("_n") - 1).drop("_one", "_n")


def newest_within(costs: DataFrame, budget: int, first_always: bool = True) -> DataFrame:
    """Newest turns whose costs fit the budget together, up to the first that doesn't; the newest is kept in any case if asked."""
    run = running_total_in_order(costs, ["episode_id"], "turn", "cost", "total", descending=True)
    keep = F.col("total") <= budget
    if first_always:
        keep = keep | (F.col("total") == F.col("cost"))
    return run.filter(keep).select("episode_id", "turn", "cost", "total")


def oldest_within(costs: DataFrame, budget: int) -> DataFrame:
    """Oldest turns whose costs fit the budget together."""
    run = running_total_in_order(costs, ["episode_id"], "turn", "cost", "total")
    return run.filter(F.col("total") <= budget).select("episode_id", "turn", "cost", "total")


def running_context(costs: DataFrame) -> DataFrame:
    """Per episode the tokens that a system which shows the whole history has shown over all turns, and at most."""
    run = running_total_in_order(costs, ["episode_id"], "turn", "cost", "total")
    return run.groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("total").alias("shown_tokens"), F.max("total").alias("most_tokens"))


def evictions(costs: DataFrame, budget: int, recent: int, scratch: Scratch) -> DataFrame:
    """(episode, evicted, evicted_tokens, evictions): a window that is checked after every turn, and cut to its newest ``recent`` turns when over budget.

    After a cut at turn i the window starts at i - recent + 1, so the next cut is the first later turn whose running total exceeds
    that before the window by more than the budget.  Each turn is linked to that turn, and the links are doubled; the way starts
    at turn ``recent``, the last one that can't be cut.
    """
    e = ["episode_id"]
    run = running_total_in_order(costs.withColumn("_one", F.lit(1).cast("bigint")), e, "turn", "_one", "i")
    run = scratch.cut(running_total_in_order(run, e, "turn", "cost", "total").select("episode_id", "i", "total"))
    gone = run.select("episode_id", (F.col("i") + recent).alias("i"), F.col("total").alias("gone"))
    asked = run.filter(F.col("i") >= recent).select("episode_id", "i").join(gone, ["episode_id", "i"], "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    # totals and limits on one scale, read from the greatest down: a limit takes the first turn of the least total above it
    none = F.lit(None).cast("bigint")
    points = run.groupBy("episode_id", (F.col("total") * -2).alias("at")).agg(F.min("i").alias("next"))
    limit = (F.col("gone") + budget) * -2 - 1
    limits = asked.select("episode_id", limit.alias("at")).distinct().withColumn("next", none)
    met = carried_in_order(points.unionByName(limits), e, "at", "next", 1 << 20).filter(F.pmod("at", F.lit(2)) == 1)
    links = asked.withColumn("at", limit).join(met, ["episode_id", "at"], "left")
    links = links.select("episode_id", "i", F.when(F.col("next").isNotNull(), F.greatest("next", F.col("i") + 1)).alias("onward"))
    # over budget after the last turn already: no later turn is left to cut at
    links = links.join(run.select("episode_id", F.col("i").alias("onward"), F.lit(True).alias("_there")), ["episode_id", "onward"], "left")
    ended = F.col("_there").isNull()
    state = scratch.cut(links.select("episode_id", "i", F.when(ended, F.col("i")).otherwise(F.col("onward")).alias("last"), F.when(ended, 0).otherwise(1).cast("bigint").alias("evictions"), ended.alias("ended")))
    while state.filter(~F.col("ended")).limit(1).count():
        other = state.select("episode_id", F.col("i").alias("last"), F.col("last").alias("_last"), F.col("evictions").alias("_evictions"), F.col("ended").alias("_ended"))
        moved = state.filter(~F.col("ended")).join(other, ["episode_id", "last"])
        moved = moved.select("episode_id", "i", F.col("_last").alias("last"), (F.col("evictions") + F.col("_evictions")).alias("evictions"), F.col("_ended").alias("ended"))
        fresh, old = scratch.cut(state.filter("ended").unionByName(moved)), state
        scratch.drop(old)
        state = fresh
    cuts = state.filter((F.col("i") == recent) & (F.col("evictions") > 0)).select("episode_id", (F.col("last") - recent).alias("i"), "evictions")
    return cuts.join(run, ["episode_id", "i"]).select("episode_id", F.col("i").alias("evicted"), F.col("total").alias("evicted_tokens"), "evictions")


def spread_sample(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``n`` rows per key, evenly spread by the dense rank ``order`` = 0, 1, ...: those at floor(i * count / n)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    wanted = sizes.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_size") / n))).alias(order)).distinct()
    return rows.join(wanted, [*keys, order], "left_semi")


def evidence_budget(turns: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """At most ``budget`` turns per episode: evidence first, then the newest (``turns``, ``evidence``: episode_id, turn).

    The rank is limited, so Spark keeps ``budget`` rows per episode and task before the shuffle.
    """
    marked = turns.join(evidence.select("episode_id", "turn", F.lit(1).alias("is_evidence")).distinct(), ["episode_id", "turn"], "left").withColumn("is_evidence", F.coalesce("is_evidence", F.lit(0)))
    order = Window.partitionBy("episode_id").orderBy(F.col("is_evidence").desc(), F.col("turn").desc())
    return marked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= budget).select("episode_id", "turn", "is_evidence")
