"""History of changing attributes: a bitemporal ledger swept in valid time.

Every observation is a claim that stays for good.  ``intervals`` turns the claims into the ledger: rows with a *valid* period (turns) and a *recorded* period
(record numbers).  A claim opens a row from its turn to the next turn that is known when it is recorded.  A late claim whose turn lies inside a row's valid period
splits it: that row's recorded period ends, a row for the shorter period follows it, and the late claim's own row takes the rest.  A later claim
on the same turn ends the recorded period of the row before in the same way.  No row is ever changed otherwise or removed, so the belief at any record number can be read off
(``belief``); the rows whose recorded period is open are the present belief, and ``versions`` joins its neighbours of equal value.

The sweep finds, for each turn's first claim, the nearest earlier turn that was known by then (its row is split) and the nearest later one (where
its own row ends).  Turns are leaves of ``FAN`` in a tree whose nodes hold the earliest record of each child, so both turns are found by equality joins up and
down the tree, which most rows leave at the first leaf; no slot is gathered in one task.  What one turn of a slot saw runs in blocks of record numbers.

Defined results: null episodes, slots or turns and negative turns don't count, nor do blank
values that aren't erasures; an erasure observes a blank value; repeated claims count once; of claims with one record number in one turn
the greatest counts; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGES, letters_digits
from ..plans.blocks import previous_in_order
from ..plans.scratch import Scratch

OPEN = -1
FAN, SPAN = 64, 65536
_SLOT = ["episode_id", "slot"]

def slot_key(slot: Column) -> Column:
    """Lower case, with ``_``, ``-`` and blanks as one blank and none outside."""
    return F.trim(F.regexp_replace(F.lower(slot), rf"[{EDGES}_\-]+", " "))


def claims(rows: DataFrame, turn: str, rank: int, record: Column) -> DataFrame:
    """Observations in one form.  ``rank`` orders the sources that claim the same turn; ``record`` the claims of a source."""
    erased = F.coalesce("erased", F.lit(False))
    said = F.coalesce(F.regexp_replace("value", rf"[{EDGES}]+", ""), F.lit(""))
    out = rows.select(
        F.col("episode_id"),
        slot_key(F.col("slot")).alias("slot"),
        F.col(turn).cast("int").alias("turn"),
        F.lit(rank).alias("rank"),
        F.coalesce(record.cast("bigint"), F.lit(-1)).alias("record"),
        F.when(erased, F.lit("")).otherwise(letters_digits(F.col("value"))).alias("key"),
        F.when(erased, F.lit("")).otherwise(F.col("value")).alias("value"),
        (erased | (said != "")).alias("_counts"),
    )
    return out.filter(F.col("episode_id").isNotNull() & F.col("slot").isNotNull() & (F.col("turn") >= 0) & F.col("_counts")).drop("_counts")


def ledger(observations: DataFrame) -> DataFrame:
    """One row per distinct claim, with the record number at which another claim of its turn takes over (null: none).

    Claims of a source count as recorded before all claims of a source of higher rank.
    """
    keys = [*_SLOT, "turn"]
    distinct = observations.groupBy(*keys, "rank", "record", "key").agg(F.min("value").alias("value"))
    placed = distinct.withColumn("_at", F.struct("rank", "record", "key")).withColumn("_me", F.struct("rank", "record"))
    after = previous_in_order(placed, keys, "_at", "_me", "_after", lead=True, block=_record_block("rank", "record"))
    return after.select(*keys, "rank", "record", "key", "value", F.col("_after.rank").alias("superseded_rank"), F.col("_after.record").alias("superseded_record"))


def _record_block(rank: str, record: str) -> Column:
    """Blocks of record numbers, in order: those of a rank never meet those of another."""
    return F.struct(F.col(rank).alias("r"), F.floor(F.col(record) / SPAN).alias("b"))


def intervals(observations: DataFrame, scratch: Scratch) -> DataFrame:
    """The bitemporal ledger: ``(episode_id, slot, key, value, turn, until, rank, record, until_rank, until_record)``.

    Valid for turns in ``[turn, until)`` (null: open), believed from (rank, record) until (until_rank, until_record) (null: still).
    """
    claims_, names = _numbered(observations, scratch)
    told = _told(_rows(claims_, scratch), claims_).join(names, "sid")
    return told.select(*_SLOT, "key", "value", "turn", "until", "rank", "record", "until_rank", "until_record")


def _numbered(observations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sid, turn, rank, record, key, value): one claim per turn and record number, slots as numbers; and (sid, episode_id, slot)."""
    best = F.max(F.struct("key", "value")).alias("said")
    one = scratch.cut(observations.groupBy(*_SLOT, "turn", "rank", "record").agg(best))
    names = scratch.cut(one.select(*_SLOT).distinct().sortWithinPartitions(*_SLOT).select(F.monotonically_increasing_id().alias("sid"), *_SLOT))
    return scratch.cut(one.join(names, _SLOT).select("sid", "turn", "rank", "record", "said.key", "said.value")), names


def _rows(claims_: DataFrame, scratch: Scratch) -> DataFrame:
    """The ledger's rows in numbers: (sid, turn, until, rank, record, until_rank, until_record, by_rank, by_record), by whose claim they hold."""
    points = claims_.groupBy("sid", "turn").agg(F.min(F.struct("rank", "record")).alias("first"))
    beside = _neighbours(points, scratch)
    said = claims_.select("sid", "turn", "rank", "record", F.lit(1).alias("claim"), F.lit(None).cast("int").alias("to"))
    own = beside.filter(F.col("right").isNotNull()).select("sid", "turn", "first.rank", "first.record", F.lit(0).alias("claim"), F.col("right").alias("to"))
    split = beside.filter(F.col("left").isNotNull()).select("sid", F.col("left").alias("turn"), "first.rank", "first.record", F.lit(0).alias("claim"), F.col("turn").alias("to"))
    events = said.unionByName(own).unionByName(split).groupBy("sid", "turn", "rank", "record").agg(F.max("claim").alias("claim"), F.min("to").alias("to"))
    return scratch.cut(_states(events))


def _told(rows: DataFrame, claims_: DataFrame) -> DataFrame:
    """Rows with the key and value of their claims."""
    by = claims_.select("sid", "turn", F.col("rank").alias("by_rank"), F.col("record").alias("by_record"), "key", "value")
    return rows.join(by, ["sid", "turn", "by_rank", "by_record"])


def _states(events: DataFrame) -> DataFrame:
    """Events of a turn in record order -> what held after each: the last claim, the least end, and when the next event came.

    In blocks of record numbers; only turns of several blocks need the second window.
    """
    keys, at = ["sid", "turn"], F.struct("rank", "record")
    cut = events.withColumn("_b", _record_block("rank", "record"))
    inner = Window.partitionBy(*keys, "_b").orderBy("rank", "record")
    upto, outer = inner.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("_b")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    claim = F.when(F.col("claim") == 1, at)
    blocks = cut.groupBy(*keys, "_b").agg(F.max(claim).alias("_s"), F.min("to").alias("_t"), F.min(at).alias("_f"))
    carried = blocks.select(
        *keys, "_b", F.last("_s", ignorenulls=True).over(before).alias("_by"), F.min("_t").over(before).alias("_to"), F.lead("_f").over(outer).alias("_next"), F.lag("_f").over(outer).alias("_prior")
    ).filter(F.col("_next").isNotNull() | F.col("_prior").isNotNull()).drop("_prior")
    near = cut.select(*keys, "_b", "rank", "record", F.last(claim, ignorenulls=True).over(upto).alias("by"), F.min("to").over(upto).alias("to"), F.lead(at).over(inner).alias("next"))
    both = near.join(carried, [*keys, "_b"], "left")
    by, after = F.coalesce("by", "_by"), F.coalesce("next", "_next")
    return both.select(*keys, F.least("to", "_to").alias("until"), "rank", "record", after["rank"].alias("until_rank"), after["record"].alias("until_record"), by["rank"].alias("by_rank"), by["record"].alias("by_record"))


def _neighbours(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Per turn (``first``: its earliest record) the nearest turn before with ``first`` not later, ``left``, and the nearest after with an earlier one, ``right``."""
    earlier = lambda x: (x["turn"] < F.col("p.turn")) & (x["first"] <= F.col("p.first"))
    later = lambda x: (x["turn"] > F.col("p.turn")) & (x["first"] < F.col("p.first"))
    leaf = F.floor(F.col("turn") / FAN).cast("int")
    leaves = points.groupBy("sid", leaf.alias("node")).agg(F.collect_list(F.struct("turn", "first")).alias("kids"))  # at most FAN turns
    leaves = scratch.cut(leaves)
    greatest = (leaves.agg(F.max("node").alias("n")).first().n or 0) * FAN
    opened = leaves.select("sid", "node", "kids", F.explode("kids").alias("p"))
    turn_of = lambda kids: F.transform(kids, lambda x: x["turn"])
    near = opened.select("sid", "node", F.col("p.turn").alias("turn"), F.col("p.first").alias("first"), F.array_max(turn_of(F.filter("kids", earlier))).alias("left"), F.array_min(turn_of(F.filter("kids", later))).alias("right"))
    if greatest < FAN:
        return near.drop("node")
    # levels[l] holds nodes whose children are nodes of level l - 1; level 0 are the leaves
    levels, span, kids = [leaves], FAN, leaves
    while greatest // span:
        least = F.array_min(F.transform("kids", lambda x: x["first"]))
        kids = kids.select("sid", F.floor(F.col("node") / FAN).cast("int").alias("up"), F.struct(F.col("node").alias("turn"), least.alias("first")).alias("k"))
        kids = scratch.cut(kids.groupBy("sid", F.col("up").alias("node")).agg(F.collect_list("k").alias("kids")))
        levels.append(kids)
        span *= FAN
    sides = F.array_compact(F.array(F.when(F.col("left").isNull(), F.lit("left")), F.when(F.col("right").isNull(), F.lit("right"))))
    asked = near.select("sid", "turn", "first", "node", F.explode(sides).alias("side"))
    found = None
    for level in range(1, len(levels)):  # up: a sibling that holds an early enough record
        asked = scratch.cut(_picked(asked.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN).cast("int")), levels[level], F.col("child")))
        hit = asked.filter(F.col("pick").isNotNull()).select("sid", "turn", "first", "side", F.col("pick").alias("node"))
        for below in range(level - 1, -1, -1):  # down: the child nearest to the asking turn
            hit = _picked(hit, levels[below], None).select("sid", "turn", "first", "side", F.col("pick").alias("node"))
        found = hit if found is None else found.unionByName(hit)
        asked = asked.filter(F.col("pick").isNull()).drop("pick", "child")
    far = found.groupBy("sid", "turn").agg(F.max(F.when(F.col("side") == "left", F.col("node"))).alias("_left"), F.max(F.when(F.col("side") == "right", F.col("node"))).alias("_right"))
    return near.join(far, ["sid", "turn"], "left").select("sid", "turn", "first", F.coalesce("left", "_left").alias("left"), F.coalesce("right", "_right").alias("right"))


def _picked(asked: DataFrame, nodes: DataFrame, own: Column | None) -> DataFrame:
    """``asked`` with ``pick``: the child nearest to the asking turn whose earliest record is early enough (beside ``own``, if given)."""
    both = asked.join(nodes, ["sid", "node"])
    left = F.filter("kids", lambda x: (x["first"] <= F.col("first")) & (F.lit(True) if own is None else x["turn"] < own))
    right = F.filter("kids", lambda x: (x["first"] < F.col("first")) & (F.lit(True) if own is None else x["turn"] > own))
    at = lambda kids: F.transform(kids, lambda x: x["turn"])
    return both.withColumn("pick", F.when(F.col("side") == "left", F.array_max(at(left))).otherwise(F.array_min(at(right)))).drop("kids")


def belief(rows: DataFrame, as_of: tuple[int, int] | None = None) -> DataFrame:
    """The intervals believed now, or as of (rank, record)."""
    if as_of is None:
        return rows.filter(F.col("until_rank").isNull())
    at = F.struct(F.lit(as_of[0]).alias("rank"), F.lit(as_of[1]).cast("bigint").alias("record"))
    return rows.filter((F.struct("rank", "record") <= at) & (F.col("until_rank").isNull() | (F.struct(F.col("until_rank").alias("rank"), F.col("until_record").alias("record")) > at)))


def versions(observations: DataFrame, as_of: tuple[int, int] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(episode_id, slot, value, valid_from_turn, valid_to_turn)``, half-open, -1 for still valid: the ledger's belief, neighbours of equal value joined.

    ``as_of``: the belief when claims up to that (rank, record) were in.
    """
    scratch = scratch or Scratch(observations.sparkSession, "versions")
    claims_, names = _numbered(observations, scratch)
    points = _told(belief(_rows(claims_, scratch), as_of), claims_)
    compared = previous_in_order(points.select("sid", "turn", "key", "value"), ["sid"], "turn", "key", "_prior")
    starts = compared.filter(F.col("_prior").isNull() | (F.col("_prior") != F.col("key"))).drop("_prior", "key")
    closed = previous_in_order(starts, ["sid"], "turn", "turn", "_next", lead=True).join(names, "sid")
    return closed.select(
        "episode_id",
        "slot",
        "value",
        F.col("turn").alias("valid_from_turn"),
        F.coalesce("_next", F.lit(OPEN)).cast("int").alias("valid_to_turn"),
    )
