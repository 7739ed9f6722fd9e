"""Conversations from message rows.

Rows are partitioned by conversation and ordered by their ordinal; a finite-state automaton reads the
turns.  A conversation may hold any share of the rows, so the automaton runs over blocks of ``BLOCK``
ordinals, whose end states combine: its state is a set of facts seen so far (``SPOKE``, ``UNANSWERED``, ``CLASH``,
``GAP``), the union of those of the blocks plus a gap where blocks don't join.  Copies of a turn are first
reduced by a map-side aggregate, so that no group exceeds a block.

Defined results: the row with the greatest ``ts`` counts per reference (ties: by content); rows
without a reference count each; rows without an episode, or with a blank one, belong to no conversation;
an ordinal that is null or negative breaks its conversation; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EDGES, letters_digits, strip
from ..plans.blocks import newest

BLOCK = 1024
SPOKE, UNANSWERED, CLASH, GAP = 1, 2, 4, 8

#: Stand-ins for a missing text, by letters and digits in lower case; speaker labels.
STAND_INS = ["none", "null", "nil", "nan", "na", "undefined", "empty", "missing", "blank", "noresponse", "noreply", "noanswer", "nomessage", "nocontent", "notext", "unavailable", "notavailable", "notapplicable", "无回复", "无", "空", "无内容", "没有回复", "未回复", "暂无", "无消息", "无回答", "空白", "缺失", "无响应", "未填写"]
LABELS = "user|human|customer|client|assistant|agent|bot|ai|model|system|speaker|用户|助手|客服|客户|助理|代理|机器人|智能体|系统|模型"

_EDGE = f"[{EDGES}]"
_LABEL = rf"(?i)^{_EDGE}*(?:[\[<(【（*]+{_EDGE}*(?:{LABELS}){_EDGE}*[\]>)】）*]+{_EDGE}*[:：]?|(?:{LABELS}){_EDGE}*[:：]){_EDGE}*"


def bare(text: Column) -> Column:
    """The text without a leading speaker label and outer blanks."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), _LABEL, ""))


def says(text: Column) -> Column:
    """Whether a side says something."""
    key = letters_digits(bare(text))
    return (key != "") & ~key.isin(STAND_INS)


def turns(raw: DataFrame) -> DataFrame:
    """One row per (episode, ordinal) of the counting rows: facts and texts."""
    rows = raw.filter(F.col("episode_id").isNotNull()).select(
        "reference_id",
        F.when(F.col("reference_id").isNull(), F.struct("episode_id", "turn_index", "user_msg", "agent_msg", "ts")).alias("_whole"),
        strip(F.col("episode_id")).alias("episode_id"),
        F.col("turn_index").cast("int").alias("turn_index"),
        "user_msg",
        "agent_msg",
        "ts",
    )
    counting = newest(rows, ["reference_id", "_whole"], [F.coalesce(F.nanvl("ts", F.lit(float("-inf"))), F.lit(float("-inf")))], ["episode_id", "turn_index", "user_msg", "agent_msg"])
    user, agent = says(F.col("user_msg")), says(F.col("agent_msg"))
    sides = counting.filter(F.col("episode_id") != "").select(
        "episode_id",
        F.when(F.col("turn_index") >= 0, F.col("turn_index")).alias("ordinal"),
        user.alias("user_says"),
        agent.alias("agent_says"),
        F.when(user, bare(F.col("user_msg"))).otherwise("").alias("user_text"),
        F.when(agent, bare(F.col("agent_msg"))).otherwise("").alias("agent_text"),
    )
    mark = F.md5(F.concat_ws("\0", "user_text", "agent_text"))
    return sides.groupBy("episode_id", "ordinal").agg(
        F.max(F.col("user_says") | F.col("agent_says")).alias("spoke"),
        F.max(F.col("user_says") & ~F.col("agent_says")).alias("unanswered"),
        (F.min(mark) != F.max(mark)).alias("clash"),
        F.min("user_text").alias("user_text"),
        F.min("agent_text").alias("agent_text"),
    )


def states(turn_rows: DataFrame) -> DataFrame:
    """End state of the automaton per episode."""
    bits = F.col("spoke").cast("int") * SPOKE + F.col("unanswered").cast("int") * UNANSWERED + F.when(F.col("clash") & F.col("ordinal").isNotNull(), CLASH).otherwise(0)
    read = turn_rows.select("episode_id", "ordinal", bits.alias("symbol"), F.floor(F.col("ordinal") / BLOCK).alias("block"))
    block = read.groupBy("episode_id", "block").agg(F.array_sort(F.collect_list(F.struct("ordinal", "symbol"))).alias("tape"))
    start = F.struct(F.lit(0).alias("state"), F.col("tape")[0]["ordinal"].alias("next"))

    def step(a, x):
        gap = F.when(x["ordinal"].isNull() | (x["ordinal"] != a["next"]), GAP).otherwise(0)
        return F.struct(a["state"].bitwiseOR(x["symbol"]).bitwiseOR(gap).alias("state"), (x["ordinal"] + 1).alias("next"))

    ran = block.select("episode_id", "block", F.col("tape")[0]["ordinal"].alias("first"), F.aggregate("tape", start, step).alias("end"), F.size("tape").alias("n"))
    joined = ran.groupBy("episode_id").agg(
        F.bit_or("end.state").alias("state"),
        F.min("first").alias("first"),
        F.max(F.col("end.next")).alias("next"),
        F.sum(F.when(F.col("first").isNotNull(), F.col("n"))).alias("n"),
    )
    broken = F.coalesce((F.col("first") != 0) | (F.col("next") != F.col("n")), F.lit(True))
    return joined.select("episode_id", F.when(broken, F.col("state").bitwiseOR(F.lit(GAP))).otherwise(F.col("state")).alias("state"))


def reasons(state_rows: DataFrame) -> DataFrame:
    """``(episode_id, reason)`` of the conversations to drop."""
    has = lambda bit: F.col("state").bitwiseAND(F.lit(bit)) != 0
    why = F.array_compact(
        F.array(
            F.when(~has(SPOKE), "empty"),
            F.when(has(UNANSWERED), "missing_reply"),
            F.when(has(CLASH | GAP), "broken"),
        )
    )
    return state_rows.select("episode_id", F.explode(why).alias("reason"))


def messages(turn_rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``(episode_id, position, role, text)`` of the kept conversations, silent sides left out.

    Kept ordinals are 0 to n-1, so the position follows from the ordinal, without a window.
    """
    kept = turn_rows.join(dropped.select("episode_id").distinct(), "episode_id", "left_anti")
    sides = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("user_text").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("agent").alias("role"), F.col("agent_text").alias("text")))
    opened = kept.select("episode_id", "ordinal", F.explode(sides).alias("s")).filter(F.col("s.text") != "")
    return opened.select("episode_id", (F.col("ordinal") * 2 + F.col("s.k")).alias("position"), "s.role", "s.text")
