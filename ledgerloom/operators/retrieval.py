"""Exact retrieval: lookups by id, chains of successors, predecessors, index members and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_digits, split_pair, summary_facts
from ..plans.blocks import carried_in_order, previous_by_turn, previous_in_order
from ..plans.scratch import Scratch
from .facts import placed
from .versions import slot_key


def lookup(ids: DataFrame, archive: DataFrame, active: DataFrame) -> DataFrame:
    """(summary_id, found_in, text): the archive first, then the active layer; ``missing`` where neither has it."""
    a = archive.select("summary_id", F.col("text").alias("_a"), F.lit(True).alias("_in_a"))
    b = active.select("summary_id", F.col("text").alias("_b"), F.lit(True).alias("_in_b"))
    got = ids.select("summary_id").distinct().join(a, "summary_id", "left").join(b, "summary_id", "left")
    where = F.when(F.col("_in_a"), "archive").when(F.col("_in_b"), "active").otherwise("missing")
    return got.select("summary_id", where.alias("found_in"), F.coalesce(F.when(F.col("_in_a"), F.col("_a")), F.col("_b"), F.lit("")).alias("text"))


def states(ledger: DataFrame, archive: DataFrame, active: DataFrame) -> DataFrame:
    """(fact_id, state): ``live``, ``archived`` or ``missing`` by the fact's summary."""
    a = active.select("summary_id", F.lit(True).alias("_live"))
    b = archive.select("summary_id", F.lit(True).alias("_old"))
    got = ledger.join(a, "summary_id", "left").join(b, "summary_id", "left")
    return got.select("episode_id", "fact_id", F.when(F.col("_live"), "live").when(F.col("_old"), "archived").otherwise("missing").alias("state"))


def evidence(ledger: DataFrame, raw: DataFrame) -> DataFrame:
    """(fact_id, reference_id, turn_index, user_msg): the messages behind each fact."""
    refs = ledger.select("fact_id", F.explode("evidence").alias("reference_id"))
    return refs.join(raw.select("reference_id", "turn_index", "user_msg"), "reference_id").select("fact_id", "reference_id", "turn_index", "user_msg")


def unfiled(active: DataFrame, entries: DataFrame) -> DataFrame:
    """The rendered chain: active summaries that no index entry holds."""
    return active.join(entries.select(F.explode("members").alias("summary_id")).distinct(), "summary_id", "left_anti")


def members(entries: DataFrame, active: DataFrame, archive: DataFrame) -> DataFrame:
    """(index_id, position, summary_id, state) of the members of every entry, in order; dead ones are told."""
    opened = entries.select("index_id", F.posexplode("members").alias("position", "summary_id"))
    a = active.select("summary_id", F.lit(True).alias("_live"))
    b = archive.select("summary_id", F.lit(True).alias("_old"))
    got = opened.join(a, "summary_id", "left").join(b, "summary_id", "left")
    return got.select("index_id", "position", "summary_id", F.when(F.col("_live"), "live").when(F.col("_old"), "archived").otherwise("missing").alias("state"))


def predecessors(ledger: DataFrame) -> DataFrame:
    """(fact, value, previous fact, previous value) of each fact whose value differs from the one before it in its slot.

    Equal neighbours form runs: the first fact of a run has the last of the run before.  With overrides: ``anchored``.
    """
    keys = ["episode_id", "slot"]
    base = placed(ledger.filter(~F.col("erased"))).withColumn("key", letters_digits(F.col("value")))
    base = base.withColumn("_me", F.struct("key", "fact_id", "value"))
    seen = previous_by_turn(base, keys, "_me", "_before")
    starts = seen.filter(F.col("_before").isNotNull() & (F.col("_before.key") != F.col("key")))
    return starts.select("episode_id", "slot", "value", "fact_id", F.col("_before.value").alias("previous_value"), F.col("_before.fact_id").alias("previous_fact"))


def recorded(summaries: DataFrame, erased: DataFrame) -> DataFrame:
    """(episode, slot, summary, value, key, pos): the first value that each summary's text, else its fact keys, give a slot, without erased facts.

    ``summaries``: summary_id, episode_id, seq, ts, text, fact_keys; ``erased``: summary_id, slot.  ``pos`` = 1, 2, ... in the slot
    by (ts, seq, id), counted in blocks of an hour, and of 65536 numbers where no time is known.
    """
    pairs = F.concat(F.coalesce(summary_facts(F.col("text")), F.array().cast("array<string>")), F.coalesce("fact_keys", F.array().cast("array<string>")))
    opened = summaries.select("episode_id", "summary_id", "seq", "ts", F.posexplode(pairs).alias("n", "pair")).withColumn("p", split_pair(F.col("pair"))).filter(F.col("p").isNotNull())
    opened = opened.withColumn("slot", slot_key(F.col("p.slot"))).withColumn("key", letters_digits(F.col("p.value"))).filter((F.col("key") != "") & (F.col("slot") != ""))
    keys = ["episode_id", "slot"]
    time = F.when(F.isnan("ts"), None).otherwise(F.round("ts", 3))
    one = opened.groupBy(*keys, "summary_id").agg(F.min(F.struct("n", F.col("p.value").alias("value"), "key")).alias("f"), F.max(F.coalesce(time, F.lit(-1.0))).alias("_ts"), F.max(F.coalesce("seq", F.lit(-1))).alias("seq"))
    one = one.join(erased.select("summary_id", "slot").distinct(), ["summary_id", "slot"], "left_anti").select(*keys, "summary_id", "f.value", "f.key", "_ts", "seq")
    cut = one.withColumn("_b", F.struct(F.floor(F.col("_ts") / 3600).alias("t"), F.when(F.col("_ts") < 0, F.floor(F.col("seq") / 65536)).otherwise(0).alias("s")))
    inner = Window.partitionBy(*keys, "_b").orderBy("_ts", "seq", "summary_id")
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    placed_ = cut.withColumn("_in", F.row_number().over(inner)).join(ahead, [*keys, "_b"])
    return placed_.select(*keys, "summary_id", "value", "key", (F.col("_in") + F.col("_ahead")).alias("pos"))


def anchored(summaries: DataFrame, erased: DataFrame, overridden: DataFrame, scratch: Scratch) -> DataFrame:
    """(episode, slot, value, summary, recorder, relation, previous summary, previous value): what a value replaced, for every summary that states it.

    The recorder is the newest summary with the value.  The newest of those it overrides (``overridden``: summary_id, target) that
    state the slot comes first (relation ``override``); without one, the newest older summary with another value (``older``).
    """
    keys = ["episode_id", "slot"]
    all_ = scratch.cut(recorded(summaries, erased))
    me = F.struct("key", "summary_id", "value")
    seen = previous_in_order(all_.withColumn("_me", me), keys, "pos", "_me", "_before")
    start = F.when(F.col("_before.key") != F.col("key"), F.col("_before"))
    run = carried_in_order(seen.withColumn("_older", start).drop("_before", "_me"), keys, "pos", "_older")
    recorders = run.groupBy(*keys, "key").agg(F.max(F.struct("pos", "summary_id", "_older")).alias("r")).select(*keys, "key", F.col("r.summary_id").alias("recorder"), F.col("r._older").alias("_older"))
    recorders = scratch.cut(recorders)
    named = overridden.select(F.col("summary_id").alias("recorder"), F.col("target").alias("summary_id")).filter(F.col("recorder") != F.col("summary_id")).distinct()
    direct = recorders.select(*keys, F.col("key").alias("_key"), "recorder").join(named, "recorder").join(all_, [*keys, "summary_id"])
    direct = direct.groupBy(*keys, F.col("_key").alias("key")).agg(F.max_by(me, "pos").alias("_direct"))
    best = F.coalesce("_direct", "_older")
    answers = recorders.join(direct, [*keys, "key"], "left").filter(best.isNotNull())
    relation = F.when(F.col("_direct").isNotNull(), "override").otherwise("older")
    answers = answers.select(*keys, "key", "recorder", relation.alias("relation"), best["summary_id"].alias("previous_summary"), best["value"].alias("previous_value"))
    return all_.join(answers, [*keys, "key"]).select(*keys, "value", "summary_id", "recorder", "relation", "previous_summary", "previous_value")


def newest_other(ledger: DataFrame, exclude: DataFrame) -> DataFrame:
    """(episode, slot, value, fact): the newest fact of a slot whose value isn't the excluded one (``exclude``: episode, slot, key)."""
    rows = ledger.filter(~F.col("erased") & F.col("observed_turn").isNotNull()).withColumn("key", letters_digits(F.col("value"))).filter(F.col("key") != "")
    other = rows.join(exclude.select("episode_id", "slot", F.col("key").alias("_x")), ["episode_id", "slot"]).filter(F.col("key") != F.col("_x"))
    return other.groupBy("episode_id", "slot").agg(F.max(F.struct("observed_turn", "seq", "fact_id", "value")).alias("m")).select("episode_id", "slot", F.col("m.value").alias("value"), F.col("m.fact_id").alias("fact_id"))


#: Lengths of the endings on which value and text meet, and buckets of endings that are asked for.
ENDINGS, BUCKETS = (6, 3, 2, 1), 1 << 20


def contains_join(values: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``values`` (episode_id, value, ...) with each distinct ``text`` of their episode that holds the value, and its number of ``copies``.

    Value and text meet on the value's last characters (six, three, or fewer where it is shorter), which the text offers among
    its own; so neither is paired with all of its episode.  What a text offers is its digest and an ending at a time: the endings are as many as
    its characters, and those in no bucket that is asked for (at most ``BUCKETS`` numbers, broadcast) stay where they are; the text itself
    travels once, to the pairs that met.  Blank values match nothing.
    """
    n = F.length("value")
    size = F.when(n >= 6, 6).when(n >= 3, 3).otherwise(n)
    asked = values.filter(n > 0).withColumn("_ending", F.substr("value", n - size + 1, size))
    each = texts.filter(F.col("text").isNotNull()).groupBy("episode_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("_text", F.md5("text"))
    bucket = F.pmod(F.xxhash64("_ending"), F.lit(BUCKETS)).cast("int")
    # a lookahead yields every stretch of q characters in one pass over the text
    offers = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{q}}}))"), F.lit(1)) for q in ENDINGS]))
    wanted = asked.select(bucket.alias("_bucket")).distinct()
    offered = each.select("episode_id", "_text", F.explode(offers).alias("_ending")).withColumn("_bucket", bucket).join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")
    met = asked.join(offered, ["episode_id", "_ending"]).drop("_ending")
    return met.join(each, ["episode_id", "_text"]).filter(F.contains("text", "value")).drop("_text")


def trace(gold: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """(episode, slot, layer, hits): where a gold value stands.  Layers are (episode_id, text) tables."""
    out = None
    for name, texts in layers.items():
        rows = contains_join(gold, texts).groupBy("episode_id", "slot").agg(F.sum("copies").alias("hits")).withColumn("layer", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("episode_id", "slot", "layer", "hits")
