"""Queries p2_..., p3_..., p5_... to p9_... over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EDGES
from ..plans.blocks import newest
from ..plans.problems import table
from ..plans.scratch import Scratch
from . import chunks, conversations, leaks, mixing, pairs, percentiles, residue


def residue_records(spark: SparkSession, folder: str) -> DataFrame:
    """(src, rec_key, text) of predictions and of the counting rows of archived and active summaries."""
    probes = table(spark, folder, "probe_predictions")
    keys = ("run_id", "system", "episode_id", "probe_index")
    whole = [F.col(k).isNotNull() for k in keys]
    said = probes.filter(whole[0] & whole[1] & whole[2] & whole[3]).select(F.lit("prediction").alias("src"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("rec_key"), F.col("prediction").alias("text"))
    for name, src in (("archived_summaries", "archived"), ("active_summaries", "active")):
        rows = table(spark, folder, name).filter(F.col("summary_id").isNotNull())
        last = newest(rows, ["summary_id"], [F.coalesce("ts", F.lit(float("-inf")))], ["text"])
        said = said.unionByName(last.select(F.lit(src).alias("src"), F.col("summary_id").alias("rec_key"), "text"))
    return said.filter(F.col("text").isNotNull())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold residue instead of content."""
    records = residue_records(spark, folder)
    return residue.classify(records, residue.build(records)).select("src", "rec_key").distinct()


def p2_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Residue with its kind and its coverage in parts per thousand."""
    records = residue_records(spark, folder)
    return residue.classify(records, residue.build(records)).select("src", "rec_key", "kind", "coverage").distinct()


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The records without residue."""
    records = residue_records(spark, folder)
    out = residue.classify(records, residue.build(records)).select("src", "rec_key")
    return records.join(out, ["src", "rec_key"], "left_anti").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes to drop, with the reasons."""
    return conversations.reasons(conversations.states(conversations.turns(table(spark, folder, "raw_records"))))


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the conversations that are whole, in order, with speaker roles."""
    turns = Scratch(spark, "conversations").cut(conversations.turns(table(spark, folder, "raw_records")))
    return conversations.messages(turns, conversations.reasons(conversations.states(turns)))


def _measured(spark: SparkSession, folder: str, group: list[str]) -> DataFrame:
    probes = table(spark, folder, "probe_predictions")
    return percentiles.measured(probes, ["run_id", "system", "episode_id", "probe_index"], group, ["latency_ms", "context_tokens"])


def _as_text(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(
        *keys,
        F.format_string("%.3f", F.col("quantile")).alias("quantile"),
        F.format_string("%.6f", F.col("estimate")).alias("estimate"),
        "n",
        "below",
        "upto",
        F.ceil(F.col("error") * 1e6).cast("bigint").alias("error_ppm"),
    )


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per system, with the exact rank interval of each estimate and its error in parts per million."""
    keys = ["system", "metric"]
    return _as_text(percentiles.percentiles(_measured(spark, folder, ["system"]), keys, Scratch(spark, "percentiles")), keys)


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and tails per run and system."""
    keys = ["run_id", "system", "metric"]
    found = percentiles.percentiles(_measured(spark, folder, ["run_id", "system"]), keys, Scratch(spark, "percentiles"), quantiles=(0.5, 0.95))
    return _as_text(found, keys)


def p6_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs with the posterior of each defect in parts per thousand."""
    return pairs.defects(table(spark, folder, "probe_predictions"), Scratch(spark, "pairs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs and the kind of their defects."""
    return p6_defects(spark, folder).drop("posterior")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which half or more stands in them as one unbroken stretch."""
    return p7_leaks(spark, folder).filter("kind = 'copy'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks, copies and paraphrases, with the common stretch, what the common subsequence covers, and whether the answer stands in the document."""
    found = leaks.search(table(spark, folder, "documents"), table(spark, folder, "eval_items"), Scratch(spark, "leaks"))
    return found.select("doc_id", "item_id", "kind", "stretch", "common", "item_chars", F.col("answered").cast("int").alias("answered"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "mixing")
    counts = scratch.cut(mixing.token_counts(table(spark, folder, "documents")))
    return mixing.mixture(counts, table(spark, folder, "mix_targets"), scratch)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: documents with their copies."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached against the targets."""
    return mixing.shares(*_mixed(spark, folder))


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of at most 512 tokens with 48 tokens of overlap."""
    return chunks.split(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_kinds, p2_clean, p3_found, p3_conversations, p5_percentiles, p5_runs, p6_found, p6_defects, p7_found, p7_leaks, p8_mixture, p8_shares, p9_pieces)}

def _p3_sql() -> str:
    label = conversations._LABEL.replace("'", "''")
    stand_ins = ", ".join(f"'{x}'" for x in conversations.STAND_INS)
    key = lambda c: rf"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '{label}', '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
    bare = lambda c: rf"regexp_replace(regexp_replace(coalesce({c}, ''), '{label}', ''), '^[{EDGES}]+|[{EDGES}]+$', '', 'g')"
    says = lambda c: f"({key(c)} <> '' AND {key(c)} NOT IN ({stand_ins}))"
    return f"""WITH r AS (SELECT regexp_replace(episode_id, '^[{EDGES}]+|[{EDGES}]+$', '', 'g') AS episode_id, CASE WHEN turn_index >= 0 THEN turn_index END AS o, user_msg, agent_msg
      FROM raw_records WHERE episode_id IS NOT NULL QUALIFY reference_id IS NULL OR row_number() OVER (PARTITION BY reference_id ORDER BY ts DESC NULLS LAST) = 1),
    s AS (SELECT episode_id, o, {says('user_msg')} AS u, {says('agent_msg')} AS a, CASE WHEN {says('user_msg')} THEN {bare('user_msg')} ELSE '' END || chr(1) || CASE WHEN {says('agent_msg')} THEN {bare('agent_msg')} ELSE '' END AS t FROM r WHERE episode_id <> ''),
    e AS (SELECT episode_id, bool_or(u OR a) AS spoke, bool_or(u AND NOT a) AS unanswered, bool_or(o IS NULL) OR min(o) <> 0 OR max(o) + 1 <> count(DISTINCT o) AS gap FROM s GROUP BY ALL),
    c AS (SELECT DISTINCT episode_id FROM s WHERE o IS NOT NULL GROUP BY episode_id, o HAVING count(DISTINCT t) > 1)
    SELECT episode_id, 'empty' AS reason FROM e WHERE NOT spoke
    UNION ALL SELECT episode_id, 'missing_reply' FROM e WHERE unanswered
    UNION SELECT episode_id, 'broken' FROM (SELECT episode_id FROM e WHERE gap UNION SELECT episode_id FROM c)"""


SQL: dict[str, str] = {"p3_found": _p3_sql()}
