"""Digests: the attributes of a group with their latest value and a short history, as one line of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES


def digest(rows: DataFrame, owner: str, most: int, history: int = 3) -> DataFrame:
    """(owner, digest) of rows (owner, attr, value, at, rank): ``attr=latest[older→...→latest]``, the ``most`` attributes of least ``rank``.

    Values stand in order of their first ``at``; a null value gives the attribute its place but no entry.
    An owner's rows are a bounded list, so they are gathered per owner and attribute.
    """
    first = rows.groupBy(owner, "attr", "value").agg(F.min("at").alias("at"), F.min("rank").alias("rank"))
    told = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value"))))
    each = first.groupBy(owner, "attr").agg(F.min("rank").alias("rank"), told.alias("v"))
    n, latest = F.size("v"), F.element_at("v", -1)["value"]
    older = F.slice(F.transform("v", lambda x: x["value"]), F.greatest(n - history, F.lit(1)), F.least(n - 1, F.lit(history)))
    line = F.when(n > 0, F.concat("attr", F.lit("="), latest, F.when(n > 1, F.concat(F.lit("["), F.array_join(older, "→"), F.lit("→"), latest, F.lit("]"))).otherwise("")))
    listed = each.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("rank", "attr", line.alias("line")))).alias("all"))
    chosen = F.filter(F.transform(F.slice("all", 1, most), lambda x: x["line"]), lambda x: x.isNotNull())
    return listed.select(owner, F.array_join(chosen, "; ").alias("digest"))


def of_members(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows of ``digest`` per index entry: values in the members' order, attributes by their newest member."""
    members = entries.select("index_id", F.posexplode("members").alias("m", "summary_id"))
    keys = summaries.select("summary_id", F.posexplode("fact_keys").alias("k", "pair")).filter(F.contains("pair", F.lit("=")))
    both = members.join(keys, "summary_id").select("index_id", "m", "k", F.trim(F.substring_index("pair", "=", 1)).alias("attr"), F.trim(F.substr("pair", F.instr("pair", "=") + 1)).alias("v"))
    return both.filter(F.col("attr") != "").select("index_id", "attr", F.nullif("v", F.lit("")).alias("value"), F.struct("m", "k").alias("at"), F.struct((-F.col("m")).alias("m"), "k").alias("rank"))


def of_titles(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``digest`` per parent (``links``: parent, index_id): the digests in the children's titles read back, children in order of their seq and id."""
    pair = rf"[^=;｜|]+=[^\[;｜|]+(?:\[[^\]]*\])?(?=[;｜|]|$)"
    titles = links.join(entries.select("index_id", "seq", "title"), "index_id")
    found = titles.select("parent", "seq", "index_id", F.posexplode(F.regexp_extract_all("title", F.lit(pair), F.lit(0))).alias("k", "w"))
    bare = lambda c: F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")
    rest = F.substr("w", F.instr("w", "=") + 1)
    older = F.filter(F.transform(F.split(F.regexp_extract("w", r"\[([^\]]*)\]$", 1), "→"), bare), lambda x: x != "")
    latest = bare(F.regexp_replace(rest, r"\[[^\]]*\]$", ""))
    rows = found.select("parent", "seq", "index_id", "k", bare(F.substring_index("w", "=", 1)).alias("attr"), F.posexplode(F.concat(older, F.array(latest))).alias("h", "value"), latest.alias("_latest"))
    at = F.struct("seq", "index_id", "k", "h")
    return rows.filter((F.col("attr") != "") & (F.col("_latest") != "")).select("parent", "attr", "value", at.alias("at"), at.alias("rank"))
