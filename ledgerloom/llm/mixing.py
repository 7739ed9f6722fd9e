"""Mixing sources to target weights, by pivotal dependent rounding of copy numbers.

A source with share s of a mixture of T tokens needs s*T tokens, hence every document of it ``rate`` = s*T / tokens(source)
copies, at most the source's cap.  The whole part of the rate is certain; the fraction is rounded by
the pivotal method: two documents with fractional copies trade token mass at random until one of them has a whole number,
so that expected copies keep the rate and the source's tokens stay as they were.  Documents meet in leaves of about ``LEAF``, chosen by a
hash of the id; a leaf keeps at most one fractional document per source; these residuals meet in a reduction tree of ``FAN_IN`` leaves
per node until one per source is left, which a coin rounds.  A source so misses its tokens by less than one document.

Every coin is a function of ``SEED``, the two ids that trade and the level of the tree, and leaves, their order and the tree depend on the ids and the number
of documents only: the mixture is the same however the input is partitioned.

``T`` is the largest total that the caps allow, or the caller's, which mustn't exceed it.

Defined results: sources are compared in lower case, without outer blanks and with ``_`` for ``-``; documents of other or
null sources, null ids and texts without tokens get no copies; repeated texts are different documents; a target without documents has share 0
and the others keep their proportion; an empty table gives an empty mixture.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.scratch import Scratch
from .tokens import DEFAULT, encoding

FAN_IN, LEAF, SEED = 64, 20_000, 20240917
_WORD = (1 << 64) - 1


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(strip(source)), "-", "_")


def token_counts(documents: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """``(doc_id, source, n_tokens)``."""

    def count(batches):
        enc = encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": n})

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def plan(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source: share, cap, tokens, tokens wanted and copy rate.  The table of targets is small by its meaning."""
    wanted = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    have = counts.filter(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    both = wanted.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    live = (F.col("tokens") > 0) & (F.col("share") > 0) & (F.col("cap") > 0)
    scale = both.agg(F.sum(F.when(live, F.col("share"))).alias("whole"), F.min(F.when(live, F.col("tokens") * F.col("cap") / F.col("share"))).alias("most")).first()
    whole, most = scale.whole or 1.0, (scale.most or 0.0) * (scale.whole or 0.0)
    goal = F.when(live, F.col("share") / whole * (most if total is None else min(float(total), most))).otherwise(0.0)
    sized = both.withColumn("goal", goal).withColumn("rate", F.when(live, F.least(F.col("cap").cast("double"), F.col("goal") / F.col("tokens"))).otherwise(0.0))
    return sized.select("source", "share", "cap", "tokens", "goal", "rate")


def coin(i: int, j: int, level: int) -> float:
    """A number in [0, 1) that depends on two ids and a level, by mixing 64-bit words."""
    x = (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9 + SEED) & _WORD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & _WORD
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _trade(ids, sizes, parts, toss, held=None):
    """Pivotal rounding in token mass: (whole numbers found, the one document left with its fraction); ``held`` is left from before."""
    done_ids, done = [], []
    for i, n, p in zip(ids, sizes, parts, strict=True):
        if p <= 1e-12 or p >= 1 - 1e-12:
            done_ids.append(i)
            done.append(round(p))
            continue
        if held is None:
            held = (i, n, p)
            continue
        j, m, q = held
        up = min((1 - p) * n, q * m)  # mass that i can take from j
        down = min(p * n, (1 - q) * m)  # mass that j can take from i
        shift = up if toss(i, j) * (up + down) < down else -down
        p, q = p + shift / n, q - shift / m
        held = None
        for k, size, x in ((i, n, p), (j, m, q)):
            if x <= 1e-9 or x >= 1 - 1e-9:
                done_ids.append(k)
                done.append(round(x))
            else:
                held = (k, size, x)
    return done_ids, done, held


ROUNDED = "doc_id bigint, source string, leaf bigint, n_tokens bigint, extra int, fraction double"


def _rounder(level: int):
    """Rounds rows that come sorted by leaf and source; ``fraction`` is null for documents that are decided."""

    def left(key, held):
        return pd.DataFrame({"doc_id": [held[0]], "source": [key[1]], "leaf": [key[0]], "n_tokens": [held[1]], "extra": [0], "fraction": [held[2]]})

    def run(batches):
        key, held = None, None
        for batch in batches:
            for mine, group in batch.groupby(["leaf", "source"], sort=False):
                if mine != key:
                    if held:
                        yield left(key, held)
                    key, held = mine, None
                done_ids, done, held = _trade(group["doc_id"].tolist(), group["n_tokens"].tolist(), group["fraction"].tolist(), lambda i, j: coin(i, j, level), held)
                if done_ids:
                    yield pd.DataFrame({"doc_id": done_ids, "source": mine[1], "leaf": mine[0], "n_tokens": 0, "extra": done, "fraction": None})
        if held:
            yield left(key, held)

    return run


def mixture(counts: DataFrame, targets: DataFrame, scratch: Scratch, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, n_tokens, copies)`` of all documents with copies, and the plan."""
    goals = scratch.cut(plan(counts, targets, total))
    known = counts.filter(F.col("n_tokens") > 0).join(F.broadcast(goals.select("source", "rate")), "source")
    whole = F.floor(F.col("rate") + 1e-12)
    split = known.select("doc_id", "source", "n_tokens", whole.cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("fraction"))
    split = scratch.cut(split)
    open_rows = split.filter(F.col("fraction") > 0).select("doc_id", "source", "n_tokens", "fraction")
    leaves = max(1, -(-open_rows.count() // LEAF))
    left = open_rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)))
    decided, level = None, 0
    while True:
        # large documents first, so that the one left over is small
        met = left.repartition("leaf").sortWithinPartitions("leaf", "source", F.col("n_tokens").desc(), "doc_id")
        rounded = scratch.cut(met.mapInPandas(_rounder(level), ROUNDED))
        done = rounded.filter(F.col("fraction").isNull())
        decided = done if decided is None else decided.unionByName(done)
        left = rounded.filter(F.col("fraction").isNotNull()).select("doc_id", "source", "n_tokens", "fraction", F.floor(F.col("leaf") / FAN_IN).alias("leaf"))
        if leaves == 1:
            break
        leaves, level = -(-leaves // FAN_IN), level + 1
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = left.select("doc_id", F.when(chance < F.col("fraction"), 1).otherwise(0).alias("extra"))
    extras = decided.select("doc_id", "extra").unionByName(last).filter(F.col("extra") > 0)
    full = split.join(extras.hint("merge"), "doc_id", "left")  # grows with the documents: never broadcast
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return full.select("doc_id", "source", "n_tokens", copies.alias("copies")).filter(F.col("copies") > 0), goals


def shares(mixed: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: tokens wanted and reached, target and actual share in parts per million, most copies of a document."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    both = goals.join(got, "source", "left")
    whole = got.agg(F.sum("reached").alias("whole")).first().whole or 0
    ppm = lambda c: F.round(c * 1e6).cast("bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return both.select(
        "source",
        ppm(F.col("share")).alias("target_ppm"),
        F.coalesce(ppm(F.try_divide(F.coalesce("reached", F.lit(0)), F.lit(whole))), F.lit(0)).alias("share_ppm"),
        F.round("goal").cast("bigint").alias("wanted_tokens"),
        zero("reached"),
        zero("documents"),
        zero("most_copies"),
        F.col("cap").cast("bigint").alias("max_repeats"),
    )
