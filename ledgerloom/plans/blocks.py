"""Window functions over groups of any size.

A plain window puts a whole group into one task.  Here a group is cut into blocks of
bounded size, the window runs inside a block, and one row per block carries what the next
block needs.  The number of blocks of a group is what bounds the second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_in_order(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 65536, lead: bool = False, block: Column | None = None) -> DataFrame:
    """``lag(value)`` (or ``lead``) over ``keys`` by the non-negative integer ``order``, in blocks of ``width`` orders.

    Rows of one key have distinct ``order`` values; ``value`` is not null, so null in ``out``
    means that there is no row before (after).  An order fits an int, so a key has at most
    2**31 / width blocks, which bounds the window over blocks.  ``block`` cuts orders of other types: it must grow with ``order``.
    """
    block = F.floor(F.col(order) / F.lit(width)) if block is None else block
    cut = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc() if lead else F.col(order).asc())
    outer = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if lead else F.col("_block").asc())
    cut = cut.withColumn("_near", F.lag(value).over(inner)).withColumn("_edge", F.row_number().over(inner) == 1)
    pick = F.min_by if lead else F.max_by
    edges = cut.groupBy(*keys, "_block").agg(pick(value, order).alias("_carry"))
    edges = edges.withColumn("_carry", F.lag("_carry").over(outer)).filter(F.col("_carry").isNotNull())
    edges = edges.withColumn("_edge", F.lit(True))
    out_df = cut.join(edges, [*keys, "_block", "_edge"], "left")
    return out_df.withColumn(out, F.coalesce("_near", "_carry")).drop("_block", "_near", "_edge", "_carry")


def _ranked(df: DataFrame, minor: str) -> DataFrame:
    """``_minor``: the int ``minor`` as a non-negative integer, null first."""
    return df.withColumn("_minor", F.coalesce(F.col(minor).cast("bigint") + (1 << 31) + 1, F.lit(0)))


def previous_by_turn(df: DataFrame, keys: list[str], value: str, out: str, turn: str = "observed_turn", minor: str = "seq", lead: bool = False) -> DataFrame:
    """``lag(value)`` (or ``lead``) over ``keys`` by (turn, minor), which is unique within a key; ``turn`` isn't negative, ``value`` not null.

    Within a turn in blocks of ``minor``, over turns in blocks of turns: neither many turns nor many rows of one turn meet in one task.
    """
    inside = previous_in_order(_ranked(df, minor), [*keys, turn], "_minor", value, "_inside", lead=lead)
    pick = F.min_by if lead else F.max_by
    ends = _ranked(df, minor).groupBy(*keys, turn).agg(pick(value, "_minor").alias("_end"))
    over = previous_in_order(ends, keys, turn, "_end", "_over", lead=lead).filter(F.col("_over").isNotNull()).select(*keys, turn, "_over")
    return inside.join(over, [*keys, turn], "left").withColumn(out, F.coalesce("_inside", "_over")).drop("_minor", "_inside", "_over")


def carried_in_order(df: DataFrame, keys: list[str], order: str, value: str, width: int = 65536) -> DataFrame:
    """Fill nulls of ``value`` with the last one before by the non-negative integer ``order``, in blocks of ``width`` orders."""
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    blocks = cut.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    blocks = blocks.withColumn("_in", F.last("_last", ignorenulls=True).over(outer)).filter(F.col("_in").isNotNull()).drop("_last")
    out = cut.withColumn("_own", F.last(value, ignorenulls=True).over(inner)).join(blocks, [*keys, "_b"], "left")
    return out.withColumn(value, F.coalesce("_own", "_in")).drop("_b", "_own", "_in")


def carried_by_turn(df: DataFrame, keys: list[str], value: str, turn: str = "observed_turn", minor: str = "seq") -> DataFrame:
    """The same by (turn, minor): within a turn in blocks of ``minor``, over turns in blocks of turns."""
    ends = _ranked(df, minor).groupBy(*keys, turn).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_minor"))).alias("_end"))
    known = carried_in_order(ends, keys, turn, "_end")
    before = previous_in_order(known.withColumn("_end", F.struct("_end")), keys, turn, "_end", "_over").select(*keys, turn, F.col("_over._end").alias("_over")).filter(F.col("_over").isNotNull())
    inside = carried_in_order(_ranked(df, minor), [*keys, turn], "_minor", value)
    return inside.join(before, [*keys, turn], "left").withColumn(value, F.coalesce(value, "_over")).drop("_minor", "_over")


def running_total(df: DataFrame, key: str, order: str, value: str, out: str, per_block: int = 100_000) -> DataFrame:
    """Sum of ``value`` over the rows of ``key`` before this one, in a fixed order, for keys with any number of rows.

    The order is by hash block, then by ``order`` (unique within a key); a key gets
    ceil(rows / per_block) blocks.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    big = sizes.filter(F.col("_rows") > per_block).select(key, F.ceil(F.col("_rows") / per_block).alias("_n"))
    cut = df.join(big, key, "left").withColumn(
        "_block", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(order), F.coalesce("_n", F.lit(1))))
    )
    inner = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    # only keys of more than one block need what lies before a block
    before = (
        cut.filter(F.col("_n").isNotNull())
        .groupBy(key, "_block")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_ahead", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
        .drop("_total")
    )
    out_df = cut.join(before, [key, "_block"], "left")
    return out_df.withColumn(out, F.col("_in") + F.coalesce("_ahead", F.lit(0))).drop("_n", "_block", "_in", "_ahead")


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per ``keys``: that with the greatest ``order``; ties by the kept columns, so that the result is fixed.

    A map-side aggregate of a struct, which a hot key can't overload.
    """
    ranked = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in keep]))
    return df.groupBy(*keys).agg(ranked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in keep])


def running_total_in_order(df: DataFrame, keys: list[str], order: str, value: str, out: str, descending: bool = False, width: int = 65536) -> DataFrame:
    """Sum of ``value`` from the first row of ``keys`` to this one, by the non-negative integer ``order``, in blocks of ``width`` orders.

    Rows with equal order come in as one (RANGE frame), so the result doesn't depend on how ties are read.
    """
    up = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    cut = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(*keys, "_block").orderBy(up(order)).rangeBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(up("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_total")).withColumn("_ahead", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    cut = cut.withColumn("_in", F.sum(value).over(inner))
    return cut.join(blocks, [*keys, "_block"]).withColumn(out, F.col("_in") + F.col("_ahead")).drop("_block", "_in", "_ahead")
