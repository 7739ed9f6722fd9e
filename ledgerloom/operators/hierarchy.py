"""Parent-child links to full hierarchies, by heavy-path decomposition.

``hierarchy(nodes)`` takes one row per node, ``(id, parent)``, and labels every node with its
chain.  A chain is a maximal run of heavy links (each inner node's link to the child with
the largest subtree), so a way to the root crosses at most log2(n) chains.  Hence:

* the **path** of a node is a list of at most log2(n) chain segments ``(chain, upto)``: the
  nodes of that chain from its head to position ``upto``;
* the **descendants** of a node are one interval of its tree's order: ``[tin, tin + size)``;
* depth and root follow from the segments.

Everything runs in a logarithmic number of joins: ancestors at distance 2**k and subtree
counts of depth under 2**k are doubled together, and nodes that reach no root are separated
first, by the same doubling.  No tree, chain or level is ever gathered in one task.  Nodes have
numbers while this runs, so that the rounds hash and shuffle eight bytes a node; names are joined back at the end.

Defined results: null ids are left out; repeated ids count once, with the smallest non-null
parent; a parent that is no node is void; a node on or below a cycle gets ``depth`` -1 and
as ``root`` the smallest id of the cycle it runs into.  Such cycles are cut: each node of a
cycle heads the tree that hangs below it, where chains, segments and sizes are as in any
tree, and the trees of one cycle share one order, so that a path ends at the cycle and
``[tin, tin + size)`` is a node's tree.  Every node that runs into a cycle is a descendant of
all nodes on it: ``[first, end)`` is that whole order for nodes on a cycle, and the node's
tree elsewhere.  Other columns of the input are ignored, whatever their names.  An empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.blocks import running_total
from ..plans.scratch import Scratch


#: Order numbers to a stretch of ``expand_descendants``.
STRETCH = 1024


def hierarchy(nodes: DataFrame, scratch: Scratch, paths: bool = True) -> DataFrame:
    """``(id, parent, root, depth, size, chain, pos, segments, tin, first, end)`` for every node; without ``paths`` only ``(id, root, depth, size)``."""
    base, alone, names = _clean(nodes, scratch)
    return _linked(base, names, scratch, paths).unionByName(_single(alone, names, paths))


def _single(alone: DataFrame, names: DataFrame, paths: bool) -> DataFrame:
    """Nodes with neither parent nor child."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = alone.join(names, "id").select(F.col("name").alias("id"), F.col("name").alias("root"), zero.alias("depth"), one.alias("size"))
    if not paths:
        return rows
    own = F.array(F.struct(F.col("id").alias("chain"), zero.alias("upto")))
    return rows.withColumns({"parent": F.lit(None).cast("string"), "chain": F.col("id"), "pos": zero, "segments": own, "tin": zero, "first": zero, "end": one})


def _linked(base: DataFrame, names: DataFrame, scratch: Scratch, paths: bool) -> DataFrame:
    sized, ring = _sizes_and_cycles(base, names, scratch)
    chained = _chains(sized, scratch)
    tops = _chain_tree(chained, names, scratch)
    placed = chained.join(tops.withColumnRenamed("head", "chain"), "chain").join(names, "id")
    depth, tin = (F.col("pos") + F.col("above")).alias("depth"), (F.col("pos") + F.col("tin_head")).alias("tin")
    if not paths:
        tree = placed.select(F.col("name").alias("id"), F.col("root_name").alias("root"), "root_id", depth, "size")
        if ring is None:
            return tree.drop("root_id")
        at = ring.select(F.col("id").alias("root_id"), "least")
        return tree.join(at, "root_id", "left").select("id", F.coalesce("least", "root").alias("root"), F.when(F.col("least").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"), "size")
    up = names.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    own = F.array(F.struct(F.col("chain_name").alias("chain"), F.col("pos").alias("upto")))
    tree = placed.join(up, "parent", "left").select(
        F.col("name").alias("id"), F.col("parent_name").alias("parent"), F.col("root_name").alias("root"), "root_id", F.col("id").alias("_id"), depth, "size", F.col("chain_name").alias("chain"), "pos", F.concat(own, "segments").alias("segments"), tin
    )
    if ring is None:
        return tree.drop("root_id", "_id").withColumns({"first": F.col("tin"), "end": F.col("tin") + F.col("size")})
    return _closed_rings(tree, ring)


def _clean(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, parent) as numbers, void parents null; (id) of the nodes without any link, which need no rounds; and (id, name)."""
    one = nodes.select("id", "parent").filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    # sorted, so that numbers don't depend on the order in which rows arrive; written, so that they stay
    one = scratch.cut(one.sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("n"), "id", "parent"))
    known = one.select(F.col("id").alias("parent"), F.col("n").alias("_up"))
    base = one.filter(F.col("parent").isNotNull()).select("n", "parent").join(known, "parent").select(F.col("n").alias("id"), F.col("_up").alias("parent"))
    none = F.lit(None).cast("bigint").alias("parent")
    every = one.select(F.col("n").alias("id"), none, F.lit(0).alias("kids")).unionByName(base.withColumn("kids", F.lit(0))).unionByName(base.select(F.col("parent").alias("id"), none, F.lit(1).alias("kids")))
    linked = scratch.cut(every.groupBy("id").agg(F.max("parent").alias("parent"), F.max("kids").alias("kids")))
    bare = F.col("parent").isNull() & (F.col("kids") == 0)
    return linked.filter(~bare).select("id", "parent"), linked.filter(bare).select("id"), one.select(F.col("n").alias("id"), F.col("id").alias("name"))


def _sizes_and_cycles(base: DataFrame, names: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``(id, parent, size)`` of the forest with its cycles cut, and the nodes on cycles (None if there are none)."""
    state, left = _doubled(base, scratch)
    sized = state.filter(F.col("jump").isNull()).drop("jump")
    if not left:
        return sized, None
    stuck = state.filter(F.col("jump").isNotNull()).select("id", "parent")
    ring = _cycles(stuck.join(names, "id"), left, scratch)
    heads = ring.select("id", F.lit(True).alias("_head"))
    cut = stuck.join(heads, "id", "left").select("id", F.when(F.col("_head").isNull(), F.col("parent")).alias("parent"))
    hanging = _doubled(cut, scratch)[0].drop("jump")
    return sized.unionByName(hanging), _ring_order(ring, hanging, scratch)


def _doubled(base: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Doubling: ``jump`` is the ancestor at distance 2**k, ``size`` counts descendants nearer than that; and how many ways never end.

    A round after which no further way has ended shows that the rest never ends: were a node
    2**k or more below a root, its ancestors would fill every smaller depth.
    """
    state, open_now = scratch.cut_counting(base.withColumn("jump", F.col("parent")).withColumn("size", F.lit(1).cast("bigint")), F.col("jump").isNotNull())
    open_before = None
    while True:
        ways = state.filter(F.col("jump").isNotNull())
        if open_now == 0 or open_now == open_before:
            return state, open_now
        open_before = open_now
        onward = state.select(F.col("id").alias("jump"), F.col("jump").alias("_next"))
        stepped = ways.select("id", "jump").join(onward, "jump")
        none, nought = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
        # one aggregate takes the node itself, its next jump, and the counts sent to it, combined before the shuffle
        kept = state.select("id", "parent", none.alias("jump"), "size")
        moved = stepped.select("id", none.alias("parent"), F.col("_next").alias("jump"), nought.alias("size"))
        sent = ways.select(F.col("jump").alias("id"), none.alias("parent"), none.alias("jump"), "size")
        fresh = kept.unionByName(moved).unionByName(sent).groupBy("id").agg(F.max("parent").alias("parent"), F.max("jump").alias("jump"), F.sum("size").alias("size"))
        old = state
        state, open_now = scratch.cut_counting(fresh, F.col("jump").isNotNull())
        scratch.drop(old)


def _cycles(stuck: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """``(id, parent, least)`` of the nodes on cycles, with the smallest id of each one's cycle."""
    state = stuck.select("id", "parent", F.col("parent").alias("jump"), F.col("name").alias("least"), F.col("name").alias("own"))
    for _ in range(max(1, math.ceil(math.log2(count)))):
        other = state.select(F.col("id").alias("jump"), F.col("jump").alias("_next"), F.col("least").alias("_least"))
        state = scratch.cut(
            state.join(other, "jump").select("id", "parent", F.col("_next").alias("jump"), F.least("least", "_least").alias("least"), "own")
        )
    # after 2**k >= count steps every way is on its cycle and all nodes of the cycle are reached; a stretch of that length has seen all of it
    reached = state.select(F.col("jump").alias("id")).distinct()
    return scratch.cut(state.join(reached, "id").select("id", "parent", "least", "own"))


def _ring_order(ring: DataFrame, hanging: DataFrame, scratch: Scratch) -> DataFrame:
    """Per node on a cycle its real parent, where its tree starts in the cycle's order, and the length of that order."""
    sized = ring.join(hanging.select("id", "size"), "id")
    total = sized.groupBy("least").agg(F.sum("size").alias("whole"))
    offset = running_total(sized, "least", "id", "size", "offset")
    up = ring.select(F.col("id").alias("parent"), F.col("own").alias("_parent"))
    return scratch.cut(offset.join(total, "least").join(up, "parent").select("id", "_parent", "least", "offset", "whole"))


def _closed_rings(tree: DataFrame, ring: DataFrame) -> DataFrame:
    """Put the trees that hang at cycles into their cycles' orders, and give the nodes on cycles their parents back."""
    at = ring.select(F.col("id").alias("root_id"), "least", "offset", "whole", "_parent")
    on = F.col("least").isNotNull() & (F.col("_id") == F.col("root_id"))
    tin = F.col("tin") + F.coalesce("offset", F.lit(0))
    return tree.join(at, "root_id", "left").select(
        "id",
        F.when(on, F.col("_parent")).otherwise(F.col("parent")).alias("parent"),
        F.coalesce("least", "root").alias("root"),
        F.when(F.col("least").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        "size",
        "chain",
        "pos",
        "segments",
        tin.alias("tin"),
        F.when(on, F.lit(0)).otherwise(tin).cast("bigint").alias("first"),
        F.when(on, F.col("whole")).otherwise(tin + F.col("size")).alias("end"),
    )


def _chains(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """Chain head and position of every node, by doubling along heavy links only."""
    heavy = (
        sized.filter(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.max(F.struct("size", "id")).alias("_h"))
        .select(F.col("_h.id").alias("id"), F.lit(True).alias("heavy"))
    )
    state = sized.join(heavy, "id", "left").select(
        "id",
        "parent",
        "size",
        F.coalesce("heavy", F.lit(False)).alias("heavy"),
        F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("chain"),
        F.when(F.col("heavy"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("pos"),
        F.coalesce(~F.col("heavy"), F.lit(True)).alias("ended"),
    )
    state, left = scratch.cut_counting(state, ~F.col("ended"))
    while left:
        other = state.select(F.col("id").alias("chain"), F.col("chain").alias("_to"), F.col("pos").alias("_pos"), F.col("ended").alias("_ended"))
        moved = (
            state.filter(~F.col("ended"))
            .join(other, "chain")
            .select("id", "parent", "size", "heavy", F.col("_to").alias("chain"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_ended").alias("ended"))
        )
        old = state
        state, left = scratch.cut_counting(state.filter("ended").unionByName(moved), ~F.col("ended"))
        scratch.drop(old)
    return state.drop("ended")


def _chain_tree(chained: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """Per chain: its name, its root and the root's name, the depth and order number of its head, and the segments above it."""
    heads = chained.filter(F.col("id") == F.col("chain")).select(F.col("id").alias("head"), "parent", "size")
    heads = scratch.cut(heads.join(names.select(F.col("id").alias("head"), F.col("name").alias("chain_name")), "head"))
    above = heads.select(F.col("head").alias("up"), F.col("chain_name").alias("_up_name"))
    light = running_total(heads.filter(F.col("parent").isNotNull()), "parent", "head", "size", "_before")
    heavy = chained.filter("heavy").select("parent", F.col("size").alias("_heavy"))
    at = chained.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("_at"))
    placed = (
        light.join(heavy, "parent", "left")
        .join(at, "parent")
        .join(above, "up")
        .select(
            "head",
            "chain_name",
            F.lit(None).cast("bigint").alias("root_id"),
            F.lit(None).cast("string").alias("root_name"),
            F.array(F.struct(F.col("_up_name").alias("chain"), F.col("_at").alias("upto"))).alias("segments"),
            (F.col("_at") + 1).alias("above"),
            (F.col("_at") + 1 + F.coalesce("_heavy", F.lit(0)) + F.col("_before")).alias("tin_head"),
            "up",
        )
    )
    roots = heads.filter(F.col("parent").isNull()).select(
        "head",
        "chain_name",
        F.col("head").alias("root_id"),
        F.col("chain_name").alias("root_name"),
        F.array().cast("array<struct<chain:string,upto:bigint>>").alias("segments"),
        F.lit(0).cast("bigint").alias("above"),
        F.lit(0).cast("bigint").alias("tin_head"),
        F.lit(None).cast("bigint").alias("up"),
    )
    state, left = scratch.cut_counting(roots.unionByName(placed), F.col("root_id").isNull())
    while left:
        other = state.select(
            F.col("head").alias("up"),
            F.col("root_id").alias("_root"),
            F.col("root_name").alias("_root_name"),
            F.col("segments").alias("_segments"),
            F.col("above").alias("_above"),
            F.col("tin_head").alias("_tin"),
            F.col("up").alias("_up"),
        )
        moved = (
            state.filter(F.col("root_id").isNull())
            .join(other, "up")
            .select(
                "head",
                "chain_name",
                F.col("_root").alias("root_id"),
                F.col("_root_name").alias("root_name"),
                F.concat("segments", "_segments").alias("segments"),
                (F.col("above") + F.col("_above")).alias("above"),
                (F.col("tin_head") + F.col("_tin")).alias("tin_head"),
                F.col("_up").alias("up"),
            )
        )
        old = state
        state, left = scratch.cut_counting(state.filter(F.col("root_id").isNotNull()).unionByName(moved), F.col("root_id").isNull())
        scratch.drop(old)
    return state.drop("up")


def expand_paths(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(id, ancestor, depth)``: the nodes on the way of each (wanted) node, itself included.

    Segments are opened into (chain, position) pairs, which an equi-join turns into ids, so
    the work is the size of the result.  Where no root is reached, the path starts at the node
    on the cycle that the way runs into, which has depth 0 here.
    """
    steps = F.aggregate("segments", F.lit(0).cast("bigint"), lambda n, s: n + s["upto"] + 1) - 1
    rows = tree.withColumn("depth", steps)
    picked = rows.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else rows
    opened = picked.select("id", F.explode("segments").alias("s")).select("id", F.col("s.chain").alias("chain"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s.upto"))).alias("pos"))
    members = rows.select("chain", "pos", F.col("id").alias("ancestor"), "depth")
    return opened.join(members, ["chain", "pos"]).select("id", "ancestor", "depth")


def expand_descendants(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, descendant)`` for the wanted nodes: all nodes whose order number lies in the node's interval.

    For a node on a cycle these are the nodes of its hanging tree; all nodes with its ``root`` are its descendants too.
    Intervals and order numbers meet by root and stretch of ``STRETCH`` numbers: a tree of any size is many keys, and an interval as many as it has stretches.
    """
    span = tree.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "root", F.col("tin").alias("_from"), (F.col("tin") + F.col("size")).alias("_to"))
    span = span.filter(F.col("_to") - F.col("_from") > 1).withColumn("_at", F.explode(F.sequence(F.floor((F.col("_from") + 1) / STRETCH), F.floor((F.col("_to") - 1) / STRETCH))))
    below = tree.select(F.col("id").alias("descendant"), "root", "tin", F.floor(F.col("tin") / STRETCH).alias("_at"))
    return span.join(below, ["root", "_at"]).filter((F.col("tin") > F.col("_from")) & (F.col("tin") < F.col("_to"))).select("id", "descendant")


def resolve_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Turn references in any spelling into node ids.

    ``refs``: (owner, ref); ``ids``: (id), written ``<episode>/<kind and number>@<hash>``.  A
    reference may lack the episode (its owner's is meant), the hash or both; outer blanks
    don't count; a given hash must agree.  Returns (owner, target) for those that match.
    """
    word = strip(F.col("ref"))
    keys = ids.select(F.col("id").alias("target"), episode_of("id").alias("_episode"), short_of("id").alias("_short"), hash_of("id").alias("_hash"))
    asked = refs.select("owner", word.alias("_ref")).filter(F.length("_ref") > 0)
    asked = asked.select(
        "owner",
        F.when(F.instr("_ref", "/") > 0, episode_of("_ref")).otherwise(episode_of("owner")).alias("_episode"),
        short_of("_ref").alias("_short"),
        hash_of("_ref").alias("_asked"),
    )
    hit = asked.join(keys, ["_episode", "_short"])
    return hit.filter((F.col("_asked") == "") | (F.col("_asked") == F.col("_hash"))).select("owner", "target")


def episode_of(name: str):
    """What stands before the last ``/`` of an id."""
    return F.regexp_extract(name, r"(?s)^(.*)/[^/]*$", 1)


def short_of(name: str):
    """Kind and number of an id: after the last ``/``, before ``@``."""
    return F.regexp_extract(name, r"(?s)([^/@]*)(?:@[^/]*)?$", 1)


def hash_of(name: str):
    """What follows ``@`` in an id, else an empty string."""
    return F.regexp_extract(name, r"(?s)@([^/@]*)$", 1)
