import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as H
from ledgerloom.plans.blocks import running_total
from ledgerloom.plans.scratch import Scratch


def brute(parents):
    """id -> (root, depth), by walking."""
    out = {}
    for v in parents:
        seen, at = [], v
        while at is not None and at not in seen:
            seen.append(at)
            up = parents.get(at)
            at = up if up in parents else None
        out[v] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at) :]), -1)
    return out


def shapes():
    rng = random.Random(3)
    chain = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(90)}
    star = {"hub": None} | {f"s{i:03d}": "hub" for i in range(70)}
    wild = {f"w{i:03d}": rng.choice([None] * 1 + [f"w{j:03d}" for j in range(i)]) if i else None for i in range(120)}
    rings = {"r0": "r1", "r1": "r2", "r2": "r0", "t0": "r1", "t1": "t0", "self": "self", "below": "self"}
    return chain | star | wild | rings | {"orphan": "nobody"}


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id string, parent string")


def test_roots_depths_cycles_and_expansions(spark):
    parents = shapes()
    tree = H.hierarchy(frame(spark, parents), Scratch(spark, "t")).cache()
    rows = {r.id: r for r in tree.collect()}
    assert {k: (r.root, r.depth) for k, r in rows.items()} == brute(parents)
    ways = {}
    for r in H.expand_paths(tree).collect():
        ways.setdefault(r.id, {})[r.depth] = r.ancestor
    for v, (root, depth) in brute(parents).items():
        if depth >= 0:
            path, at = [], v
            while at in parents:
                path.append(at)
                at = parents[at]
            assert [ways[v][d] for d in range(depth + 1)] == path[::-1]
            assert max(s.upto for s in rows[v].segments) >= 0 and len(rows[v].segments) <= 9
    down = {}
    for r in H.expand_descendants(tree, tree.select("id")).collect():
        down.setdefault(r.id, set()).add(r.descendant)
    for v, w in ways.items():
        for a in w.values():
            if a != v:
                assert v in down[a]
    assert sum(map(len, down.values())) == sum(len(w) - 1 for w in ways.values())
    assert all(len(down.get(v, ())) + 1 == rows[v].size for v in ways)
    orders = {}
    for v in ways:
        orders.setdefault(rows[v].root, []).append(rows[v].tin)
    assert all(sorted(t) == list(range(len(t))) for t in orders.values())


def test_paths_and_descendants_below_cycles(spark):
    parents = shapes() | {"u0": "r1", "u1": "t0", "u2": "u1"}
    tree = H.hierarchy(frame(spark, parents), Scratch(spark, "t")).cache()
    rows = {r.id: r for r in tree.collect()}
    assert {k: (r.root, r.depth) for k, r in rows.items()} == brute(parents)
    assert {k: r.parent for k, r in rows.items()} == {k: v if v in parents else None for k, v in parents.items()}
    rings, stuck = {"r0", "r1", "r2", "self"}, [v for v, (_, d) in brute(parents).items() if d < 0]
    ways, down = {}, {}
    for r in H.expand_paths(tree).collect():
        ways.setdefault(r.id, {})[r.depth] = r.ancestor
    for r in H.expand_descendants(tree, tree.select("id")).collect():
        down.setdefault(r.id, set()).add(r.descendant)
    walked = {}
    for v in stuck:
        path, at = [v], v
        while at not in rings:
            at = parents[at]
            path.append(at)
            walked.setdefault(at, set()).add(v)
        assert [ways[v][d] for d in range(len(ways[v]))] == path[::-1]
    # by the order's interval every node finds all that run into it, on a cycle everything
    for v in stuck:
        assert down.get(v, set()) == walked.get(v, set())
        inside = {w for w in stuck if rows[w].root == rows[v].root and rows[v].first <= rows[w].tin < rows[v].end} - {v}
        assert inside == ({w for w in stuck if rows[w].root == rows[v].root} - {v} if v in rings else walked.get(v, set()))
        assert rows[v].end - rows[v].first - 1 == len(inside)


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [("a", None, 1), ("b", "a", 2), ("b", "a", 3), (None, "a", 4), ("b", None, 5)]
    df = spark.createDataFrame(rows, "id string, parent string, size int").withColumn("chain", F.lit("x")).withColumn("jump", F.lit(1))
    got = {r.id: (r.root, r.depth, r.size) for r in H.hierarchy(df, Scratch(spark, "t")).collect()}
    assert got == {"a": ("a", 0, 2), "b": ("a", 1, 1)}
    assert H.hierarchy(df.limit(0), Scratch(spark, "t")).count() == 0


def test_references_in_any_spelling(spark):
    ids = spark.createDataFrame([("e/x/s001@aa",), ("e/x/s002@bb",), ("f/s001@cc",)], "id string")
    asked = ["e/x/s002@bb", " e/x/s002 ", "s002@bb", "　s002\t", "s002@zz", "", "f/s001", None, "s999"]
    refs = spark.createDataFrame([(f"e/x/s001@aa", r) for r in asked], "owner string, ref string")
    got = [r.target for r in H.resolve_references(refs.filter("ref is not null"), ids).collect()]
    assert sorted(got) == ["e/x/s002@bb"] * 4 + ["f/s001@cc"]


@pytest.mark.parametrize("per_block", [1, 3, 1000])
def test_running_total_in_blocks(spark, per_block):
    rows = [(f"k{i % 3}", f"v{i:02d}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v string, n long")
    got = running_total(df, "k", "v", "n", "before", per_block=per_block).collect()
    assert len(got) == 40
    for k in {"k0", "k1", "k2"}:
        spans = sorted((r.before, r.before + r.n) for r in got if r.k == k)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
