import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import versions as V
from ledgerloom.plans.blocks import previous_in_order
from ledgerloom.plans.scratch import Scratch

SCHEMA = "episode_id string, slot string, value string, observed_turn int, seq int, erased boolean"


def claims(spark, rows, rank=1):
    return V.claims(spark.createDataFrame(rows, SCHEMA), "observed_turn", rank, F.col("seq"))


def sweep(rows):
    """(slot, from, to) by a plain walk."""
    best = {}
    for e, slot, value, turn, seq, erased in rows:
        if e is None or slot is None or turn is None or turn < 0 or (not erased and not (value or "").strip()):
            continue
        key = "" if erased else "".join(c for c in value.lower() if c.isalnum())
        name = " ".join(slot.lower().replace("_", " ").replace("-", " ").split())
        at = (e, name, turn)
        best[at] = max(best.get(at, (-2, "")), (seq if seq is not None else -1, key))
    out = set()
    for e, name in {k[:2] for k in best}:
        turns = sorted(t for a, b, t in best if (a, b) == (e, name))
        starts = [t for i, t in enumerate(turns) if not i or best[e, name, t][1] != best[e, name, turns[i - 1]][1]]
        out |= {(e, name, t, starts[i + 1] if i + 1 < len(starts) else -1) for i, t in enumerate(starts)}
    return out


def rows_of(df):
    return {(r.episode_id, r.slot, r.valid_from_turn, r.valid_to_turn) for r in df.collect()}


def test_spelling_ties_blanks_erasures(spark):
    rows = [
        ("e", "Tea Blend", "Green", 1, 1, False), ("e", " tea_blend ", "green!", 3, 2, False), ("e", "tea-blend", "Black", 5, 3, False),
        ("e", "tea blend", "White", 5, 4, False), ("e", "tea blend", "　", 6, 9, False), ("e", "tea blend", None, 7, 9, False),
        ("e", "tea blend", "gone", 9, 5, True), ("e", "tea blend", "x", -1, 6, False), ("e", "tea blend", "x", None, 6, False), ("e", None, "x", 2, 6, False), (None, "s", "x", 2, 6, False),
        ("e", "tea blend", "Black", 5, 3, False),
    ]
    assert rows_of(V.versions(claims(spark, rows))) == {("e", "tea blend", 1, 5), ("e", "tea blend", 5, 9), ("e", "tea blend", 9, -1)} == sweep(rows)


def test_ledger_beats_store_and_late_claims_split(spark):
    stored = claims(spark, [("e", "s", "old", 4, 9, None)], rank=0)
    noted = claims(spark, [("e", "s", "a", 1, 1, False), ("e", "s", "b", 4, 2, False), ("e", "s", "late", 2, 7, False)])
    both = stored.unionByName(noted)
    assert rows_of(V.versions(both)) == {("e", "s", 1, 2), ("e", "s", 2, 4), ("e", "s", 4, -1)}
    assert rows_of(V.versions(noted, as_of=(1, 2))) == {("e", "s", 1, 4), ("e", "s", 4, -1)}
    kept = {(r.turn, r["rank"], r.superseded_rank) for r in V.ledger(both).collect()}
    assert kept == {(1, 1, None), (2, 1, None), (4, 0, 1), (4, 1, None)}


def test_late_claims_close_recorded_periods(spark):
    noted = claims(spark, [("e", "s", "a", 1, 1, False), ("e", "s", "b", 4, 2, False), ("e", "s", "late", 2, 7, False), ("e", "s", "again", 4, 8, False)])
    got = {(r.value, r.turn, r.until, r.record, r.until_record) for r in V.intervals(noted, Scratch(spark, "t")).collect()}
    assert got == {("a", 1, None, 1, 2), ("a", 1, 4, 2, 7), ("a", 1, 2, 7, None), ("late", 2, 4, 7, None), ("b", 4, None, 2, 8), ("again", 4, None, 8, None)}


def plain_intervals(rows):
    """(slot, value key, from, to, record, until) by replaying the claims one record number after the other."""
    seen = {}
    for e, slot, value, turn, seq, erased in rows:
        if turn is None or turn < 0 or (not erased and not (value or "").strip()):
            continue
        key = "" if erased else "".join(c for c in value.lower() if c.isalnum())
        at = (" ".join(slot.lower().replace("_", " ").split()), turn, seq)
        seen[e, at] = max(seen.get((e, at), ""), key)
    out = set()
    for e, slot in {(e, at[0]) for e, at in seen}:
        mine = {at[1:]: key for (e2, at), key in seen.items() if (e2, at[0]) == (e, slot)}
        open_rows = {}
        for seq in sorted({s for _, s in mine}):
            known = {}
            for (t, s), key in sorted(mine.items(), key=lambda x: x[0][1]):
                if s <= seq:
                    known[t] = key
            for t, key in known.items():
                to = min((u for u in known if u > t), default=None)
                row = open_rows.get(t)
                if row is None or (t, seq) in mine or row[1] != to:
                    if row:
                        out.add((e, slot, row[0], t, row[1], row[2], seq))
                    open_rows[t] = (key, to, seq)
        out |= {(e, slot, key, t, to, s, None) for t, (key, to, s) in open_rows.items()}
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.just("a"), st.sampled_from(["S", "t_t"]), st.sampled_from(["x", "y", " ", "z"]), st.sampled_from([0, 1, 2, 5, 63, 64, 70, 5000, 70000, 300000, -1]), st.integers(0, 9), st.booleans()), max_size=40))
def test_intervals_equal_a_replay(spark, rows):
    got = {(r.episode_id, r.slot, r.key, r.turn, r.until, r.record, r.until_record) for r in V.intervals(claims(spark, rows), Scratch(spark, "t")).collect()}
    assert got == plain_intervals(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("e", "s", "v", 1, 1, False)], SCHEMA).withColumn("key", F.lit("k")).withColumn("turn", F.lit(99)).withColumn("_block", F.lit(1))
    assert rows_of(V.versions(V.claims(df, "observed_turn", 1, F.col("seq")))) == {("e", "s", 1, -1)}
    assert V.versions(V.claims(df.limit(0), "observed_turn", 1, F.col("seq"))).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["S", "s ", "t_t"]), st.sampled_from(["x", "X.", "y", " ", None]), st.sampled_from([0, 1, 2, 70000, 200000, -1, None]), st.integers(0, 4), st.booleans()), max_size=40))
def test_equals_a_plain_walk(spark, rows):
    assert rows_of(V.versions(claims(spark, rows))) == sweep(rows)


@pytest.mark.parametrize("lead", [False, True])
def test_blocks_equal_a_window(spark, lead):
    rng = random.Random(1)
    rows = [(k, t, f"{k}{t}") for k in "ab" for t in rng.sample(range(1000), 60)]
    got = previous_in_order(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], "t", "v", "p", width=16, lead=lead).collect()
    for k in "ab":
        order = sorted((r for r in got if r.k == k), key=lambda r: -r.t if lead else r.t)
        assert [r.p for r in order] == [None] + [r.v for r in order[:-1]]
