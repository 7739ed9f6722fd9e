"""Ledger, audit, retrieval and text operators on small tables; the negative controls of the invariants."""

import glob
import os
import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import text as T
from ledgerloom.functions import udf as U
from ledgerloom.operators import audit as A
from ledgerloom.operators import canonical as C
from ledgerloom.operators import context as X
from ledgerloom.operators import facts as L
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import scoring as S
from ledgerloom.plans import ledger_queries
from ledgerloom.plans.scratch import Scratch

DATA = "/root/testdata/sf0.001"
LEDGER = "fact_id string, episode_id string, summary_id string, slot string, value string, seq int, observed_turn int, evidence array<string>, reason string, superseded_by string, residual_mentions int, erased boolean"


def ledger(spark, rows):
    full = [(f"{e}/s{seq:03d}@h#{slot}", e, f"{e}/s{seq:03d}@h", slot, value, seq, turn, ev, "", "", 0, erased) for e, slot, value, seq, turn, ev, erased in rows]
    return C.ledger(spark.createDataFrame(full, LEDGER))


FACTS = [("e", "tea", "green", 1, 0, ["r0"], False), ("e", "tea", "black", 2, 3, ["r1"], False), ("e", "bay", "A-1", 3, 4, ["r2"], False)]


def summaries(spark, n=3):
    return spark.createDataFrame([(f"e/s{i:03d}@h", "e", i, f"text {i} green black A-1", [], True) for i in range(1, n + 1)], "summary_id string, episode_id string, seq int, text string, fact_keys array<string>, live boolean")


def raw(spark, n=3):
    return spark.createDataFrame([(f"r{i}", "e", i, "my tea is green", "ok", 1.0) for i in range(n)], "reference_id string, episode_id string, turn_index int, user_msg string, agent_msg string, ts double")


def entries(spark):
    return spark.createDataFrame([], "index_id string, episode_id string, title string, members array<string>")


def report(spark, facts, s=3, r=3):
    return A.report(ledger(spark, facts), summaries(spark, s), entries(spark), raw(spark, r)).collect()[0]


def test_clean_episode_and_controls(spark):
    good = report(spark, FACTS)
    assert good.clean and good.facts == 3
    lost = report(spark, FACTS, s=2)  # a summary vanishes
    assert (lost.missing, lost.unresolved, lost.unreachable) == (1, 0, 0)
    unseen = report(spark, [*FACTS, ("e", "hat", "zebra", 2, 5, ["r1"], False)])  # a value that nothing shows
    assert (unseen.missing, unseen.unreachable) == (0, 1)
    bare = report(spark, [*FACTS, ("e", "tea", "green", 3, 5, [], False)])  # no evidence
    assert (bare.without_evidence, bare.unresolved) == (1, 0)
    flagged = report(spark, [*FACTS[:2], ("e", "bay", "A-1", 3, 4, ["r2"], True)])  # only flagged as erased
    assert (flagged.value_kept, flagged.evidence_resolves) == (1, 1) and not flagged.clean
    shared = report(spark, [*FACTS, ("e", "hat", "", 2, 5, ["r1"], True)])  # evidence that a surviving fact needs
    assert shared.clean and shared.erased_facts == 1


def test_erasure_plan_and_tombstones(spark):
    facts = ledger(spark, [*FACTS, ("e", "hat", "red", 2, 5, ["r1", "r9"], False)])
    doomed = facts.filter("slot = 'hat'").select("fact_id")
    assert {(r.reference_id, r.action) for r in A.erasure_plan(facts, doomed).collect()} == {("r1", "keep"), ("r9", "delete")}
    assert [r.value for r in A.erase(facts, doomed).filter("erased").collect()] == [""]


def test_extraction_recall(spark):
    signals = S.all_signals(raw(spark, 1), Scratch(spark, "t"))
    got = A.extraction(signals, ledger(spark, FACTS)).collect()[0]
    assert (got.all_candidates, got.all_captured, got.strict_candidates) == (1, 1, 0)
    dead = A.extraction(signals, ledger(spark, [("e", "x", "zzz", 1, 0, ["r0"], False)])).collect()[0]
    assert (dead.all_candidates, dead.all_captured) == (1, 0)


def test_projection_equals_current_and_as_of(spark):
    facts = ledger(spark, [*FACTS, ("e", "tea", "white", 4, 70000 * 20, ["r1"], False), ("e", "tea", "late", 9, 1, ["r1"], False)])
    rows = L.projection(facts).collect()
    opened = {(r.slot, r.value) for r in rows if r.valid_to_turn is None}
    assert opened == {(r.slot, r.value) for r in L.current(facts).collect()} == {("tea", "white"), ("bay", "A-1")}
    as_of = {(r.slot, r.value, r.valid_to_turn) for r in L.projection(facts, 1).collect()}
    assert as_of == {("tea", "green", 1), ("tea", "late", None)}


def test_overrides_and_predecessors(spark):
    facts = ledger(spark, [("e", "tea", "green", 1, 0, [], False), ("e", "tea", "Green!", 2, 1, [], False), ("e", "tea", "black", 3, 200000, [], False), ("e", "tea", "black", 4, 300000, [], False)])
    got = {(r.summary_id[-6:], r.overrider[-6:]) for r in L.overrides(facts, Scratch(spark, "t")).collect()}
    assert got == {("s001@h", "s003@h"), ("s002@h", "s003@h")}
    assert [(r.value, r.previous_value) for r in R.predecessors(facts).collect()] == [("black", "Green!")]


def test_contains_join_equals_brute_force(spark):
    values = [(e, i, v) for i, (e, v) in enumerate([("a", "x"), ("a", "of tea"), ("a", "fence 12"), ("b", "茶"), ("b", "绿茶叶"), ("a", ""), ("b", None), ("b", "zz")])]
    texts = [("a", "a cup of tea, x"), ("a", "fence 123"), ("b", "他喝绿茶叶泡的茶"), ("b", ""), ("b", None), ("a", "x" * 50000)]
    got = R.contains_join(spark.createDataFrame(values, "episode_id string, fact_id int, value string"), spark.createDataFrame(texts, "episode_id string, text string"))
    want = sorted((e, i, t) for e, i, v in values for f, t in texts if v and t and e == f and v in t)
    assert sorted((r.episode_id, r.fact_id, r.text) for r in got.collect()) == want
    twice = R.contains_join(spark.createDataFrame(values[:1], "episode_id string, fact_id int, value string"), spark.createDataFrame([("a", "x")] * 3, "episode_id string, text string"))
    assert [(r.fact_id, r.copies) for r in twice.collect()] == [(0, 3)]


def test_contains_join_on_long_texts_is_linear(spark):
    """A text of 50 kB offers an ending per character and length, and each is as short as its ending."""
    long = "".join(chr(0x4E00 + (i * i * 7919) % 20000) for i in range(50000))
    values = spark.createDataFrame([("a", 1, long[40000:40010]), ("a", 2, "nowhere")], "episode_id string, fact_id int, value string")
    assert [r.fact_id for r in R.contains_join(values, spark.createDataFrame([("a", long)], "episode_id string, text string")).collect()] == [1]


def test_budgets(spark):
    costs = spark.createDataFrame([("e", t, c) for t, c in enumerate([5, 5, 50, 5, 5])] + [("f", 70000, 999)], "episode_id string, turn int, cost long")
    assert sorted((r.episode_id, r.turn) for r in X.newest_within(costs, 12).collect()) == [("e", 3), ("e", 4), ("f", 70000)]
    assert sorted((r.episode_id, r.turn) for r in X.newest_within(costs, 12, first_always=False).collect()) == [("e", 3), ("e", 4)]
    assert sorted((r.episode_id, r.turn) for r in X.oldest_within(costs, 12).collect()) == [("e", 0), ("e", 1)]


def test_predecessors_by_override_ids(spark):
    def row(n, value, over=(), slot="tea", ts=None):
        return (f"e/s{n:03d}@h", "e", n, f"x [FACTS: {slot}={value}]", list(over), float(5000 * n) if ts is None else ts, [])

    told = [row(1, "green"), row(2, "black"), row(3, "white", ["s001"]), row(4, "White!"), row(5, "green"), row(6, "red", ["e/s002@h", "s004@h"]), row(7, "red")]
    told += [row(8, "A", slot="bay"), row(9, "B", slot="bay"), row(10, "C", ["s009", "s404"], slot="bay"), row(11, "secret", slot="bay"), row(12, "D", ["s008"], slot="bay")]
    schema = "summary_id string, episode_id string, seq int, text string, override_ids array<string>, ts double, fact_keys array<string>"
    df = spark.createDataFrame(told, schema)
    m = SimpleNamespace(scratch=Scratch(spark, "t"), archive=df.filter("seq < 7"), active=df.filter("seq >= 7"), summaries=df, ledger=ledger(spark, [("e", "bay", "", 11, 3, [], True)]))
    got = {(r.slot, r.summary_id[2:6], r.recorder[2:6], r.relation, r.previous_summary[2:6], r.previous_value) for r in ledger_queries.predecessor_recorded(m).collect()}
    assert got == {
        ("tea", "s001", "s005", "older", "s004", "White!"),
        ("tea", "s005", "s005", "older", "s004", "White!"),
        ("tea", "s002", "s002", "older", "s001", "green"),
        ("tea", "s003", "s004", "older", "s002", "black"),
        ("tea", "s004", "s004", "older", "s002", "black"),
        ("tea", "s006", "s007", "older", "s005", "green"),
        ("tea", "s007", "s007", "older", "s005", "green"),
        ("bay", "s009", "s009", "older", "s008", "A"),
        ("bay", "s010", "s010", "override", "s009", "B"),
        ("bay", "s012", "s012", "override", "s008", "A"),
    }


def test_gate_levels_and_turns_without_ordinal(spark):
    said = [("a0", 0, "my tea is green"), ("a1", 1, "nice TEA, thanks"), ("a2", 2, "what is my tea?"), ("a3", 3, "nice day"), ("a4", 4, "my tea is green"), ("b0", 0, "steamy bay")]
    said += [("a5", None, "my tea is green"), ("a6", None, "my bay is A-1"), ("a7", None, "bay watch"), ("a8", None, "tea for two"), ("a9", 9, "bay watch")]
    df = spark.createDataFrame([(r, r[0], t, text, "ok", 1.0) for r, t, text in said], "reference_id string, episode_id string, turn_index int, user_msg string, agent_msg string, ts double")
    m = SimpleNamespace(scratch=Scratch(spark, "t"), raw=df, ledger=ledger(spark, [("a", "bay", "A-1", 1, None, ["a6"], False), ("a", "tea", "green", 2, 0, ["a0"], False)]))
    kept = {r.reference_id: (r.keep_pattern, r.keep_loose, r.keep_strict) for r in S.gate_levels(S.all_signals(df, m.scratch), df).collect()}
    yes, loose, old, no = (True, True, True), (False, True, False), (True, True, False), (False, False, False)
    assert kept == {"a0": yes, "a1": loose, "a2": no, "a3": no, "a4": old, "b0": no, "a5": old, "a6": yes, "a7": no, "a8": loose, "a9": no}
    assert {r.level: (r.tp, r.fp, r.fn, r.tn) for r in ledger_queries.gate_confusion_all(m).collect()} == {"off": (2, 9, 0, 0), "pattern": (2, 2, 0, 7), "loose": (2, 4, 0, 5), "strict": (2, 0, 0, 9)}
    assert {(r.reference_id, r.slot, r.value) for r in ledger_queries.candidate_pairs_all(m).collect()} == {(i, "tea", "green") for i in ("a0", "a4", "a5")} | {("a6", "bay", "a-1")}
    assert sum(r.n for r in ledger_queries.gate_classify_all(m).collect()) == sum(r.turns for r in ledger_queries.gate_prevalence_all(m).collect()) == sum(r.turns for r in ledger_queries.gate_levels(m).collect()) == 11
    got = {r.episode_id: (r.all_candidates, r.all_captured) for r in ledger_queries.i4_extraction_all(m).collect()}
    assert got == {"a": (4, 2)}


def test_windows_and_samples_count_turns(spark):
    said = [("e", 7 * t + 3, f"r{t:02d}{d}") for t in range(12) for d in range(1 + 2 * (t == 10))] + [("f", 9, "s")]
    rows = spark.createDataFrame([(r, e, t, "my tea is green", "ok", 1.0) for e, t, r in said] + [("n", "e", None, "x", "y", 1.0)], "reference_id string, episode_id string, turn_index int, user_msg string, agent_msg string, ts double")
    got = sorted((r.episode_id, r.position, r.turn_index, r.reference_id) for r in entry_rows(spark, "sliding_turns", rows))
    assert got == [("e", 1, 80, "r110"), ("e", 2, 73, "r102"), ("e", 3, 66, "r090"), ("e", 4, 59, "r080"), ("f", 1, 9, "s")]
    got = sorted((r.episode_id, r.turn) for r in entry_rows(spark, "spread_turns", rows))
    assert got == [("e", 7 * (i * 12 // 5) + 3) for i in range(5)] + [("f", 9)]


def entry_rows(spark, name, raw_rows):
    """Rows of a registered query on the turns alone."""
    function = getattr(ledger_queries, name)
    assert name in entry.queries()
    return function(SimpleNamespace(raw=raw_rows, scratch=Scratch(spark, "t"))).collect()


def test_evictions_turn_by_turn(spark):
    rng = random.Random(5)
    episodes = {"flat": [20] * 30, "short": [500, 500, 500], "four": [500] * 4, "five": [500] * 5, "zero": [0, 0, 0, 0, 400, 0, 0, 1, 0, 0]}
    episodes |= {f"w{k}": [rng.choice([0, 0, 5, 40, 90, 150, 700]) for _ in range(rng.randint(1, 60))] for k in range(25)}
    want = {}
    for name, costs in episodes.items():
        held, out, cuts = [], [], 0
        for c in costs:
            held.append(c)
            if sum(held) > 400 and len(held) > 4:
                out, held, cuts = out + held[:-4], held[-4:], cuts + 1
        if cuts:
            want[name] = (len(out), sum(out), cuts)
    rows = [(name, 3 * t + 1, c) for name, costs in episodes.items() for t, c in enumerate(costs)]
    got = X.evictions(spark.createDataFrame(rows, "episode_id string, turn int, cost long"), 400, 4, Scratch(spark, "t"))
    assert {r.episode_id: (r.evicted, r.evicted_tokens, r.evictions) for r in got.collect()} == want
    assert want["flat"][0] == 17
    assert "evictions_by_turn" in entry.queries()


@pytest.mark.parametrize(
    "text, want",
    [("我的工位在十二楼", 9), ("", 0), (None, 0), ("a", 1), ("hello world", 4), ("こんにちは 안녕", 8), ("😀😀", 2)],
)
def test_token_estimate(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(U.token_estimate(F.col("t")).alias("n")).first().n == want


def test_scoring_and_grammar(spark):
    pairs = [("Paris.", "Paris", True), ("The answer is Paris", "paris", False), ("答案是 Paris", "Paris", True), ("Paris", "Paris", True), ("(b) sushi", "sushi", True), ("sushi", "(b) sushi", True), ("(b)", "(b) sushi", False), ("The current value is Beijing (previously Paris).", "Paris", False), ("Beijing", "Paris", False), ("I think the answer might be Shanghai, not Paris", "Paris", False), ("It is now Shanghai, but originally it was Paris.", "Paris", False), ("", "x", False), (None, "x", False), ("（Ｐａｒｉｓ）", "paris", True), ("3", "13", False)]
    df = spark.createDataFrame(pairs, "p string, g string, ok boolean")
    assert [r.ok for r in df.select((T.answers_match(F.col("p"), F.col("g")) == F.col("ok")).alias("ok")).collect()] == [True] * len(pairs)
    text = "摘要：tea changed [FACTS: tea=green；bay = A-1；none] [OVERRIDES: s001@a，none]"
    row = spark.createDataFrame([(text,)], "t string").select(T.summary_body(F.col("t")), T.summary_facts(F.col("t")), T.summary_overrides(F.col("t"))).first()
    assert list(row) == ["tea changed", ["tea=green", "bay=A-1"], ["s001@a"]]


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize(
    "text, slot, anchor",
    [
        ("Before it became pizza, what was my favourite food?", "favourite food", "pizza"), ("What was my favourite food before it became pizza?", "favourite food", "pizza"), ("What was my tea blend originally?", "tea blend", ""),
        ("在改成12楼之前，我的工位楼层是什么？", "工位楼层", "12楼"), ("我原来的所在城市是什么？", "所在城市", ""), ("What is my tea blend right now?", "tea blend", ""), ("Which locker number did I have before P-160?", "locker number", "P-160"), ("Nice day", "", ""), (None, "", ""),
    ],
)
def test_question_forms(spark, text, slot, anchor):
    assert tuple(one(spark, text, T.question_slot(F.col("t")).alias("q")).q) == (slot, anchor)


@pytest.mark.parametrize(
    "text, answer, update",
    [
        ("The tag <MEMORY_UPDATE> records memory; the answer is 3F", "The tag <MEMORY_UPDATE> records memory; the answer is 3F", ""), ("It is 3F. <MEMORY_UPDATE>Moved. [FACTS: floor=3F]</MEMORY_UPDATE>", "It is 3F.", "Moved. [FACTS: floor=3F]"),
        ("3F <memory_update>x [OVERRIDES: none]", "3F", "x [OVERRIDES: none]"), ("a <MEMORY_UPDATE>1</MEMORY_UPDATE> b <MEMORY_UPDATE>2</MEMORY_UPDATE>", "a  b", "1"), ("<MEMORY_UPDATE>Moved. [FACTS: floor=3F]</MEMORY_UPDATE>", "Moved.", "Moved. [FACTS: floor=3F]"),
        ("ok\n```memory_update\nMoved. [OVERRIDES: none]\n```", "ok", "Moved. [OVERRIDES: none]"), ("ok ```memory\nMoved. [FACTS: a=b]", "ok", "Moved. [FACTS: a=b]"), ("plain", "plain", ""), ("", "", ""),
    ],
)
def test_updates_in_replies(spark, text, answer, update):
    assert tuple(one(spark, text, T.self_written(F.col("t")).alias("s")).s) == (answer, update)


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"correct": true, "reason": "x"}', True), ('{"correct": "Yes"}', True), ('{"correct": 0}', False), ('{"correct": null}', False), ('say {"correct": false} then', False), ("That is correct.", True), ("incorrect", False), ("No.", False),
        ("It is not correct", True), ("不正确", False), ("正确", True), ("unclear", None), ("", None), (None, None),
    ],
)
def test_judge_words(spark, text, want):
    assert one(spark, text, T.judged(F.col("t")).alias("v")).v is want


def test_slot_values_and_cleaning(spark):
    cases = [("Facts: tea=green; bay = A-1.", "bay", "a-1"), ("把工位楼层从3楼改为7楼", "工位楼层", "7楼"), ("tea: green; more", "tea", "green"), ("nothing", "tea", ""), (None, "tea", ""), ("favourite tea=oolong", "tea", "oolong")]
    df = spark.createDataFrame(cases, "t string, s string, w string")
    assert [r.v for r in df.select(T.slot_value(F.col("t"), F.col("s")).alias("v")).collect()] == [w for _, _, w in cases]
    slots = {"My office_floor has changed": "office floor", "我的所在城市是什么": "所在城市", "最喜欢的饮料": "最喜欢的饮料", "the tea now": "tea", "": ""}
    values = {"the green tea now": "green tea", "alpha": "alpha", "theatre": "theatre", "是12楼了。": "12楼"}
    assert {k: one(spark, k, T.clean_slot(F.col("t")).alias("c")).c for k in slots} == slots
    assert {k: one(spark, k, T.clean_value(F.col("t")).alias("c")).c for k in values} == values


def test_extraction_keeps_whole_names(spark):
    got = one(spark, "我的所在城市是杭州。 my project is alpha.", T.candidate_pairs(F.col("t")).alias("p")).p
    assert [(p.slot, p.value) for p in got] == [("所在城市", "杭州"), ("project", "alpha")]


def test_gate_classes(spark):
    rows = [("my code name has changed - it is otter now", "change", False), ("my tea is green", "state", False), ("what is my tea?", "none", True), ("我的工位改成十二楼了", "change", False), ("x = 3", "change", False), ("nice day", "none", False), ("", "none", False)]
    got = spark.createDataFrame(rows, "t string, k string, q boolean").select(T.evidence_class(F.col("t"), T.candidate_pairs(F.col("t"))), "k", T.is_question(F.col("t")), "q").collect()
    assert all(r[0] == r.k and r[2] == r.q for r in got), got


def test_ids(spark):
    df = spark.createDataFrame([("a/b", 1234, "a/b/s1234@x#my/slot")], "e string, n int, f string")
    made, ep = df.select(T.make_id(F.col("e"), "s", F.col("n")), T.episode_of_fact(F.col("f"))).first()
    assert made.startswith("a/b/s1234@") and len(made) == len("a/b/s1234@") + 6 and ep == "a/b"


def _same(df, con, sql):
    cols = sorted(df.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)
    left = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    right = sorted(tuple(map(text, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    return left == right


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & {n for n in entry.queries() if not n.startswith("p")} | {"p1_found", "p4_found", "p4_ledger", "p4_intervals"}))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert _same(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
