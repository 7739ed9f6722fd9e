import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import udf as U
from ledgerloom.plans.scratch import Scratch
from ledgerloom.sources import episodes as E
from ledgerloom.sources import runs as R
from ledgerloom.streaming import intake as M

RECORDS = [
    {"episode_id": "a", "dialogues": [["hi", "yo"], {"user": "u", "agent": "v"}, {"human": "h", "assistant": "k"}, {"messages": [{"role": "user", "content": "m1"}, {"role": "ai", "content": "m2"}]}, "bare", {"text": "t"}, ["one"], None], "facts": {"tea": [[1, "green"], [4, "black"]]}, "probes": [{"type": "history", "question": "q?", "answer": "x", "fact_key": "tea"}]},
    {"session_id": "S1", "dialogues": [], "turns": [{"user_input": "a", "agent_output": "b"}, {"role_user": "c", "role_assistant": "d"}], "test_questions": ["just asked", {"q": "Q2", "target": ["t1", "t2"], "type": "memory_point", "entity": "bay"}], "ground_truth": [{"entity": "bay", "timestamp": "2", "fact": "A-1"}, {"value": "lost"}]},
    {"id": 7, "conversation": [["only", "one"]], "fact_timeline": {"tea": "green", "bay": [{"turn": 5, "text": "B-2"}, {"value": "C-3"}]}, "qa": [{"q": "What was it before?", "expected": "z"}, {"prompt": ""}, {"query": "Washington?", "label": "w"}, {"question": "odd", "category": "Custom"}]},
    {"probes": [{"question": "我现在的茶是什么？", "gold": "绿"}]},
    {"uid": "own", "question": "What is it?", "dialogue": "no list"},
    [["list", "only"]],
    {"dialogues": [], "probes": []},
]
TURNS = {("a", 0): ("hi", "yo"), ("a", 1): ("u", "v"), ("a", 2): ("h", "k"), ("a", 3): ("m1", "m2"), ("a", 4): ("t", ""), ("S1", 0): ("a", "b"), ("S1", 1): ("c", "d"), ("7", 0): ("only", "one"), ("ep_00005", 0): ("list", "only")}
PROBES = {
    ("a", "q?"): ("history_fact", "x", "tea"), ("S1", "just asked"): ("other", "", ""), ("S1", "Q2"): ("memory_point", "t1", "bay"), ("7", "What was it before?"): ("history_fact", "z", ""), ("7", "Washington?"): ("current_fact", "w", ""),
    ("7", "odd"): ("custom", "", ""), ("ep_00003", "我现在的茶是什么？"): ("current_fact", "绿", ""), ("own", "What is it?"): ("other", "", ""),
}
FACTS = {("a", "tea", 0, "1", "green"), ("a", "tea", 1, "4", "black"), ("S1", "bay", 0, "2", "A-1"), ("7", "tea", 0, "", "green"), ("7", "bay", 0, "5", "B-2"), ("7", "bay", 1, "1", "C-3")}


@pytest.mark.parametrize("shape", ["lines", "list", "episodes", "single"])
def test_episode_files(spark, tmp_path, shape):
    path = tmp_path / ("x.jsonl" if shape == "lines" else "x.json")
    text = {"lines": "\n\n".join(map(json.dumps, RECORDS)) + "\n\nnot json\n", "list": json.dumps(RECORDS), "episodes": json.dumps({"episodes": RECORDS}), "single": json.dumps(RECORDS[0])}[shape]
    path.write_text(text, encoding="utf-8")
    rows = E.episodes(E.read_records(spark, str(path)))
    keep = (lambda k: k[0] == "a") if shape == "single" else (lambda k: True)
    assert {(r.episode_id, r.turn_index): (r.user_msg, r.agent_msg) for r in E.turns(rows).collect()} == {k: v for k, v in TURNS.items() if keep(k)}
    assert {(r.episode_id, r.question): (r.probe_type, r.gold, r.fact_key) for r in E.probes(rows).collect()} == {k: v for k, v in PROBES.items() if keep(k)}
    assert {(r.episode_id, r.slot, r.ord, r.stamp, r.value) for r in E.facts(rows).collect()} == {k for k in FACTS if keep(k)}


def test_records_without_ids_are_named_by_place(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"dialogues": [[f"{name}{i}", "x"]]}) for i in range(300)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        both = E.turns(E.episodes(E.read_records(spark, str(tmp_path), lines=True))).collect()
        alone = E.turns(E.episodes(E.read_records(spark, str(tmp_path / "one.jsonl")))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.episode_id, r.user_msg) for r in both} == {(f"{n}:ep_{i:05d}", f"{n}{i}") for n in ("one", "two") for i in range(300)}
    assert {(r.episode_id, r.user_msg) for r in alone} == {(f"ep_{i:05d}", f"one{i}") for i in range(300)}


@pytest.mark.parametrize(
    "question, answer, want",
    [("What is my tea now?", "", "current_fact"), ("What was the meeting time?", "3pm", "current_fact"), ("What did I use to have?", "", "other"), ("What was my tea before?", "", "history_fact"), ("Where is Washington?", "", "other"), ("我原来的茶是什么", "", "history_fact"), ("the nowhere man", "", "other")],
)
def test_probe_kinds(spark, question, answer, want):
    df = spark.createDataFrame([(None, question, answer)], "k string, q string, a string")
    assert df.select(E.probe_kind(F.col("k"), F.col("q"), F.col("a")).alias("t")).first().t == want


def test_haystack(spark):
    sessions = [[("user", "q")] * n for n in (10, 5, 5)]
    mixed = [[("system", "s"), ("assistant", "orphan"), ("user", "u1"), ("user", "u2"), ("assistant", "a2")]]
    rows = [("h", "q", "a", "knowledge-update", "d", ["s0", "s1", "s2"], [], ["s0"], sessions), ("m", "q", "a", "odd", "d", ["x"], [], None, mixed)]
    df = spark.createDataFrame(rows, E.HAYSTACK)
    turns = E.haystack_turns(df)
    assert [(r.user_msg, r.agent_msg) for r in turns.filter("question_id = 'm'").orderBy("turn").collect()] == [("", "orphan"), ("u1", ""), ("u2", "a2")]
    h = turns.filter("question_id = 'h'")
    assert E.within_budget(h, None).count() == 20
    cut = E.within_budget(h, 6).collect()
    assert len(cut) == 6 and all(r.is_evidence for r in cut)
    room = E.within_budget(h, 16).groupBy("session").count().collect()
    assert {r.session: r["count"] for r in room} == {0: 10, 2: 5}
    assert [r.probe_type for r in E.haystack_probes(df, ["odd"], 1).collect()] == ["other"]
    assert len(E.within_budget(h, 4).collect()) == 4 and all(r.is_evidence for r in E.within_budget(h, 4).collect())
    many = [(f"n{i}", "q", "a", "single-session-user", "d", [], [], [], []) for i in range(60)] + [("k1", "q", "a", "knowledge-update", "d", [], [], [], [])]
    got = E.haystack_probes(spark.createDataFrame(many, E.HAYSTACK), ["knowledge-update"], 1).collect()
    assert [(r.question_id, r.probe_type) for r in got] == [("k1", "current_fact")]
    assert E.TYPES["temporal-reasoning"] == "other" and E.TYPES["single-session-preference"] == "current_fact"


def test_results_and_bookkeeping(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "k string, n int"), spark.createDataFrame([("y", "t")], "k string, s string")
    R.write_results([a, b], str(tmp_path / "out"))
    got = R.read_results(spark, str(tmp_path / "out"))
    assert set(got.columns) == {"k", "n", "s"} and {(r.k, r.n, r.s) for r in got.collect()} == {("x", "1", None), ("y", None, "t")}
    path = str(tmp_path / "t")
    assert R.append_new(a, path, ["k"]) == 1 and R.append_new(a.unionByName(spark.createDataFrame([("z", 2), ("z", 2)], a.schema)), path, ["k"]) == 1
    both = R.upsert(spark.createDataFrame([("x", 1, 1.0)], "k string, n int, ts double"), spark.createDataFrame([("x", 2, 2.0), ("w", 5, 0.5)], "k string, n int, ts double"), ["k"], "ts")
    assert {(r.k, r.n) for r in both.collect()} == {("x", 2), ("w", 5)}
    progress = spark.createDataFrame([("x", "done"), ("x", "failed"), ("z", "failed")], "k string, status string")
    assert [r.k for r in R.pending(spark.createDataFrame([("x",), ("z",)], "k string"), progress, ["k"]).collect()] == ["z"]
    ep = str(tmp_path / "ep")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "episode_id string, n int")
    df.write.parquet(ep)
    R.purge(spark, [ep], df.filter("n = 1"))
    assert [r.n for r in spark.read.parquet(ep).collect()] == [2]
    table = str(tmp_path / "table")
    R.replace_episodes(spark.createDataFrame([(f"e{i}", i) for i in range(600)], "episode_id string, n int"), table, Scratch(spark, "t"))
    R.replace_episodes(spark.createDataFrame([("e5", 50), ("e5", 51), ("new", 1)], "episode_id string, n int"), table, Scratch(spark, "t"))
    assert {(r.episode_id, r.n) for r in spark.read.parquet(table).collect()} == {(f"e{i}", i) for i in range(600) if i != 5} | {("e5", 50), ("e5", 51), ("new", 1)}
    first = str(tmp_path / "first")
    assert R.append_new(spark.createDataFrame([("k", "late", 2), ("k", "early", 1)], "k string, v string, at int"), first, ["k"], "at") == 1
    assert [r.v for r in spark.read.parquet(first).collect()] == ["early"]
    assert json.loads(R.payloads(a, ["k"]).first().payload) == {"k": "x", "n": 1}


def test_udfs(spark):
    texts = ["我的工位在十二楼", "hello world again and again", "", None, "short"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.truncate_to_tokens(F.col("t"), 3).alias("t")).collect()]
    assert got == ["我的 ...", "hello w ...", "", None, "short"]


GET, RAW = "get_archived_summary", "get_raw_record"


@pytest.mark.parametrize(
    "text, want",
    [
        (f'{GET}(summary_id="ep/s001@aa")', [(GET, {"summary_id": "ep/s001@aa"})]), (f"{RAW}(reference_id=ep/raw001@aa)", [(RAW, {"reference_id": "ep/raw001@aa"})]), (f'{RAW}(ref="r1")', [(RAW, {"reference_id": "r1"})]), (f"{RAW}(reference_id: 'r1')", [(RAW, {"reference_id": "r1"})]),
        (f'{GET}(id="s1")', [(GET, {"summary_id": "s1"})]), (f'{{"name": "{GET}", "arguments": {{"summary_id": "s1"}}}}', [(GET, {"summary_id": "s1"})]), ("Your home city is Shanghai.", []),
        (f"[TOOL RESULT: {GET} ERROR] use {GET}(summary_id=\"s1\")", []), (f'--- TOOL RESULT {GET}(id="x")', []), (f'{GET}(summary_id："s1")', [(GET, {"summary_id": "s1"})]), (f'{GET}（summary_id="s1"）', [(GET, {"summary_id": "s1"})]), (f'{RAW}（reference_id＝"r1"）', [(RAW, {"reference_id": "r1"})]),
        ('get_predecessor_summary(fact_key="楼层", reference="12楼")', [("get_predecessor_summary", {"fact_key": "楼层", "reference_value": "12楼"})]), ('get_predecessor_summary(slot="tea", became="green", except="x")', [("get_predecessor_summary", {"fact_key": "tea", "reference_value": "green", "exclude_value": "x"})]),
        (f'```\n{RAW}(id="r1")\n```', [(RAW, {"reference_id": "r1"})]), ("other(1) and list_active_summaries()", [("list_active_summaries", {})]), (None, []), ("", []),
    ],
)
def test_tool_calls(text, want):
    assert U.find_calls(text) == want


@pytest.mark.parametrize("bar", ["|", "||", "｜", "｜｜"])
def test_tool_calls_in_markup(bar):
    text = f'<{bar}DSML{bar}invoke name="{RAW}"><{bar}DSML{bar}parameter name="reference_id">ep/raw030@c7</{bar}DSML{bar}parameter></{bar}DSML{bar}invoke>'
    assert U.find_calls(text) == [(RAW, {"reference_id": "ep/raw030@c7"})]


def test_estimates_and_cuts_agree():
    texts = ["我的工位在十二楼", "hello world", "", "a\u3000b", "x" * 100, "12, 13; 14!", "😀 ok"]
    assert [int(n) for n in U.estimates(texts)] == [int(U.estimates([t])[0]) for t in texts]
    for t in texts:
        for limit in (1, 3, 9):
            n = U._fitting(t, limit)
            assert n == len(t) or U.estimates([t[: n + 1]])[0] > limit
            assert not n or U.estimates([t[:n]])[0] <= limit


def test_streams_equal_batches(spark, tmp_path):
    src, raw = str(tmp_path / "in"), str(tmp_path / "raw")
    schema = "fact_id string, episode_id string, slot string, value string, seq int, observed_turn int, reason string, erased boolean, at timestamp"
    one = spark.sql("select timestamp'2024-01-01 00:00:00' t").first().t
    batches = [[("f1", "e", "Tea", "green", 1, 0, "", False, one), ("f2", "e", "tea", "black", 2, 5, "", False, one)], [("f1", "e", "Tea", "green", 1, 0, "", False, one), ("f3", "e", "tea ", "late", 3, 2, "x", False, one)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.fact_id for r in run(M.intake(stream, "at"), "taken", "append")) == ["f1", "f2", "f3"]
    assert {(r.slot, r.value) for r in run(M.current_values(stream), "now", "complete")} == {("tea", "black")}
    for n in range(3):
        spark.createDataFrame([("e", t, f"r{t}") for t in (n * 2, n * 2 + 1, -1)], "episode_id string, turn_index int, reference_id string").coalesce(1).write.mode("append").parquet(raw)
    turns = spark.readStream.schema("episode_id string, turn_index int, reference_id string").option("maxFilesPerTrigger", 1).parquet(raw)
    rows = run(M.recent_turns(turns, 3), "recent", "update")
    assert {r.turn_index for r in rows[-3:]} == {3, 4, 5}
