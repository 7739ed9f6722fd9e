"""Operators on text: brute force, round trips and cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chunks, conversations, leaks, mixing, pairs, percentiles, residue, tokens
from ledgerloom.plans.scratch import Scratch

# --- residue ---

RESIDUE = [
    "Dear {{name}}, the tea did not change.", "用户把茶改为【请填写答案】。", "<OLD_VALUE>", "[your slot here]", "%(city)s", "{%= slot %}", "${value}", "@@SLOT@@", "__CITY__", "#{x}",
    "Lorem ipsum ferin vestra sanove.", "LOREM NULLEM ELIGA VESTRA", "\nSAMPLE TEXT, REPLACE BEFORE PUBLISHING.\n", "asdf asdf jkl asdf", "测试测试测试", "502 Bad Gateway", '{"error": {"code": 500, "message": "internal server error"}}',
    "Oops! Something went wrong on our side. Reference 0b37f3b3", "页面暂时不可用，请稍后重试。（错误码 404）", "Please turn on JavaScript and cookies in your browser settings.", "检测到浏览器已禁用脚本，然后继续浏览。",
]
CONTENT = [
    "User fixed the internal server error on the build box. The tea blend is green.", "用户在自助机上关掉了JavaScript，食堂餐桌是60号。", "<MEMORY_UPDATE>User's tea is green. [FACTS: tea=green]</MEMORY_UPDATE>",
    '{"slot": "tea blend", "value": "green 12"}', "<b>M-12</b>", "User's tea is green. [OVERRIDES: s001@aa, none]", "User takes tram 502 to the office; tea is green.", "none", "", None, "12", "number 138", "M-404",
    "User enabled scripts for the tea form and reloaded it; the form shows number 75.",
]


#: Texts that were looked at while exemplars and parameters were set, and texts that were written afterwards and not used for it.
SEEN_RESIDUE = [
    "This site can't be reached. The server took too long to respond.",
    'Checking your browser before accessing the page...',
    "404. That's an error.",
    "We're sorry but this app doesn't work properly without JavaScript enabled.",
    '服务器开小差了，请稍后再试',
    '系统升级中，敬请期待',
    'Text to follow.',
    'Hello ____',
    'Dear [Customer Name], thank you for your order.',
    'Your code is {{code}}.',
    'Bonjour %(first_name)s !',
    '<%= user.name %> wrote this',
    'Copy to come',
    'TBD',
    'Coming soon',
    'Under construction, check back later.',
    'This page intentionally left blank.',
    '503 Service Temporarily Unavailable',
    'nginx 502 Bad Gateway',
    'Access denied. You do not have permission to view this resource.',
    'Sorry, the page you requested could not be found.',
    'Something went wrong. Please try again.',
    'An unexpected error has occurred. Please contact support.',
    'The requested URL was not found on this server.',
    'Too many requests, please slow down.',
    'Traceback (most recent call last): File "main.py", line 3, in <module> ValueError: bad input',
    'Exception in thread "main" java.lang.NullPointerException',
    'Error establishing a database connection',
    'You are offline. Check your internet connection.',
    'Your session has expired. Please sign in again.',
    'JavaScript is not enabled in your browser.',
    'Please enable JS and disable any ad blocker',
    'You must enable JavaScript in order to use this site.',
    '您的浏览器禁用了JavaScript，请启用后刷新页面',
    '本网站需要启用JavaScript才能正常使用',
    '抱歉，您访问的页面走丢了',
    '网络异常，请检查网络连接',
    '页面不存在',
    '内容建设中',
    '此处插入标题',
    '示例文本示例文本',
    '测试一下测试一下',
    'the quick brown fox jumps over the lazy dog',
    'asdf qwerty asdf',
    'Sample content for demonstration purposes only',
    'Insert your text here',
    '@@NAME@@ 的订单已发货',
    'Verify you are human to continue',
    "We'll be back soon after scheduled maintenance.",
    'Whoops, looks like something went wrong.',
]
SEEN_CONTENT = [
    'The shell expands ${HOME} before the path is used.',
    'In Python the format string %(city)s takes a mapping.',
    'Python calls __INIT__ when an object is made.',
    'See [[Main Page]] on the wiki for the rota.',
    'Use {{ }} in the template syntax for variables.',
    '模板语法里的 {{name}} 表示变量。',
    'The user renamed the environment variable ${PATH_OLD} in the deploy script.',
    'User fixed a 404 on the tram website; tea blend is still oolong.',
    'The tea blend is oolong, not the one on the error page.',
    'User saw a 502 page at the kiosk and took the stairs to room 12.',
    '用户说打印店的网页报错了，茶叶口味还是乌龙。',
    '用户在旧电脑上关闭了JavaScript，值班表放在抽屉里。',
    "Placeholder is the name of the user's boat, moored at pier 4.",
    "The user's cat is called Lorem and sleeps on the sofa.",
    'User enabled JavaScript for the canteen form and ordered soup.',
    'The maintenance crew comes on Tuesday at nine.',
    'The server at the canteen brought soup instead of salad.',
    'The gateway to the garden is painted green this year.',
    'The user was forbidden to enter the attic as a child.',
    'He could not find the page with the recipe, so he used the old card.',
    'Service at the barber was slow, but the user liked the cut.',
    'The session on Thursday covered tide tables.',
    'Access to the roof is by the north stairs.',
    'User tests the fire alarm every first Monday.',
    'The sample of tea from the market was stale.',
    'The example in the second lecture was about ferries.',
    'To continue the course, the user has to pay by Friday.',
    'The reload of the washing machine took an hour.',
    "User's browser history shows three visits to the tide register.",
    'The cookies in the tin are for the choir.',
    'The script of the play has three parts for women.',
    "JavaScript is the user's favourite lecture at the evening school.",
    '他把服务员的名字写错了，后来改成了郑岷。',
    '系统课程在周三上午，教室是12号。',
    '网络课程改到周五，老师没有变。',
    '页面上的插图是一只灰鹭。',
    '请把茶放在窗台上，谢谢。',
    '测试课在周二，用户带了两支铅笔。',
    '示例花园里种了三棵柏树。',
    '用户要求修改周报模板的标题，合唱声部没有变。',
    'User wants a new template for the weekly note; spare key keeper remains meadow Prasilond.',
    'Error bars on the chart were too wide, so the user redrew it.',
    'The timeout in the second half changed the match.',
    'The bad weather closed the gateway road for two days.',
    'The request for leave was granted on Monday.',
    'Room 404 is on the fourth floor next to the lift.',
    '{"slot": "tea blend", "value": "oolong 12"}',
    '<b>coral dormouse 12</b>',
    "<MEMORY_UPDATE>User's tea is oolong. [FACTS: tea=oolong]</MEMORY_UPDATE>",
    'plum heron 31 [s004@aa01bc]',
]
FRESH_RESIDUE = [
    'Hi {first_name}, your parcel has left.',
    '[Insert company name] thanks you for your visit.',
    'Ihr Termin ist am {{date}}.',
    '尊敬的${customer}，您好。',
    '%%USERNAME%% has joined',
    'Content to be added here.',
    'Details to follow.',
    'Dummy text for the layout',
    '此处填写正文',
    '待更新',
    '410 Gone. The page you requested has been removed.',
    'This page is not available right now.',
    '500 Internal Server Error',
    'The connection has timed out.',
    'Service unavailable, please try again in a few minutes.',
    'Unable to connect to the server.',
    "You don't have permission to access this page.",
    'Fatal error: out of memory',
    '服务器繁忙，请稍后重试',
    '您没有访问权限',
    '连接失败，请检查网络',
    'JavaScript must be enabled to view this page.',
    'Your browser has JavaScript turned off.',
    '请在浏览器中启用JavaScript',
    'This application requires scripts to work.',
]
FRESH_CONTENT = [
    'The user moved the parcel to {the} shelf by the door, in round brackets.',
    'The constructor __init__ is written with two underscores.',
    'Escape {{ braces }} in the template, says the documentation.',
    'The regex ${1} token refers to the first match.',
    '模板里的变量 ${name} 写法没有变。',
    'The internal clock of the server room was wrong on Monday.',
    "User's page in the choir book has a coffee stain.",
    'The user could not be found on the guest list, so Ann let him in.',
    'A timeout was called by the coach; the score stayed the same.',
    "User blocked the browser on the child's tablet and kept the ferry time.",
    'She asked for access to the attic and got the key.',
    'The error in the tide table was fixed: high water is at nine.',
    'The user was denied a refund for the broken lamp.',
    'Script readings are on Thursday in room 12.',
    'He reloads the stove every two hours.',
    'The gateway lodge has a red door.',
    'Your table is number 503 near the window.',
    'Maintenance of the lift costs 40 a month.',
    '用户的页面设计课改到周四。',
    '服务台在二楼左边。',
    '他把错误的号码改成了A-17。',
    '脚本课的老师是郑岷。',
    '网络线放在抽屉里。',
    '测试完水质以后茶叶口味改成了乌龙。',
    'User unavailable on Friday, back on Monday.',
]


def test_residue_against_labels(spark):
    filler = ["Lorem nullem eliga ferin vestra.", "lorem sanove ipsum nullem eliga"]
    rows = [(i, t, i < len(RESIDUE + filler)) for i, t in enumerate(RESIDUE + filler + CONTENT * 3)]
    df = spark.createDataFrame(rows, "rec_key int, text string, truth boolean").withColumn("src", F.lit("x"))
    found = residue.classify(df, residue.build(df)).select("rec_key", "kind").collect()
    assert {r.rec_key for r in found} == {i for i, _, truth in rows if truth}
    assert residue.classify(df.limit(0), residue.build(df.limit(0))).count() == 0


def test_residue_of_unseen_texts(spark):
    """Shares of residue found and content kept: 0.98 and 1.0 of the texts looked at; the fresh ones are held to 0.8."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/probe_predictions.parquet").select(F.col("prediction").alias("text"))
    index = residue.build(corpus)
    share = lambda texts: sum(index.coverage(t)[0] >= residue.COVERAGE for t in texts) / len(texts)
    assert share(SEEN_RESIDUE) >= 0.96 and share(SEEN_CONTENT) <= 0.04
    assert share(FRESH_RESIDUE) >= 0.8 and share(FRESH_CONTENT) <= 0.2


def test_residue_long_text_is_read_whole(spark):
    words = " ".join(f"w{chr(97 + i % 26)}x word" for i in range(30000))
    df = spark.createDataFrame([(1, words + " {{hole}}"), (2, words)], "rec_key int, text string")
    assert [r.rec_key for r in residue.classify(df, residue.build(df)).collect()] == [1]


# --- conversations ---

RAW = "reference_id string, episode_id string, turn_index int, user_msg string, agent_msg string, ts double, state int"


def raw(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], RAW)


def test_conversation_reasons(spark):
    rows = [
        ("a0", " good ", 0, "User: hi", "hello", 1.0), ("a1", "good", 1, "more", "yes\n", 2.0), ("a1", "good", 1, "more", None, 1.0), ("a9", "good", 1, "more", "yes", 9.0),
        ("b0", "silent", 0, "User:", "(no reply)", 1.0), ("b1", "silent", 1, "​", "N/A", 1.0),
        ("c0", "gap", 1, "hi", "yo", 1.0), ("d0", "clash", 0, "hi", "yo", 1.0), ("d1", "clash", 0, "hi", "other", 1.0),
        ("e0", "neg", -1, "hi", "yo", 1.0), ("e1", "neg", 0, "hi", "yo", 1.0), ("f0", "nul", None, "hi", None, 1.0), ("g0", "unans", 0, "hi", "助手：", 1.0),
        ("h0", None, 0, "x", "y", 1.0), ("h1", "  ", 0, "x", "y", 1.0), (None, "good", 2, "z", "z", None),
    ]
    turns = conversations.turns(raw(spark, rows))
    got = {(r.episode_id, r.reason) for r in conversations.reasons(conversations.states(turns)).collect()}
    assert got == {("silent", "empty"), ("gap", "broken"), ("clash", "broken"), ("neg", "broken"), ("nul", "broken"), ("nul", "missing_reply"), ("unans", "missing_reply")}
    told = conversations.messages(turns, conversations.reasons(conversations.states(turns))).orderBy("position").collect()
    assert [(r.position, r.role, r.text) for r in told] == [(0, "user", "hi"), (1, "agent", "hello"), (2, "user", "more"), (3, "agent", "yes"), (4, "user", "z"), (5, "agent", "z")]
    assert conversations.turns(raw(spark, rows).limit(0)).count() == 0


def test_conversation_longer_than_a_block(spark):
    n = conversations.BLOCK * 2 + 5
    full = [(f"r{i}", "long", i, "q", "a", 1.0) for i in range(n)]
    holed = [(f"s{i}", "holed", i, "q", "a", 1.0) for i in range(n) if i != conversations.BLOCK]
    got = conversations.reasons(conversations.states(conversations.turns(raw(spark, full + holed)))).collect()
    assert [(r.episode_id, r.reason) for r in got] == [("holed", "broken")]


# --- percentiles ---


def test_percentiles_are_certified_and_combine(spark):
    rng = np.random.default_rng(1)
    values = {"even": rng.lognormal(8, 2, 20000), "ties": rng.choice([1.0, 2.0, 2400.0], 5000), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    for r in percentiles.percentiles(df, ["g"], Scratch(spark, "t")).collect():
        data = np.sort(values[r.g])
        assert r.error <= percentiles.BOUND and r.n == len(data)
        assert (r.below, r.upto) == (np.searchsorted(data, r.estimate), np.searchsorted(data, r.estimate, side="right"))
    # digests of two days merge to the percentiles of both
    days = [percentiles.digest(df.filter(F.rand(7) < 0.5), ["g"]), percentiles.digest(df.filter(F.rand(7) >= 0.5), ["g"])]
    both = days[0].unionByName(days[1].withColumn("part", F.col("part") + 64))
    merged = percentiles.merge(both, ["g"], 128).filter("g = 'even'").toPandas().sort_values("mean")
    assert merged["weight"].sum() == 20000
    guess = percentiles.estimate(merged["mean"].to_numpy(), merged["weight"].to_numpy(), 0.5)
    assert abs((values["even"] < guess).mean() - 0.5) < 0.005


def test_percentiles_of_dirty_rows(spark):
    rows = [("k1", "s", 5.0, 10), ("k1", "s", 5.0, 10), ("k2", "s", float("nan"), None), ("k3", "s", -1.0, 0), ("k4", "s", None, 20), ("k5", None, 1.0, 1), ("k6", "s", float("inf"), 5), ("k7", "s", 0.0, 5)]
    df = spark.createDataFrame(rows, "k string, system string, latency double, size bigint").withColumn("value", F.lit("x")).withColumn("m", F.lit(1))
    got = percentiles.measured(df, ["k", "system"], ["system"], ["latency", "size"])
    assert sorted((r.metric, r.value) for r in got.collect()) == [("latency", 0.0), ("latency", 5.0), ("size", 0.0), ("size", 5.0), ("size", 5.0), ("size", 10.0), ("size", 20.0)]
    assert percentiles.percentiles(got.limit(0), ["system", "metric"], Scratch(spark, "t")).count() == 0


# --- pairs ---

PAIRS = [
    ("What is my tea blend right now?", "green", "Your tea blend is green.", None, set()), ("What is my tea blend right now?", "green", "green", None, set()), ("What is my tea blend right now?", "green", "**green**", None, set()),
    ("What is my tea blend right now?", "green", "Your tea blend is black.", None, set()), ("我现在的茶叶口味是什么？", "绿", "你现在的茶叶口味是绿。", None, set()), ("Which one did I have before?", "none", "none", None, set()),
    ("What is my tea blend right now?", "green", None, None, {"empty"}), ("What is my tea blend right now?", "green", "​", "empty completion", {"empty"}), ("What is my tea blend right now?", "green", "N/A", None, {"empty"}), ("What is my tea blend right now?", "green", "None", None, {"empty"}),
    ("What is my tea blend right now?", "green", "From turn 3 onwards the tea blend has be", "max_tokens reached", {"truncated"}), ("我现在的茶叶口味是什么？", "绿", "从第4轮起，茶叶口味一", None, {"truncated"}), ("What is my tea blend right now?", "green", "It was green. Evidenc...[cut]", None, {"truncated"}),
    ("What is my tea blend right now?", "green", "I cannot share information about the tea blend.", None, {"refusal"}), ("我现在的茶叶口味是什么？", "绿", "抱歉，我没有权限谈论茶叶口味。", None, {"refusal"}),
    ("What is my tea blend right now?", "green", "I can't tell you the exact date, though the tea blend is green.", None, set()), ("What is my tea blend right now?", "green", "I could not open the oldest summary, but the archive gives green for the tea blend.", None, set()),
    ("What is my tea blend right now?", "green", "WHAT IS MY TEA BLEND RIGHT NOW", None, {"copy"}), ("我现在的茶叶口味是什么？", "绿", "问题：我现在的茶叶口味是什么？", None, {"copy"}), ("What is my tea blend right now?", "green", "What is my tea blend right now? It is green.", None, set()),
    ("What is my tea blend right now?", "green", "据我所知，正确的取值是green。", None, {"language"}), ("What is my tea blend right now?", "green", "Au tour 5, la réponse est green.", None, {"language"}), ("我现在的茶叶口味是什么？", "绿", "According to the archive, it was 绿 at that time.", None, {"language"}),
    ("What is my tea blend right now?", "green", "Your tea blend is green; the source line reads “已按原样保存”, see s1.", None, set()), ("What is my tea blend right now?", " ", "Your tea blend is green.", None, {"no_gold"}), ("What is my tea blend right now?", None, None, None, {"no_gold", "empty"}),
    ("What is my tea blend right now?", "green", "502 Bad Gateway", None, set()), (None, "green", "Your tea blend is green.", None, set()), ("What is my tea blend right now?", "-", "502 Bad Gateway", None, {"no_gold"}),
]


def test_defects_against_labels(spark):
    # ten copies of each case, and many sound answers, so that the counts look like a corpus
    cases = [(f"r{c}", "s", "e", i, *p[:4], "tea blend" if i % 2 else "茶叶口味") for c in range(10) for i, p in enumerate(PAIRS)]
    cases += [("sound", "s", "e", 1000 + i, "What is my tea blend right now?", "green", "Your tea blend is green.", None, "tea blend") for i in range(300)]
    cases += [(None, "s", "e", 1, "q", "g", None, None, None), ("r0", "s", "e", 0, *PAIRS[0][:4], "茶叶口味")]
    df = spark.createDataFrame(cases, "run_id string, system string, episode_id string, probe_index int, question string, gold string, prediction string, error string, fact_key string").withColumn("said", F.lit(1))
    got = {}
    for r in pairs.defects(df, Scratch(spark, "t")).collect():
        got.setdefault((r.run_id, r.probe_index), set()).add(r.defect)
    want = {(f"r{c}", i): p[4] for c in range(10) for i, p in enumerate(PAIRS) if p[4]}
    assert got == want
    assert pairs.defects(df.limit(0), Scratch(spark, "t")).count() == 0


def test_label_model_separates_noisy_votes():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.1
    votes = [np.where(rng.random(20000) < acc, truth, ~truth) for acc in (0.95, 0.9, 0.85)]
    codes = sum(np.where(v, 2, 0) * 3**j for j, v in enumerate(votes))
    model = pairs.fit(dict(zip(*np.unique(codes, return_counts=True))), 3)
    called = np.array([model.posterior(c) >= 0.5 for c in codes])
    assert (called == truth).mean() > 0.95 > 0.9
    assert 0.05 < model.prior < 0.15
    cut = pairs.validated(model, codes[:500].tolist(), truth[:500].tolist())
    assert 0.0 < cut < 1.0


UNSEEN_PAIRS = [
    ("language", "Volgens het logboek was dat green."), ("language", "Zgodnie z zapisem to była green."), ("language", "Enligt loggen var det green förut."), ("language", "Menurut catatan itu adalah green."), ("language", "Kayda göre o zaman green idi."), ("language", "Theo nhật ký thì đó là green."),
    ("language", "Nous gardons toujours green pour elle."), ("language", "Podle deníku to bylo green."), ("language", "Muistion mukaan se oli green."), ("language", "Это значение green было раньше."), ("language", "그때는 green이었습니다."), ("language", "上次说的是green，没有变。"),
    ("refusal", "I'm afraid I cannot discuss personal preferences."), ("refusal", "That's private, so I'll keep it to myself."), ("refusal", "I'm not permitted to disclose this."), ("refusal", "I would prefer not to comment on your tea."), ("refusal", "抱歉，这个问题我无可奉告，无法回答。"),
    ("truncated", "As noted on that day the tea blend was gre"), ("truncated", "It changed because you sa"), ("", "It's green."), ("", "Green, since Tuesday."), ("", "I think you like green best!"), ("", "green (from the second note)"), ("", "Quenrasil"), ("", "B-17"), ("", "You switched to green after the Bordeaux trip."), ("", "The word on the tin, “Grüner Tee”, means green."),
]


def test_defects_of_unseen_pairs(spark):
    """At least 0.8 of the unseen defects are found, and 0.8 of the sound answers are left alone."""
    real = spark.read.parquet("/root/testdata/sf0.01/probe_predictions.parquet").select("run_id", "system", "episode_id", "probe_index", "question", "gold", "prediction", "error", "fact_key")
    mine = [("unseen", "s", "e", i, "What is my tea blend right now?", "green", text, None, "tea blend") for i, (_, text) in enumerate(UNSEEN_PAIRS)]
    both = real.unionByName(spark.createDataFrame(mine, real.schema))
    got = {}
    for r in pairs.defects(both, Scratch(spark, "t")).filter("run_id = 'unseen'").collect():
        got.setdefault(r.probe_index, set()).add(r.defect)
    hits = [(want, got.get(i, set())) for i, (want, _) in enumerate(UNSEEN_PAIRS)]
    assert sum(want in found for want, found in hits if want) >= 0.8 * sum(bool(want) for want, _ in hits), [x for x in zip(UNSEEN_PAIRS, hits) if x[1][0] and x[1][0] not in x[1][1]]
    assert sum(not found for want, found in hits if not want) >= 0.8 * sum(not want for want, _ in hits), [x for x in zip(UNSEEN_PAIRS, hits) if not x[1][0] and x[1][1]]


# --- leaks ---


def brute_leaks(docs, items):
    fold = leaks.fold_table()
    text = lambda t: leaks.folded(t or "", fold).tobytes().decode("utf-32-le")
    out = set()
    for i, t in items:
        s = text(t)
        half = (len(s) + 1) // 2
        if s:
            out |= {(d, i) for d, u in docs if u and any(s[k : k + half] in text(u) for k in range(len(s) - half + 1))}
    return out


def leak_case(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["dan", "vey", "bri", "kel", "zan", "or", "wic", "tak"]) for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 60)))) for i in range(40)]
    docs = []
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            src = rng.choice(items[:40])[1]
            cut = int(len(src) * rng.choice([0.3, 0.45, 0.52, 0.7, 1.0]))
            at = rng.randint(0, len(src) - cut)
            body.insert(rng.randint(0, len(body)), src[at : at + cut].upper().replace(" ", " -- "))
        docs.append((d, " ".join(body)))
    return items, docs


DOCS, ITEMS_SCHEMA = "doc_id long, text string", "item_id long, text string, answer string"


def copies(found):
    return {(r.doc_id, r.item_id) for r in found.filter("kind = 'copy'").collect()}


def test_leaks_equal_brute_force(spark):
    items, docs = leak_case(4)
    items += [(90, "洮鄢隰磐莨钧的副本上写着嵇霁岑三个字，没有别的"), (92, None), (93, "   ")]
    docs += [(900 + k, "前言 " + items[0][1] + " 后记") for k in range(70)]  # a large part of the corpus is copies
    docs += [(200, "x。洮鄢隰磐莨钧的副本上写着嵇霁岑Ｘ"), (201, None), (202, ""), (203, "y" * 200000 + items[1][1]), (None, items[0][1])]
    d = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("n", F.lit(1)).withColumn("item_id", F.lit(2))
    i = spark.createDataFrame([(a, b, "zan") for a, b in items], ITEMS_SCHEMA)
    got = copies(leaks.search(d, i, Scratch(spark, "t")))
    want = brute_leaks([x for x in docs if x[0] is not None], items)
    assert len(want) > 60
    assert got <= want and len(got) >= 0.99 * len(want), (want - got, got - want)
    assert leaks.search(d.limit(0), i, Scratch(spark, "t")).count() == 0
    assert leaks.search(d, i.limit(0), Scratch(spark, "t")).count() == 0


def test_leaks_of_short_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SLICE", 4)
    monkeypatch.setattr(leaks, "BLOCK", 2)
    items = [(1, "abcdefghij"), (2, "qrstuvwx"), (3, "xy"), (4, "茶叶颜色"), (5, "klmnopqrstuvwx"), (6, "z"), (7, "zulu time"), (8, "红色灯笼挂在桥头")]
    docs = [(1, "... abcdefg ..."), (2, "ghij abcd"), (3, "ABC-DE"), (4, "st uvw"), (5, "x marks it"), (6, "他说茶叶很好"), (7, "no match here"), (8, "mnopqrs"), (9, "挂在桥头")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(a, b, "") for a, b in items], ITEMS_SCHEMA)
    assert copies(leaks.search(d, i, Scratch(spark, "t"))) == brute_leaks(docs, items)


def test_leaks_by_paraphrase_come_from_the_search(spark, monkeypatch):
    rng = random.Random(12)
    items, docs = leak_case(12)
    answers = {i: f"answer {rng.randint(10**6, 10**7)}" for i, _ in items}
    long = [x for x in items if len(x[1].split()) > 20]
    for k, (i, text) in enumerate(long):
        swapped = [w if n % 4 else f"ut{n}mo" for n, w in enumerate(text.split())]
        docs.append((1000 + i, " ".join(w for _, w in leak_words(rng, 40)) + " " + " ".join(swapped) + " " + answers[i]))
        docs.append((2000 + i, " ".join(swapped)))  # without the answer: three quarters are too few
    docs.append((3000, "no leak, only " + answers[long[0][0]]))
    d = spark.createDataFrame(docs, DOCS)
    i = spark.createDataFrame([(a, b, answers[a]) for a, b in items], ITEMS_SCHEMA)
    found = {(r.doc_id, r.item_id) for r in leaks.search(d, i, Scratch(spark, "t")).filter("kind = 'paraphrase' and answered").collect()}
    want = {(1000 + i, i) for i, _ in long}
    assert len(want) > 10 and len(found & want) >= 0.9 * len(want) and not found - want
    monkeypatch.setattr(leaks, "MARGIN", 20.0)
    monkeypatch.setattr(leaks, "NEAR", 1.5)  # a search that rejects everything finds nothing
    assert leaks.search(d, i, Scratch(spark, "t")).count() == 0


def leak_words(rng, n):
    return [(k, "".join(rng.choice("bcdfgaeiou") for _ in range(7))) for k in range(n)]


def test_sketch_gives_singular_vectors():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 80))
    omega = np.linalg.qr(rng.standard_normal((80, 20)))[0]
    vectors, values = leaks.directions(a.T @ a @ omega, omega)
    _, exact, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:6], exact[:6], rtol=1e-3)
    assert np.allclose(np.abs((vectors[:, :4] * right[:4].T).sum(axis=0)), 1, atol=1e-3)


# --- mixing ---


def test_mixture_keeps_shares_and_caps(spark):
    rng = random.Random(2)
    counts = [(i, s, rng.randint(1, 400)) for i, s in enumerate(rng.choices(["a", "b", "c", "other"], [60, 25, 3, 12], k=3000))] + [(9000, "a", 0), (9001, None, 5)]
    df = spark.createDataFrame(counts, "doc_id long, source string, n_tokens long").repartition(9)
    targets = spark.createDataFrame([("A", 0.5, 1), (" b", 0.3, 2), ("c", 0.1, 4), ("no-thing", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, goals = mixing.mixture(df, targets, Scratch(spark, "t"))
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    caps = {"a": 1, "b": 2, "c": 4}
    biggest = 400
    want = {r.source: r.goal for r in goals.collect()}
    for s in caps:
        mine = [r for r in rows if r.source == s]
        assert max(r.copies for r in mine) <= caps[s]
        assert abs(sum(r.copies * r.n_tokens for r in mine) - want[s]) <= biggest
    assert {r.source for r in rows} == set(caps)
    shares = {r.source: r.share_ppm for r in mixing.shares(mixed, goals).collect()}
    assert shares["no_thing"] == 0 and abs(shares["a"] - 555556) < 20000
    small, _ = mixing.mixture(df, targets, Scratch(spark, "t"), total=5000)
    assert abs(sum(r.copies * r.n_tokens for r in small.collect()) - 5000) <= 3 * biggest
    assert mixing.mixture(df.limit(0), targets, Scratch(spark, "t"))[0].count() == 0


def test_mixture_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(6)
    counts = [(i, rng.choice("aaab"), rng.randint(1, 400)) for i in range(1500)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    seen = set()
    for parts in (2, 5, 64):
        df = spark.createDataFrame(rng.sample(counts, len(counts)), "doc_id long, source string, n_tokens long").repartition(parts)
        seen.add(frozenset((r.doc_id, r.copies) for r in mixing.mixture(df, targets, Scratch(spark, "t"))[0].collect()))
    assert len(seen) == 1
    draws = [mixing.coin(i, i + 1, 0) for i in range(20000)]
    assert abs(np.mean(draws) - 0.5) < 0.01 and abs(np.std(draws) - 0.2887) < 0.01


def test_pivotal_rounding_keeps_mass_and_expectation():
    ids, sizes, parts = list(range(60)), [1 + i % 7 for i in range(60)], [0.3] * 60
    hits = np.zeros(60)
    for seed in range(400):
        done_ids, done, held = mixing._trade(ids, sizes, parts, lambda i, j, rng=np.random.default_rng(seed): rng.random())
        mass = sum(sizes[i] * x for i, x in zip(done_ids, done)) + (held[1] * held[2] if held else 0)
        assert abs(mass - 0.3 * sum(sizes)) < 1e-6 and len(done_ids) + bool(held) == 60
        hits[done_ids] += done
    assert abs(hits.mean() / 400 - 0.3) < 0.02


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", " A-b "), (2, None, None), (3, "", "x"), (None, "z", "x")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source, r.n_tokens) for r in mixing.token_counts(df).collect()} == {(1, "a_b", 2), (2, None, 0), (3, "x", 0)}


# --- chunks ---


@pytest.mark.parametrize("limit, overlap", [(64, 8), (40, 0), (128, 64)])
def test_pieces_round_trip_and_fit(spark, limit, overlap):
    rng = random.Random(limit)
    line = lambda: rng.choice(["[user] ", "助手：", "- ", ""]) + rng.choice(["The tea was moved to turn 12. ", "第12轮把茶改为绿。为什么？", "no end here ", "a\r\n\r\n", "x" * 50]) * rng.randint(1, 9)
    texts = [rng.choice(["\n", "\n\n", "\r\n", " "]).join(line() for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += ["", None, "字" * 3000, "q" * 5000, " " * 3000, "😀" * 600, "one. " * 4000, "\n" * 900, "é" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", F.lit(1))
    pieces = {}
    for r in chunks.split(df, limit, overlap).orderBy("doc_id", "piece").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    enc = tokens.encoding()
    for i, t in enumerate(texts):
        rows = pieces.get(i, [])
        assert "".join(t[r.core_char : r.end_char] for r in rows) == (t or "")
        for k, r in enumerate(rows):
            assert r.text == t[r.start_char : r.end_char] and r.piece == k
            assert len(enc.encode_ordinary(r.text)) == r.n_tokens <= limit
            assert r.start_char <= r.core_char and (k or r.start_char == 0)
            if k:
                lap = len(enc.encode_ordinary(t[r.start_char : r.core_char]))
                assert (lap == 0) == (overlap == 0) and lap <= overlap + 8


def test_an_edit_changes_only_near_pieces(spark):
    rng = random.Random(8)
    text = "\n".join(" ".join(rng.choice(["tea", "ledger", "turn", "slot", "window", "digest"]) + str(rng.randint(0, 99)) for _ in range(9)) + "." for _ in range(400))
    edited = text[:3000] + "An inserted line.\n" + text[3000:]
    rows = chunks.split(spark.createDataFrame([(1, text), (2, edited)], "doc_id long, text string"), 128, 0).collect()
    one, two = ({r.text for r in rows if r.doc_id == d} for d in (1, 2))
    assert len(one & two) >= 0.8 * len(one)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        chunks.Splitter(8, 0, tokens.DEFAULT)
