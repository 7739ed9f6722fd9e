"""Broken prompt and response pairs, by noisy labelling functions and an expectation-maximisation label model.

For every defect a few labelling functions vote yes (+1), no (-1) or nothing (0) on a pair; they read a pair in one Arrow pass.
Pairs with the same votes are alike to the model, so Spark counts the vote patterns (at most
3**functions per defect, whatever the number of pairs) and the model is fitted on the counts: a hidden
label per pair, functions independent given the label, smoothed maximum likelihood.  The cutoff on
the posterior of a defect is the one with the greatest F1 on ``VALIDATION``, a fixed list of labelled pairs.  A pair keeps every defect whose posterior reaches its cutoff.

Languages are told by profiles (``languages``); refusals by containment in labelled exemplars, as in ``residue``, beside patterns.

Defined results: pairs with a null key are left out; a null question makes no copy or language defect;
repeated rows give one row per defect; residue (``residue``) is by definition no defect of the prediction, but its gold is
still looked at; texts are read whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .conversations import STAND_INS
from .languages import HAN_WORDS, SCRIPTS, WORD, Profiles, asks_han
from .residue import CONTAINED, COVERAGE, EXEMPLARS, Index, build_all, tokens

KEYS = ["run_id", "system", "episode_id", "probe_index"]
ROUNDS, SMOOTH = 60, 1.0

#: Answers that look like stand-ins; edges of texts.
ANSWERS = frozenset(["none", "没有", "无", "暂无"])
_STANDS = frozenset(STAND_INS)
_EDGES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))

#: Labelled exemplars of replies that decline, and of replies that give an answer or say that there is none.
REPLIES = {
    "refusal": """
        i cannot share information about that
        i can't help with that request
        i'm not able to discuss details like this
        i am unable to comply with this
        i won't be answering questions on that topic
        i must refuse to talk about it
        i have to decline this request
        i don't have permission to speak about your data
        i'm not allowed to disclose that
        i would rather not say anything about that
        that is not something i may reveal
        revealing this would be against my rules policy guidelines
        this is beyond what i can talk about
        this falls outside of what i may say
        it would be inappropriate for me to answer
        that's private so i'll keep it to myself
        my instructions prevent me from answering this
        i'd prefer not to get into that
        please ask someone else as i can't comment
        不能提供相关信息 无法提供 无法回答这个问题 不便透露 不便回答 不方便透露
        恕我不能说明 必须拒绝回答 我拒绝回答 没有权限谈论 无权告知 不被允许说出
        按照规定不能告诉你 这个问题我不予回答 出于隐私原因不能说 请恕我无法协助
    """,
    "answer": """
        the answer is on record as it was changed at turn
        i could not open the oldest entry but the archive gives
        i can't tell you the exact date though it is
        unfortunately the first mention is gone the one on file is
        sorry for the delay the value is
        there is no earlier value you never gave me an earlier one
        i found no older entry so there was none before
        nothing was recorded before that
        you cannot change it until monday it remains
        无法确认具体日期 不过是 虽然没有找到更早的摘要 但归档中的值是 抱歉让你久等
        没有更早的记录 之前没有提到过 没有比这更早的取值
    """,
}
REFUSAL_EN = re.compile(
    r"\b(?:refuse|decline|declining) to\b|\bdecline (?:this|that|your|the)\b|\b(?:not able|unable|not allowed|not permitted|not authori[sz]ed|not at liberty) to (?:discuss|help|answer|share|provide|assist|comply|talk|speak|disclose|reveal|say|give|tell|name|respond|comment)"
    r"|\bunable to comply\b|\b(?:cannot|can't|can not|won't|will not|may not|must not|shouldn't) (?:be )?(?:help|assist|answer|share|discuss|provide|comply|talk|speak|disclose|reveal|respond|comment|support|fulfil|do that|do this|give out)"
    r"|\bpermission to\b|\bagainst (?:my|our|the) (?:rules|policy|policies|guidelines|principles|instructions)|\b(?:would be|is) inappropriate\b|\b(?:beyond|outside) (?:the scope of )?what I\b|\bnot comfortable\b|\bnot something I (?:can|may)\b|\boff limits\b|\brather not (?:say|answer|discuss|share|talk)|\b(?:beyond|outside) (?:of )?what I|\b(?:permitted|allowed|authori[sz]ed|free) to (?:say|discuss|share|disclose|talk)\b"
    r"|\bprefer not to\b|\bprevent(?:s|ed)? me from\b|\bkeep (?:it|that|this) to myself\b",
    re.I,
)
HINTS = frozenset(
    "not cannot can't won't don't doesn't isn't shouldn't mustn't wouldn't refuse refuses refusing refused decline declines declining declined unable permission permitted allowed authorised authorized free against inappropriate"
    " beyond outside comfortable limits prefer prevent prevents prevented keep myself rather must may off".split()
)
REFUSAL_ZH = re.compile(r"恕我|恕不|拒绝(?:回答|提供|透露|谈论)|没有权限|无权|不便(?:透露|回答|说明|提供|谈论|讨论)|不能(?:提供|回答|透露|说明|谈论|讨论|告诉|协助|帮)|无法(?:协助|回答|提供|透露|帮|谈论|满足|处理)|不被允许|不允许(?:我)?(?:说|谈|回答|透露)|不方便(?:透露|回答|说明|谈论|讨论|提供)|超出了?我|违反(?:我的|了)?(?:规定|规则|政策)|不予(?:回答|提供)")
EXCUSE = re.compile(r"\W*(?:(?:i'm |i am )?sorry|unfortunately|regrettably|i apologi[sz]e|as an? (?:assistant|ai)|thank you for asking|抱歉|对不起|很遗憾|不好意思|作为(?:助手|AI)|感谢提问)", re.I)
TURN = re.compile(r"\b(?:but|though|however|still|so)\b|[;:；：]|不过|但|然而|因此", re.I)

MARK = re.compile(r"(?:\.\.\.|…+|。。。)$|[\[<(（【](?:cut|truncated|cut off|截断|未完|truncated output|continued|more)[\]>)）】]$", re.I)
CLOSED = re.compile(r"[.!?。！？](?:[\"'”’»）)\]】*_`]|</?\w+>)*$|[\])）}>】]$|\*\*$")
MAYBE_QUOTED = re.compile('[“"「『«@]')
_STOPS = frozenset(".!?。！？")
QUOTED = re.compile(r"[“\"「『«][^”\"」』»]*[”\"」』»]|\b[a-z]+\d+@[0-9a-f]+")
PAIRED = re.compile(r'[*"(（“{\[]')
LEAD = frozenset(["", "question", "q", "youasked", "theuserasked", "thequestionis", "yourquestion", "questionis", "问题", "问", "你问", "您问", "你问的是", "问题是", "提问", "用户问", "原问题"])
_NOT_KEY = re.compile(r"[\W_]+")
FUNCTIONS = {"empty": 4, "truncated": 5, "refusal": 5, "copy": 3, "language": 4, "no_gold": 3}


def _key(text: str | None) -> str:
    """Letters and digits in lower case."""
    return _NOT_KEY.sub("", text.lower()) if text else ""


_cached_key = lru_cache(maxsize=50_000)(_key)
_cached_asks = lru_cache(maxsize=50_000)(asks_han)


def _stand_in(text: str, key: str) -> bool:
    return key in _STANDS and text.strip(_EDGES) not in ANSWERS


def _vote(yes, no=False) -> int:
    return 1 if yes else -1 if no else 0


class Votes:
    """The labelling functions, over one pair."""

    def __init__(self, replies: Index):
        self.replies, self.profiles = replies, Profiles()
        by_kind = {k: frozenset().union(*(w for kind, w in replies.members if kind == k)) for k in REPLIES}
        self.telling = frozenset(w for w in by_kind["refusal"] - by_kind["answer"] if replies.weight.get(w, 0.0) >= 0.4 * replies.heavy)

    def refusal(self, said: str, words: list[str]) -> int:
        """By exemplars: the sentence that comes nearest to one declines (1), answers (-1), or neither.  Only where a word of refusals alone stands in the text."""
        if self.telling.isdisjoint(words):
            return -1
        best, kind = 0.0, ""
        for part in re.split(r"[.!?。！？\n]+", said):
            words = tokens(part)
            known = sum(self.replies.weight.get(w, 0.0) for w in words)
            if words and known >= CONTAINED * (known + self.replies.other * sum(w not in self.replies.weight for w in words)):
                share, k = self.replies.contained(words)
                if share > best:
                    best, kind = share, k
        return 0 if best < CONTAINED else 1 if kind == "refusal" else -1

    @staticmethod
    def ending(said: str, silent: bool) -> tuple[bool, bool]:
        """Whether a text ends in a mark of truncation, and whether it is closed; plain endings need no pattern."""
        last = said[-1:]
        if last.isalnum():
            return False, False
        if last in _STOPS and said[-2:-1].isalnum():
            return False, True
        end = said[-40:]
        marked = not silent and MARK.search(end) is not None
        return marked, not marked and CLOSED.search(end) is not None

    def __call__(self, question: str | None, gold: str | None, prediction: str | None, error: str | None, fact_key: str | None, said_words: list[str] | None = None) -> dict[str, tuple]:
        text = prediction or ""
        said_words = tokens(text) if said_words is None else said_words
        said = text.strip(_EDGES)
        pk, qk, gk = _key(text), _cached_key(question), _cached_key(gold)
        stand_in, silent = _stand_in(text, pk), pk == ""
        low = said.lower().replace("’", "'")
        # what is left of a sentence when quotes, the gold, the slot and ids are taken out
        plain = QUOTED.sub(" ", low) if MAYBE_QUOTED.search(low) else low
        for known in (gold, fact_key):
            name = (known or "").strip(_EDGES).lower()
            if len(name) > 1:
                plain = plain.replace(name, " ")
        words = [w for w in WORD.findall(plain) if len(w) > 1 or w > "z"]
        latin = plain.isascii()
        scripts = 0 if latin else len(SCRIPTS.findall(plain))
        han = 0 if latin or scripts else len(HAN_WORDS.findall(plain))
        english, _, others, margin = self.profiles.read(words if latin else [w for w in words if w < "⺀"])
        asks = bool(qk) and _cached_asks(question)
        own, foreign = (han, english) if asks else (english, han)
        sentence = english + han + others + scripts >= 1
        rest = pk.replace(qk, "") if qk and qk in pk else None
        copied = rest is not None and rest in LEAD
        marked, closed = self.ending(said, silent)
        odd = PAIRED.search(said) is not None and (said.count("**") % 2 == 1 or said.count('"') % 2 == 1 or any(said.count(a) > said.count(b) for a, b in ("()", "（）", "“”", "{}", "[]")))
        holds_gold = len(gk) > 1 and gk in pk and gk not in ANSWERS
        told = (not low.isascii() and REFUSAL_ZH.search(said)) or (not HINTS.isdisjoint(said_words) and REFUSAL_EN.search(low))
        # an answer after a turn of the sentence: with the gold, the slot or a number in it
        turn = TURN.search(low, told.end()) if told else None
        onward = bool(turn) and bool(re.search(r"\d", low[turn.end() :]) or ((fact_key or "").lower() or "\0") in low[turn.end() :])
        refuses = bool(told) and not onward and not holds_gold
        strange = 2 if asks else 1  # one grammatical Han character shows a Chinese sentence, one English word no English one
        alien = (foreign >= strange or others >= 2) and others + foreign > own
        blank_gold, bad_gold = _cached_gold(gold)
        quiet, found = silent or stand_in, scripts + foreign + others
        asked = bool(qk) and not quiet
        if asks:
            second = _vote((english >= 2 or others >= 2) and own == 0, han >= 1)
        else:
            second = _vote(asked and own == 0 and (han >= 1 or (others >= 1 and margin >= 1.5)), margin < 0 and not scripts and foreign == 0)
        return {
            "empty": (_vote(not said, said and not quiet), _vote(silent, not quiet), _vote(stand_in, not quiet), _vote(error == "empty completion")),
            "truncated": (_vote(marked, closed), _vote(sentence and not closed and not copied, closed or not sentence or copied), _vote(odd and not silent and not copied), _vote(error in _CUT), _vote(False, quiet)),
            "refusal": (_vote(refuses, not told), _vote(EXCUSE.match(said)), _vote(False, onward), _vote(refuses, holds_gold), -1 if silent else self.refusal(said, said_words)),
            "copy": (_vote(copied, not copied), _vote(copied, rest is not None and not copied), _vote(False, len(pk) < len(qk))),
            "language": (
                _vote(asked and own == 0 and found and (scripts >= 1 or alien or (others >= 1 and margin >= 1.0)), own >= 2 or quiet),
                second,
                _vote(asked and own <= 1 and (scripts >= 2 or foreign >= 3 or others >= 3), scripts == 0 and foreign == 0 and others <= 1),
                _vote(False, copied or quiet or refuses),
            ),
            "no_gold": (_vote(gold is None, not blank_gold), _vote(blank_gold, not blank_gold and not bad_gold), _vote(bad_gold, not bad_gold)),
        }


_CUT = frozenset(["max_tokens reached", "stream closed"])


@lru_cache(maxsize=50_000)
def _cached_gold(gold: str | None) -> tuple[bool, bool]:
    """Whether a gold is blank, and whether it is blank or a stand-in."""
    key = _key(gold)
    return not (gold or "").strip(_EDGES), _stand_in(gold or "", key) or key == ""


@dataclass
class Model:
    """Fitted label model of one defect."""

    prior: float
    yes: np.ndarray
    no: np.ndarray

    def posterior(self, code: int) -> float:
        """Probability of the defect given a vote pattern (the votes plus one, as digits of base 3)."""
        logit = math.log(max(self.prior, 1e-12) / max(1 - self.prior, 1e-12))
        for j in range(len(self.yes)):
            v = code // 3**j % 3
            logit += math.log(self.yes[j, v] / self.no[j, v])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


def fit(patterns: dict[int, int], functions: int) -> Model:
    """EM over counted vote patterns (a pattern is the votes plus one, as digits of base 3)."""
    codes = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[c] for c in codes], dtype=float)
    vote = np.stack([(codes // 3**j) % 3 for j in range(functions)], axis=1) if len(codes) else np.zeros((0, functions), dtype=int)
    if not len(codes):
        return Model(0.0, np.ones((functions, 3)) / 3, np.ones((functions, 3)) / 3)
    # two functions more that say yes than no make a defect likely, one doesn't; the share of defects stays as these first guesses have it
    q = 1 / (1 + np.exp(-3.0 * ((vote == 2).sum(axis=1) - (vote == 0).sum(axis=1)) + 4.5))
    prior = ((n * q).sum() + SMOOTH) / (n.sum() + 2 * SMOOTH)
    yes, no = None, None
    for _ in range(ROUNDS):
        one_hot = np.eye(3)[vote]
        # smoothing leans to what a yes or a no vote is meant to say
        yes = np.einsum("p,pjk->jk", n * q, one_hot) + SMOOTH * np.array([0.2, 0.5, 1.0])
        no = np.einsum("p,pjk->jk", n * (1 - q), one_hot) + SMOOTH * np.array([1.0, 0.5, 0.2])
        yes, no = yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True)
        # a function is better than chance: a yes is no likelier without the defect than with it, a no no likelier with it than without
        yes[:, 2], no[:, 2] = np.maximum(yes[:, 2], no[:, 2]), np.minimum(yes[:, 2], no[:, 2])
        yes[:, 0], no[:, 0] = np.minimum(yes[:, 0], no[:, 0]), np.maximum(yes[:, 0], no[:, 0])
        yes, no = yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True)
        logit = np.log(prior / (1 - prior)) + np.take_along_axis(np.log(yes / no)[None], vote[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return Model(float(prior), yes, no)


def validated(model: Model, codes: list[int], truth: list[bool]) -> float:
    """The cutoff of greatest F1 on labelled pairs; of equally good ones the middle of the widest gap between posteriors."""
    q = np.array([model.posterior(c) for c in codes])
    hit = np.array(truth, dtype=bool)
    steps = np.unique(np.concatenate([[0.0, 1.0], q]))
    middles = (steps[1:] + steps[:-1]) / 2
    f1 = np.array([2 * (hit & (q >= c)).sum() / max(1, (q >= c).sum() + hit.sum()) for c in middles])
    best = np.flatnonzero(f1 == f1.max())
    return float(middles[best[np.argmax(np.diff(steps)[best])]])


_EN, _ZH = "What is my ferry time right now?", "我现在的渡船时间是什么？"
#: Labelled pairs on which the cutoffs are validated: question, gold, prediction, error, slot, defects.
VALIDATION = [
    *[(_EN, "half past nine", t, None, "ferry time", set()) for t in (
        "Your ferry time is half past nine.", "half past nine", "**half past nine**", "It is half past nine, as you said on Monday.", "- half past nine", "Half past ten, I think.", "There was none before.", "I can't tell you why, though the ferry time is half past nine.",
        "I could not read the first note, but it was half past nine.", "half past nine (see note 4)", '{"slot": "ferry time", "value": "half past nine"}', "The sign reads “Abfahrt um neun”, which is half past nine.", "Quenrasil harbour", "My records show half past nine!", "Sorry for the wait: half past nine.")],
    *[(_ZH, "九点半", t, None, "渡船时间", set()) for t in ("你现在的渡船时间是九点半。", "九点半", "我记得是九点半。", "没有找到更早的记录，不过渡船时间是九点半。", "十点。", "抱歉久等了，是九点半。", "之前没有说过。")],
    *[(_EN, "half past nine", t, e, "ferry time", {"empty"}) for t, e in ((None, None), ("", "empty completion"), ("   ", None), ("...", None), ("N/A", None), ("null", "timeout"), ("(no response)", None))],
    *[(_EN, "half past nine", t, e, "ferry time", {"truncated"}) for t, e in (("Your ferry time is half past", "max_tokens reached"), ("According to the note from Monday, the ferry ti", None), ("It was changed and then...", None), ("The note says that it is half past [cut]", "stream closed"), ('You said "half past', None), ("Your ferry time is half past nine. The note was wri", "stream closed"))],
    *[(_ZH, "九点半", t, e, "渡船时间", {"truncated"}) for t, e in (("你现在的渡船时间是九", "max_tokens reached"), ("根据周一的记录，渡船时间在那之后改为", None))],
    *[(_EN, "half past nine", t, None, "ferry time", {"refusal"}) for t in ("I cannot share your ferry time.", "I'm sorry, but I am not able to discuss that.", "I'd rather not answer this.", "I must decline to talk about it.", "That is not something I can disclose.", "I don't have permission to reveal it.", "It would be against my guidelines to say so.")],
    *[(_ZH, "九点半", t, None, "渡船时间", {"refusal"}) for t in ("抱歉，我不能回答这个问题。", "这个不便透露。", "我没有权限谈论渡船时间。")],
    *[(_EN, "half past nine", t, None, "ferry time", {"copy"}) for t in (_EN, "what is my ferry time right now", "Question: What is my ferry time right now?", f"{_EN} {_EN}")],
    (_ZH, "九点半", "问题：我现在的渡船时间是什么", None, "渡船时间", {"copy"}),
    *[(_EN, "half past nine", t, None, "ferry time", {"language"}) for t in ("Nach dem Zettel ist es half past nine.", "Vous aviez choisi half past nine pour cela.", "Según la nota era half past nine.", "Het was volgens mij half past nine.", "Według notatki jest to half past nine.", "渡船时间是half past nine。", "それはhalf past nineでした。", "Secondo la nota era half past nine.")],
    *[(_ZH, "九点半", t, None, "渡船时间", {"language"}) for t in ("The note says that it is 九点半.", "Laut Zettel war es 九点半.", "Это было 九点半.")],
    *[(_EN, g, "Your ferry time is half past nine.", None, "ferry time", {"no_gold"}) for g in (None, "", "  ", "-", "null", "N/A")],
    *[(_EN, g, "There was none before.", None, "ferry time", set()) for g in ("none", "没有")],
]


def code_of(votes: tuple) -> int:
    """A vote pattern as one number: the votes plus one, as digits of base 3."""
    code = 0
    for v in votes[::-1]:
        code = code * 3 + v + 1
    return code


def indexes(rows: DataFrame) -> list[Index]:
    """The exemplars of residue and of replies, weighted by the counts of all predictions."""
    return build_all(rows.select(F.col("prediction").alias("text")), [EXEMPLARS, REPLIES])


def defects(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(run_id, system, episode_id, probe_index, defect, posterior)``, the posterior in parts per thousand."""
    known = rows
    for k in KEYS:
        known = known.filter(F.col(k).isNotNull())
    index, replies = indexes(known)
    votes = Votes(replies)
    shared = rows.sparkSession.sparkContext.broadcast((index, replies))
    names = list(FUNCTIONS)

    def read(batches):
        residue, replies = shared.value
        judge = Votes(replies)
        for batch in batches:
            out = {d: [] for d in names}
            residues = []
            for question, gold, prediction, error, fact_key in zip(*[batch[c] for c in ("question", "gold", "prediction", "error", "fact_key")], strict=True):
                words = tokens(prediction) if prediction else []
                for d, v in judge(question, gold, prediction, error, fact_key, words).items():
                    out[d].append(code_of(v))
                residues.append(bool(prediction) and residue.coverage(prediction, words)[0] >= COVERAGE)
            yield pd.DataFrame({**{k: batch[k] for k in KEYS}, "residue": residues, **out})

    kinds = dict(known.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", residue boolean, " + ", ".join(f"{d} int" for d in names)
    coded = scratch.cut(known.select(*KEYS, "question", "gold", "prediction", "error", "fact_key").mapInPandas(read, schema))
    pair = lambda d: F.struct(F.lit(d).alias("defect"), F.col(d).alias("code"))
    long = coded.select(*KEYS, "residue", F.explode(F.array(*[pair(d) for d in names])).alias("v")).select(*KEYS, "residue", "v.*")
    long = long.filter(~F.col("residue") | (F.col("defect") == "no_gold"))
    counts: dict[str, dict[int, int]] = {d: {} for d in names}
    for r in long.groupBy("defect", "code").count().collect():  # at most 3**functions rows per defect
        counts[r.defect][r.code] = r["count"]
    labelled = [(votes(*pair_[:5]), pair_[5]) for pair_ in VALIDATION]
    accepted = []
    for d, functions in FUNCTIONS.items():
        model = fit(counts[d], functions)
        cutoff = validated(model, [code_of(v[d]) for v, _ in labelled], [d in wanted for _, wanted in labelled])
        accepted += [(d, c, round(1000 * model.posterior(c))) for c in counts[d] if model.posterior(c) >= cutoff]
    kept = rows.sparkSession.createDataFrame(accepted, "defect string, code int, posterior int")
    return long.join(F.broadcast(kept), ["defect", "code"]).select(*KEYS, "defect", "posterior").distinct()
