"""Text functions that built-in expressions cannot give, or only by many passes, as pandas UDFs over whole Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import W_CJK, W_LATIN, W_OTHER, W_PUNCT, W_WORD

#: White space as the token rules count it; ranges of Han, kana and hangul.
_SPACES = [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CJK = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)]
_SPACE, _HAN, _LETTER, _ASCII, _OTHER = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> class of the token rules."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    table[:0x80] = _ASCII
    table[[cp for cp in range(0x110000) if unicodedata.category(chr(cp))[0] in "LN"]] = _LETTER
    for first, last in _CJK:
        table[first : last + 1] = _HAN
    table[_SPACES] = _SPACE
    return table


def _codes(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def estimates(texts: list[str]) -> np.ndarray:
    """Estimated tokens of each text by character classes and words, at least 1; 0 for an empty text.  One pass over all characters."""
    kinds, size = _codes("".join(texts)), np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    first = np.zeros(len(kinds) + 1, dtype=bool)
    first[ends - size] = True
    word = (kinds != _SPACE) & (first[: len(kinds)] | np.concatenate([[True], kinds[:-1] == _SPACE])[: len(kinds)])
    def per_text(marks):
        total = np.concatenate([[0], np.cumsum(marks)])
        return (total[ends] - total[ends - size]).astype(float)

    total = per_text(kinds == _HAN) * W_CJK + per_text(kinds == _LETTER) * W_LATIN + per_text(word) * W_WORD + per_text(kinds == _ASCII) * W_PUNCT + per_text(kinds == _OTHER) * W_OTHER
    return np.where(size > 0, np.maximum(1, np.rint(total)), 0).astype(np.int32)


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a text, at least 1; 0 for null or empty."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(estimates([t if isinstance(t, str) else "" for t in texts]) if len(texts) else [], dtype="int32")

    return count(text)


def _fitting(text: str, limit: int) -> int:
    """Characters of the longest prefix whose estimate is within the limit, by running weights."""
    kinds = _codes(text)
    weight = np.array([0.0, W_CJK, W_LATIN, W_PUNCT, W_OTHER])[kinds]
    weight[(kinds != _SPACE) & np.concatenate([[True], kinds[:-1] == _SPACE])[: len(kinds)]] += W_WORD
    over = np.maximum(1, np.rint(np.cumsum(weight))) > limit
    return int(np.argmax(over)) if over.any() else len(text)


def truncate_to_tokens(text: Column, limit: int, suffix: str = " ...") -> Column:
    """The longest prefix within the limit plus a suffix; the text itself where it fits; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or limit <= 0:
                return t if t is None else ""
            n = _fitting(t, limit)
            return t if n == len(t) else t[:n] + suffix

        return texts.map(one, na_action="ignore")

    return cut(text)


#: The tools, and the names under which their arguments come (letters only, in lower case).
TOOLS = ["get_archived_summary", "get_raw_record", "list_active_summaries", "get_predecessor_summary", "expand_index"]
ARGUMENTS = {
    "summary_id": ["summaryid", "sid", "summary"],
    "reference_id": ["referenceid", "refid", "rawrefid", "rawid"],
    "index_id": ["indexid", "index", "entryid", "catalogueid", "catalogid"],
    "fact_key": ["factkey", "key", "attribute", "attr", "slot", "field", "fact"],
    "reference_value": ["referencevalue", "refvalue", "anchor", "anchorvalue", "newvalue", "became", "currentvalue", "value"],
    "exclude_value": ["excludevalue", "exclude", "except", "oldvalue", "othervalue"],
}
#: Names whose meaning depends on the tool.
BY_TOOL = {
    "id": {"get_raw_record": "reference_id", "get_archived_summary": "summary_id", "expand_index": "index_id", "list_active_summaries": "summary_id"},
    "reference": {"get_predecessor_summary": "reference_value", "get_raw_record": "reference_id"},
    "ref": {"get_predecessor_summary": "reference_value", "get_raw_record": "reference_id"},
}
_MEANING = {alias: name for name, aliases in ARGUMENTS.items() for alias in aliases}
#: Lines that only repeat a tool's result; markup of calls.
_REPEATED = ("[tool result", "[superseded by", "[note]")
_BAR = r"[|｜]{1,2}\s*DSML\s*[|｜]{1,2}\s*"
_MARKUP_CALL = re.compile(rf"<{_BAR}invoke\s+name\s*=\s*[\"']([A-Za-z_]\w*)[\"'][^>]*>(.*?)</{_BAR}invoke\s*>", re.S | re.I | re.A)
_MARKUP_ARGUMENT = re.compile(rf"<{_BAR}parameter\s+name\s*=\s*[\"']([A-Za-z_]\w*)[\"'][^>]*>(.*?)</{_BAR}parameter\s*>", re.S | re.I | re.A)
_CALL = re.compile(r"\b(" + "|".join(TOOLS) + r")\s*\(([^)]*)\)")
_ARGUMENT = re.compile(r"[\"']?([A-Za-z_][A-Za-z0-9_]*)[\"']?\s*[=:]\s*(?:[\"']([^\"']*)[\"']|([^,)\s]+))")


def _without_repeats(text: str) -> str:
    lines = []
    for line in text.split("\n"):
        low = line.strip().lower()
        dashes = low.lstrip("-")
        if not low.startswith(_REPEATED) and not (len(low) - len(dashes) >= 2 and dashes.lstrip().startswith("tool result")):
            lines.append(line)
    return "\n".join(lines)


def meant(tool: str, argument: str) -> str:
    """The argument's own name, by its alias and the tool; the given name where none is known."""
    bare = re.sub(r"[^a-z]", "", argument.lower())
    return BY_TOOL.get(bare, {}).get(tool) or _MEANING.get(bare) or argument


def _json_calls(text: str):
    reader, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            got, end = reader.raw_decode(text, at)
        except ValueError:
            got, end = None, at + 1
        if isinstance(got, dict) and isinstance(got.get("name"), str) and isinstance(got.get("arguments"), dict):
            yield got["name"], got["arguments"].items()
        elif isinstance(got, dict):
            end = at + 1  # a call may stand inside
        at = text.find("{", end)


def find_calls(text: str) -> list[tuple[str, dict]]:
    """Tool calls of a reply: markup, else JSON objects with ``name`` and ``arguments``, else ``name(argument=value)``.

    Full-width signs are folded; lines that repeat a tool's result are no calls; of arguments with one meaning the first counts.
    """
    plain = _without_repeats(unicodedata.normalize("NFKC", text or ""))
    if not any(t in plain for t in TOOLS):
        return []
    forms = [
        lambda: [(m[1], [(a[1], a[2].strip().strip("\"'")) for a in _MARKUP_ARGUMENT.finditer(m[2])]) for m in _MARKUP_CALL.finditer(plain)],
        lambda: list(_json_calls(plain)),
        lambda: [(m[1], [(a[1], (a[2] if a[2] is not None else a[3]).strip()) for a in _ARGUMENT.finditer(m[2])]) for m in _CALL.finditer(plain)],
    ]
    for form in forms:
        calls = []
        for name, given in form():
            if name in TOOLS:
                args: dict[str, str] = {}
                for key, value in given:
                    args.setdefault(meant(name, str(key)), str(value))
                calls.append((name, args))
        if calls:
            return calls
    return []


def tool_calls(text: Column) -> Column:
    """Array of (name, args) of the tool calls in a reply; null gives an empty array."""

    @F.pandas_udf("array<struct<name:string,args:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "args": json.dumps(a, ensure_ascii=False, sort_keys=True)} for n, a in find_calls(t)] if isinstance(t, str) else [] for t in texts], dtype=object)

    return parse(text)
