"""Splitting oversized items at natural boundaries, by content-defined chunking.

Every text is encoded once.  Positions in it are byte offsets that are token boundaries.  Natural boundaries are ends of turns,
paragraphs, lines and sentences, in falling rank.  A rolling hash over the last ``SPAN`` characters marks landmarks, on average
one every ``every`` characters; a piece ends at the natural boundary nearest to the first landmark
between its minimum and maximum size, else at the last boundary of the best rank there is, else at a token boundary.
Since landmarks depend on the text around them only, an edit changes the pieces near it and leaves the others as they are.

A piece is a core of at most ``limit - overlap`` tokens, preceded by the last ``overlap`` tokens before it; where a natural
boundary lies in the first quarter of these, the overlap starts there.  Pieces never exceed ``limit`` tokens when encoded alone.

Defined results: null texts and ids give no piece; an empty text gives none; a text within the limit is one piece; white
space and line ends are kept, so cores joined give the text; the cut is by characters, never within one; a single
character of more tokens than a core may hold is an error of the parameters (the limit is checked to be 16 tokens or more).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import DEFAULT, encoding

LIMIT, OVERLAP, SPAN = 512, 48, 24
#: Kinds of cut, best first.
KINDS = ("end", "turn", "paragraph", "line", "sentence", "token")

_LINE = re.compile(r"(?:\r\n|\r|\n)+[ \t]*(?:\r\n|\r|\n)*")
_TURN = re.compile(r"\s*(?:[\[<【]?(?:user|agent|assistant|system|human|bot|用户|助手|客服|系统)[\]>】]?\s*[:：]|[\[<](?:user|agent|assistant|system|s\d+)[\]>]|probe \d+:)", re.I)
_SENTENCE = re.compile(r"(?:[.!?](?=[\s\"'”’)\]]|$)|[。！？；…])[\"'”’」』）)\]]*")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of natural boundaries, and their ranks (1 turn .. 4 sentence)."""
    rank: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        rank[m.end()] = 4
    for m in _LINE.finditer(text):
        breaks = len(re.findall(r"\r\n|\r|\n", m[0]))
        rank[m.end()] = 1 if _TURN.match(text, m.end()) else 2 if breaks > 1 else 3
    rank.pop(len(text), None)
    rank.pop(0, None)
    at = np.array(sorted(rank), dtype=np.int64)
    return at, np.array([rank[a] for a in at.tolist()], dtype=np.int64)


def landmarks(text: str, every: int) -> np.ndarray:
    """Character offsets whose preceding ``SPAN`` characters hash to a landmark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) <= SPAN:
        return np.zeros(0, dtype=np.int64)
    h, have, base = codes, 1, 0x9E3779B97F4A7C15
    while have * 2 <= SPAN:
        h = h[:-have] * np.uint64(base) + h[have:]
        have, base = have * 2, base * base % (1 << 64)
    if have < SPAN:  # windows of SPAN as two that overlap
        h = h[: len(codes) - SPAN + 1] * np.uint64(0xBF58476D1CE4E5B9) + h[SPAN - have :]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.flatnonzero((h >> np.uint64(32)) % np.uint64(max(1, every)) == 0) + SPAN


class Splitter:
    def __init__(self, limit: int, overlap: int, tokenizer: str):
        if limit < 16 or not 0 <= overlap <= limit // 2:
            raise ValueError("the limit must be 16 tokens or more, the overlap at most half of it")
        self.enc, self.limit, self.overlap = encoding(tokenizer), limit, overlap
        self.core = limit - overlap
        self.least = self.core // 2
        size = self.enc.max_token_value + 1
        self.width = np.zeros(size, dtype=np.int32)
        for raw, rank in self.enc._mergeable_ranks.items():
            self.width[rank] = len(raw)

    def count(self, text: str) -> int:
        return len(self.enc.encode_ordinary(text))

    def split(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(start, core start, end, tokens, kind of cut at the end) of the pieces, in characters."""
        raw = text.encode("utf-8")
        tokens = self.enc.encode_ordinary(text) if len(raw) > self.limit else None
        if tokens is None or len(tokens) <= self.limit:
            return [(0, 0, len(text), len(tokens) if tokens is not None else self.count(text), "end")]
        ends = np.cumsum(self.width[tokens])  # byte offset after each token
        data = np.frombuffer(raw, dtype=np.uint8)
        char_bytes = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))  # byte offset of each character
        token_char = np.searchsorted(char_bytes, ends)
        clean = char_bytes[np.minimum(token_char, len(char_bytes) - 1)] == ends  # token ends between characters
        last = len(tokens)
        at, rank = boundaries(text)
        tok = np.searchsorted(ends, char_bytes[at]) + 1  # tokens before the boundary
        true = ends[np.minimum(tok, last) - 1] == char_bytes[at]
        at, rank, tok = at[true], rank[true], tok[true]
        marks = landmarks(text, max(8, self.core * 3 // 4))
        mark_tok = np.searchsorted(ends, char_bytes[marks], side="right")
        pieces, begin, first = [], 0, 0  # begin: token index, first: character index of the core
        while True:
            lead = self._lead(begin, first, at, tok, token_char, clean)
            if last - begin <= self.core:
                pieces.append(self._checked(text, lead[1], first, len(text), last - lead[0], "end"))
                return pieces
            cut, char, kind = self._cut(begin, at, rank, tok, mark_tok, token_char, clean)
            piece = self._checked(text, lead[1], first, char, cut - lead[0], kind)
            pieces.append(piece)
            if piece[2] != char:  # the cut moved back to keep the limit
                char = piece[2]
                cut = int(np.searchsorted(ends, char_bytes[char]))
            begin, first = cut, char

    def _cut(self, begin, at, rank, tok, mark_tok, token_char, clean):
        low, high = begin + self.least, begin + self.core
        lo, hi = np.searchsorted(tok, low), np.searchsorted(tok, high, side="right")
        if lo < hi:
            m = np.searchsorted(mark_tok, low)
            if m < len(mark_tok) and mark_tok[m] <= high:
                k = lo + int(np.argmin(np.abs(tok[lo:hi] - mark_tok[m])))
            else:
                best = rank[lo:hi].min()
                k = lo + int(np.flatnonzero(rank[lo:hi] == best)[-1])
            return int(tok[k]), int(at[k]), KINDS[rank[k]]
        near = np.searchsorted(tok, begin + max(1, self.least // 4))
        if near < lo:  # nothing between minimum and maximum: the last boundary before them
            return int(tok[lo - 1]), int(at[lo - 1]), KINDS[rank[lo - 1]]
        m = np.searchsorted(mark_tok, low)
        end = int(mark_tok[m]) if m < len(mark_tok) and mark_tok[m] <= high else high
        while end > begin + 1 and not clean[end - 1]:
            end -= 1
        return end, int(token_char[end - 1]), "token"

    def _lead(self, begin, first, at, tok, token_char, clean):
        """(token, character) at which the overlap before a core starts."""
        if not begin or not self.overlap:
            return begin, first
        low = max(0, begin - self.overlap)
        k = np.searchsorted(tok, low)
        if k < len(tok) and tok[k] <= low + self.overlap // 4:
            return int(tok[k]), int(at[k])
        while low < begin and not (low == 0 or clean[low - 1]):
            low += 1
        return low, int(token_char[low - 1]) if low else 0

    def _checked(self, text, start, first, end, n, kind):
        """The piece with its own token count; moves its end back in the rare case that alone it has more tokens."""
        if kind in ("token", "end") or n > self.limit - 8 or text[end - 1].isspace():
            n = self.count(text[start:end])
            while n > self.limit:
                if start < first:
                    start = min(first, start + max(1, n - self.limit))
                else:
                    end, kind = max(first + 1, end - max(1, n - self.limit)), "token"
                n = self.count(text[start:end])
        return start, first, end, n, kind


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = DEFAULT) -> DataFrame:
    """``(doc_id, piece, start_char, core_char, end_char, n_tokens, cut, text)``; no shuffle, one row of text at a time."""

    def run(batches):
        splitter = Splitter(limit, overlap, tokenizer)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                if isinstance(text, str) and text:
                    rows += [(doc_id, k, a, c, b, n, kind, text[a:b]) for k, (a, c, b, n, kind) in enumerate(splitter.split(text))]
                    size += len(text)
                if size > 4_000_000:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS)

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id bigint, piece int, start_char int, core_char int, end_char int, n_tokens int, cut string, text string")


COLUMNS = ["doc_id", "piece", "start_char", "core_char", "end_char", "n_tokens", "cut", "text"]
