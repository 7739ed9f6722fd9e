"""Token counts of a public tokenizer, in Arrow batches.

The vocabulary file is a parameter; it is read on each worker and never copied into the library.
"""

from __future__ import annotations

import base64
import os

#: The pre-tokenisation pattern and the file of the default vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

_loaded: dict = {}


def encoding(path: str = DEFAULT):
    """The byte-level encoder of a rank file, once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def clean(text) -> str:
    """Text that can be written as UTF-8; null is empty."""
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else ""
