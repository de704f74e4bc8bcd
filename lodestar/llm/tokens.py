"""Byte-level BPE ids inside tasks."""

from __future__ import annotations

import base64
import json

import numpy as np

#: Splitting pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    """Ids as the ``tokenizers`` file gives them.

    ``ranks`` holds the same vocabulary for tiktoken, which encodes plain text
    several times faster.  Two kinds of text are left to ``tokenizers`` itself, which is
    loaded when the first of them comes: one with the string of a special token, which
    gets its own id, and one whose splitting runs out of the fast encoder's stack (a run of
    about a million white-space characters).
    """

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken

        self.file, self.exact = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its regex gave up on a very long run
                pass
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def load(tokenizer: str, ranks: str) -> ByteBpe:
    """One encoder per worker process."""
    if (tokenizer, ranks) not in _loaded:
        _loaded[tokenizer, ranks] = ByteBpe(tokenizer, ranks)
    return _loaded[tokenizer, ranks]
