"""Words of letters and digits inside tasks.

A word is a run of ASCII letters and digits and of characters beyond ASCII.  Texts are
cut into parts at word borders, so that a text of any length needs little memory; a
word, however long, is in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a part.
PIECE = 1 << 20

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: ASCII letters in lower case; all other ASCII characters but digits are spaces.
_TABLE = bytes(i if i > 127 or i in _KEPT else i + 32 if chr(i).isupper() else 32 for i in range(256))


def parts(raw: bytes) -> Iterator[bytes]:
    """A text in UTF-8, lower-cased (A to Z only) and with spaces between words, part by part."""
    at = 0
    while at < len(raw):
        part = raw[at : at + PIECE].translate(_TABLE)
        at += len(part)
        if at < len(raw) and part[-1:] != b" ":  # the last word goes on
            cut = part.rfind(b" ") + 1
            if cut:
                part, at = part[:cut], at - len(part) + cut
            else:
                end = at
                while end < len(raw) and _TABLE[raw[end]] != 32:
                    end += 1
                part, at = part + raw[at:end].translate(_TABLE), end
        yield part


def with_context(raw: bytes, n: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, old) of each part; the first ``old`` words, at most ``n``, end the parts before."""
    before: list[bytes] = []
    for part in parts(raw):
        words = before + part.split()
        yield words, len(before)
        before = words[-n:] if n else []
