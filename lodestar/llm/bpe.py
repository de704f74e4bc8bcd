"""A BPE model's segmentation as paths over boundary states.

Merging by rank has a local test: a sequence of pieces is what merging leaves exactly if
every two neighbours, strung together and merged on their own, give these two pieces back.
For no merge across a border can come first in the whole text that doesn't come first
between the two pieces at the border, as merges are picked by rank and then from the left.
So each text has one path of pieces whose steps all pass the test, and a chunk of it can be
followed from any piece that may lie across its beginning.

A boundary state is ``(back, over)``: the piece that covers the character before the
boundary begins ``back`` characters before it and ends ``over`` beyond it.  A step scores 0
if it passes the test, else minus infinity, so a chunk's transfer matrix holds 0 where a
path leads from one state to another.

Where no piece of the model holds a space mark after another character, every path has a
border at the beginning of a run of space marks: paths meet there, and the words in between
have pieces of their own, which a worker remembers.  A chunk without such a place is followed
character by character.
"""

from __future__ import annotations

import re

import numpy as np

#: The state before a text.
START = (0, 0)
#: Pairs of pieces, and words, that a worker remembers before it starts afresh.
CACHED_PAIRS, CACHED_WORDS = 1_000_000, 200_000
#: Stands for a space in normalised texts (fixed value).
MARK = "\u2581"
_WORD = re.compile(f"{MARK}+[^{MARK}]+")


class Bpe:
    """Pieces of a SentencePiece BPE model; texts are normalised as the model does."""

    def __init__(self, processor):
        import ahocorasick

        sp = self.sp = processor
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.longest = max(map(len, self.ids))
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.finder = ahocorasick.Automaton()
        for piece in self.ids:
            self.finder.add_word(piece, len(piece))
        self.finder.make_automaton()

    def merged(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` on its own leaves these two pieces (or one, if ``a`` is empty)."""
        text, score = a + b, self.score.get
        edges = list(range(len(text) + 1))
        low = -np.inf
        value = [score(text[i : i + 2], low) for i in range(len(text) - 1)]
        while value:
            best = max(value)
            if best == low:
                break
            i = value.index(best)
            if a and edges[i + 1] == len(a):
                return False
            del edges[i + 1], value[i]
            if i:
                value[i - 1] = score(text[edges[i - 1] : edges[i + 1]], low)
            if i < len(value):
                value[i] = score(text[edges[i] : edges[i + 2]], low)
        return len(edges) == (3 if a else 2)

    def goes(self, a: str, b: str) -> bool:
        """``merged``, remembered."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a, b)
        return found

    def paths(self, text: str, at: int, before: int, end: int, stop: int, like: dict[int, int] | None = None) -> dict[int, int] | None:
        """position -> length of the piece that ends there, of all paths on from a piece of length ``before`` that ends ``at``.

        Pieces begin before ``end`` and end at ``stop`` at the latest.  None once the paths go on as ``like`` does.
        """
        ends: list[list[int]] = [[] for _ in range(stop - at + 1)]
        for last, n in self.finder.iter(text, at, stop):
            ends[last + 1 - at].append(n)
        path, same, most = {at: before}, 0, self.longest
        for q in range(at + 1, stop + 1):
            for n in ends[q - at] if text[q - 1] in self.ids else (*ends[q - at], 1):
                held = path.get(q - n)
                if held is not None and q - n < end and self.goes(text[q - n - held : q - n], text[q - n : q]):
                    path[q] = n
                    break
            if like is not None:
                same = same + 1 if path.get(q) == like.get(q) else 0
                if same > most and q < end:
                    return None
        return path

    def word(self, word: str) -> list[int]:
        """Ids of a text of its own."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            found = self.words[word] = self.back(word, self.paths(word, 0, 0, len(word), len(word)), len(word), 0)
        return found

    def back(self, text: str, path: dict[int, int], q: int, at: int) -> list[int]:
        """Ids of the pieces of a path between ``at`` and ``q``."""
        out = []
        while q > at:
            out.append(text[q - path[q] : q])
            q -= path[q]
        return [x for piece in reversed(out) for x in self.numbers(piece)]

    def numbers(self, piece: str) -> list[int]:
        """Ids of a piece; a character that the model lacks is its bytes, or unknown."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[x] for x in piece.encode("utf-8", "surrogatepass")] if self.fallback else [self.sp.unk_id()]


class Chunk:
    """``size`` characters of a text from ``begin`` on in ``text``, which goes on for the longest piece on both sides where the text does."""

    def __init__(self, model: Bpe, text: str, begin: int, size: int):
        self.model, self.text, self.begin, self.end = model, text, begin, begin + size
        self.stop = min(self.end + model.longest - 1, len(text))
        # First and last place in the chunk where all paths have a border.
        self.meet = self.part = None
        if model.splits:
            found = [m.start() for m in _WORD.finditer(text) if begin + model.longest <= m.start() < self.end and text[m.start() - 1] != MARK]
            if found:
                self.meet, self.part = found[0], found[-1]

    def states(self, boundary: int) -> list[tuple[int, int]]:
        """States that the text around a boundary allows, the same from either side."""
        if boundary == 0:
            return [START]
        text, most = self.text, self.model.longest
        near = ((back, over) for over in range(min(most, len(text) - boundary + 1)) for back in range(1, min(most - over, boundary) + 1))
        return sorted((back, over) for back, over in near if (piece := text[boundary - back : boundary + over]) in self.model.ids or len(piece) == 1)

    def _from(self, state: tuple[int, int], end: int, stop: int, like=None):
        return self.model.paths(self.text, self.begin + state[1], sum(state), end, stop, like)

    def _reached(self, path: dict[int, int], at: int) -> np.ndarray:
        """Row of scores of the states at the end."""
        return np.array([0.0 if path.get(self.end + over) == back + over and self.end - back >= at else -np.inf for back, over in self.states(self.end)])

    def transfer(self) -> np.ndarray:
        """(states at the beginning, states at the end): 0 where a path leads, else minus infinity."""
        rows = self.states(self.begin)
        if self.meet is not None:
            row = self._reached(self._tail(), self.part)
            none = np.full(len(row), -np.inf)
            return np.array([row if self.meet in self._from(s, self.meet, self.meet) else none for s in rows])
        matrix, first, known = [], None, None
        for s in rows:
            path = self._from(s, self.end, self.stop, first)
            matrix.append(known if path is None else self._reached(path, self.begin + s[1]))
            if first is None and (matrix[-1] == 0).any():
                first, known = path, matrix[-1]
        return np.array(matrix)

    def _tail(self) -> dict[int, int]:
        return self.model.paths(self.text, self.part, 0, self.end, self.stop)

    def trace(self, first: int, last: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        state, (_, over) = self.states(self.begin)[first], self.states(self.end)[last]
        back, start = self.model.back, self.begin + state[1]
        if self.meet is None:
            return back(self.text, self._from(state, self.end, self.stop), self.end + over, start)
        head = back(self.text, self._from(state, self.meet, self.meet), self.meet, start)
        words = _WORD.findall(self.text[self.meet : self.part])
        return [*head, *(x for w in words for x in self.model.word(w)), *back(self.text, self._tail(), self.end + over, self.part)]
