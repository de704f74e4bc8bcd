"""Weak supervision of document quality.

Rules look at one document each and vote good, bad or nothing.  How often they vote
alike tells how accurate each is: expectation-maximisation over the table of vote
patterns starts from the majority of each pattern's votes and estimates how often every
rule votes good or bad on good and on bad documents, and the share of good ones.  A
document's verdict is its posterior probability of being good.  A bad vote of a rule
that is often wrong, or that stands alone, doesn't reject a document; no vote at all
where good documents get good votes may.

The pattern table has at most ``3 ** rules`` rows whatever the corpus, counted
over all documents; nothing else reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.scratch import stage
from lodestar.llm.words import slices

GOOD, BAD, ABSTAIN = 1, -1, 0

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    total, covered = 0, 0  # covered: words before this position are counted
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_distinct, n_bars, n_marked, n_stops of one whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.translate(None, _SPACES)]
    ascii_letters = len(raw) - len(raw.translate(None, _ASCII_LETTERS))
    letters = ascii_letters + len(text) - len(raw.translate(None, _NOT_ASCII))
    upper = len(raw) - len(raw.translate(None, _ASCII_UPPER))
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, _SPACES))), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters, len(set(words)), words.count(b"|"), len(_MARKED.findall(raw)), sum(raw.count(x) for x in (b". ", b".\n", b"! ", b"? ")),
    )


_ASCII_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _ASCII_UPPER + bytes(range(97, 123))
_NOT_ASCII = bytes(range(128, 256))
_MARKED = re.compile(rb"[#*$%&|<>!=@{}\[\]\\^~_][^ \t\n\x0b\x0c\r]*")

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_bars", "n_marked", "n_stops"]


@dataclass(frozen=True)
class Rule:
    """On a ratio of two statistics: bad above ``bad``, good at or below ``good``, else no vote."""

    name: str
    top: str
    bottom: str
    bad: float
    good: float


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.10, 0.01),
    Rule("repeats", "n_repeat_words", "n_words", 0.30, 0.10),
    Rule("lines", "n_dup_lines", "n_lines", 0.30, 0.05),
    Rule("capitals", "n_upper", "n_letters", 0.30, 0.10),
    Rule("sameness", "lost", "n_words", 0.80, 0.50),
    Rule("marks", "n_marked", "n_words", 0.40, 0.05),
    Rule("sentences", "run", "n_words", 0.60, 0.05),
    Rule("letters", "other", "word_chars", 0.30, 0.12),
    Rule("length", "off", "n_words", 3.5, 2.0),
)


#: Characters of a usual word.
USUAL_LENGTH = 6.5


def votes(stats: dict[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """(documents, rules) votes; without words no rule votes."""
    s = dict(stats, lost=stats["n_words"] - stats["n_distinct"], other=stats["word_chars"] - stats["n_letters"])
    s["off"] = np.abs(stats["word_chars"] - USUAL_LENGTH * stats["n_words"])  # how far words are from their usual length
    # Words that no sentence end accounts for, at 60 words a sentence.
    s["run"] = np.maximum(stats["n_words"] - 60 * (stats["n_stops"] + stats["n_lines"]), 0)
    out = np.zeros((len(stats["n_words"]), len(rules)), np.int8)
    for j, r in enumerate(rules):
        bottom = s[r.bottom].astype(np.float64)
        ratio = np.divide(s[r.top], bottom, out=np.full(len(bottom), np.nan), where=bottom > 0)
        out[:, j] = np.where(ratio > r.bad, BAD, np.where(ratio <= r.good, GOOD, ABSTAIN))
    return out


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; table[class, rule, vote + 1]: how each class votes."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of being good, for (documents, rules) votes."""
        j = np.arange(v.shape[1])
        score = [np.log(self.table[c, j, v + 1]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1] + np.log(1 - self.prior) - np.log(self.prior), -700, 700)))


#: Documents of each class that are imagined, as a share of all, and how they vote: bad, nothing, good.
IMAGINED, BAD_VOTES, GOOD_VOTES = 0.02, (0.4, 0.3, 0.3), (0.1, 0.3, 0.6)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns with their counts.

    It starts from the share of good votes among a pattern's votes.  Imagined documents,
    a fixed share of the corpus, say which class is which and leave the bad class a
    meaning in a corpus without bad documents; in any corpus they weigh the same.
    """
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    q = (good + 1) / (good + bad + 2)
    mass = IMAGINED * counts.sum() + 1
    pseudo = np.empty((2, patterns.shape[1], 3))
    pseudo[0], pseudo[1] = BAD_VOTES, GOOD_VOTES
    model = LabelModel(0.5, pseudo)
    for _ in range(rounds):
        table = mass * pseudo
        for v in (BAD, ABSTAIN, GOOD):
            table[1, :, v + 1] += (counts * q) @ (patterns == v)
            table[0, :, v + 1] += (counts * (1 - q)) @ (patterns == v)
        model = LabelModel(float((counts @ q + mass) / (counts.sum() + 2 * mass)), table / table.sum(axis=2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def _measure(text: str):
    """Stats and votes of each row, beside the columns that came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([statistics(x) for x in batch.column(text).to_pylist()], np.int64).reshape(-1, len(STATS))
            cast = votes({n: found[:, i] for i, n in enumerate(STATS)})
            rest = [n for n in batch.schema.names if n not in _ADDED]
            columns = [batch.column(n) for n in rest] + [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(STATS))]
            pattern = pa.array(["".join("-0+"[v + 1] for v in row) for row in cast], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pattern], [*rest, *STATS, "votes"])

    return run


_ADDED = {*STATS, "votes", "base_failed", "posterior", "kept"}


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics of ``text`` and the rules' votes as a string of + - 0."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in _ADDED] + [T.StructField(n, T.LongType()) for n in STATS] + [T.StructField("votes", T.StringType())])
    return df.mapInArrow(_measure(text), schema)


def judge(df: DataFrame, text: str = "text", keep_at: float = 0.5, texts: bool = True) -> DataFrame:
    """Every row with statistics, votes, ``posterior``, ``base_failed`` and ``kept``.

    A row is kept if it isn't ``base_failed`` (under 50 words, or more than half of
    them in repeated windows) and its posterior is at least ``keep_at``.  A null
    text counts as empty; repeated rows are judged alike; columns of ``df`` with a
    name that is added are replaced; an empty table gives an empty table.  Texts are read
    once and the measured rows staged, without the column ``text`` unless ``texts``.
    """
    measured = measure(df, text)
    measured = stage(measured if texts else measured.drop(text), "quality-measured")
    rows = measured.groupBy("votes").count().collect()  # at most 3 ** len(RULES)
    code = lambda v: np.array([["-0+".index(x) - 1 for x in s] for s in v], np.int8).reshape(-1, len(RULES))
    seen = code([r["votes"] for r in rows])
    posterior = fit(seen, np.array([float(r["count"]) for r in rows])).posterior(seen)
    table = df.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(rows, posterior)], "votes string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
