"""Secret scanning over a trigram inverted index.

Every rule's regex gives a Boolean trigram query: what any match must contain.  The
index has postings (trigram, document) for the trigrams that some rule asks for.
Intersecting postings gives each rule's candidate documents, and only those are
searched with the regex; a rule without mandatory trigrams searches all.  Trigrams
are taken from lower-cased text, so that a query holds in either case.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.running import cuts, running
from lodestar.llm.scratch import sized, stage


@dataclass(frozen=True)
class Rule:
    """A regex; a match counts if its ``group`` has at least ``least`` characters.

    ``quick`` is a regex that any text with such a match also matches; it rules out most
    texts without listing matches that are too short.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    quick: str | None = None


#: Patterns and lengths of the base kinds and of public token formats (fixed values).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: A private key: to its END line, or, if that is cut off, over header lines to the last line of base64.  Line
#: ends may be escaped or quoted.  Repeats of groups are possessive: others would recurse in Java for each repeat.
_B64 = "[A-Za-z0-9+/=]"
_SEP = r"""(?:[\s"',;>|#*+.]|\\++[nrt]?|<br */?>)"""
_PEM = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_SEP}*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!{_B64}{{40}}|\\++[nr])[^\r\n])*+)*+"
    rf"(?:(?:{_SEP}*+{_B64}{{16,}}+)++(?:{_SEP}++{_B64}{{1,15}}+(?=[ \t]*+(?:[\r\n\"'\\]|-----|\Z))){{0,2}}"
    rf"|(?:{_SEP}++{_B64}{{1,15}}+(?=[ \t]*+(?:[\r\n\"'\\]|-----|\Z))){{1,2}})|)"
)
ADDED = (
    Rule("pem", _PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: Strings that a part of a regex may stand for before they are no longer listed.
_MOST = 64


def _strings(part) -> set[str] | None:
    """All strings that a parsed part matches, lower-cased, or None if they are too many."""
    kind, value = str(part[0]), part[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        out: set[str] = set()
        for item, v in value:
            if str(item) == "LITERAL":
                out.add(chr(v).lower())
            elif str(item) == "RANGE" and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out
    if kind == "SUBPATTERN":
        return _joined(value[3])
    if kind == "BRANCH":
        options = [_joined(x) for x in value[1]]
        return None if None in options else set().union(*options)
    if kind == "MAX_REPEAT" and value[1] <= 4:
        once = _joined(value[2])
        if once is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)} if len(once) ** value[1] <= _MOST else None
        return out
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for part in parts:
        more = _strings(part)
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Conjunction of alternatives; an alternative is the set of trigrams that it needs.

    An empty list asks for nothing: the regex has no mandatory trigram.
    """
    runs: list[set[str]] = []
    current = {""}

    def walk(parts) -> None:
        nonlocal current
        for part in parts:
            more = _strings(part)
            if more is not None and len(current) * len(more) <= _MOST:
                current = {a + b for a in current for b in more}
                continue
            runs.append(current)
            current = {""}
            if more is not None:
                current = more
            elif str(part[0]) == "SUBPATTERN":
                walk(part[1][3])
                runs.append(current)
                current = {""}
            elif str(part[0]) == "MAX_REPEAT" and part[1][0] >= 1:
                walk(part[1][2])
                runs.append(current)
                current = {""}

    walk(re._parser.parse(regex))  # noqa: SLF001
    runs.append(current)
    query = []
    for run in runs:
        needs = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in needs:
            continue
        query.append(sorted((n for n in needs if not any(m < n for m in needs)), key=sorted))
    return query


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(key, rules)``: indexes of the rules whose trigram query each document meets, from ``(key, text)``."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    grams = sorted({g for q in queries.values() for part in q for need in part for g in need})
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    postings = docs.select("key", low.alias("low")).select(F.explode(held).alias("gram"), "key")
    at = {g: i for i, g in enumerate(grams)}
    terms = [(at[g], i, p, a, len(need)) for i, q in queries.items() for p, part in enumerate(q) for a, need in enumerate(part) for g in need]
    wanted = docs.sparkSession.createDataFrame(terms, "gram int, rule int, part int, option int, need int")  # a row for each trigram of the rules
    met = postings.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "part", "option", "need").agg(F.countDistinct("gram").alias("n")).where("n = need")
    parts = docs.sparkSession.createDataFrame([(i, len(q)) for i, q in queries.items()], "rule int, parts int")
    whole = met.groupBy("key", "rule").agg(F.countDistinct("part").alias("n")).join(F.broadcast(parts), "rule").where("n = parts")
    return whole.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """Pieces between the matches, the matches, and the group that decides, of a wanted document."""
    regex = F.lit(rule.regex)
    found = F.arrays_zip(F.split(text, rule.regex, -1).alias("before"), F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))
    return F.when(wanted & text.rlike(rule.quick or rule.regex), found)


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(rule: Rule, rank: int, found: Column) -> Column:
    """Spans (code points) of the matches that count."""

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.length(m["before"])
        end = start + F.coalesce(F.length(m["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return end, F.when(F.length(m["part"]) >= rule.least, span)

    return F.coalesce(F.array_compact(running(found, _SPAN, F.lit(0), step)), F.array().cast(f"array<{_SPAN}>"))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with ``secrets``: spans (start, rank, end, kind) by start, then the rule's rank; end is exclusive.

    Spans are code points of the whole text; a null text is empty.  Matches of one
    rule don't overlap, those of different rules may.  Repeated rows get equal spans;
    a column of ``df`` called ``secrets`` is replaced.
    """
    key = F.xxhash64(F.col(id_col), F.col(text))
    docs = df.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    able = stage(candidates(docs, rules).select(F.col("key").alias("_key"), F.col("rules").alias("_rules")), "secret-candidates")
    rest = df.drop(*[c for c in ("_key", "_rules", "secrets") if c != text])
    joined = rest.withColumn("_key", key).join(sized(able), "_key", "left").select(*[rest[c] for c in rest.columns], "_rules")
    body = F.coalesce(F.col(text), F.lit(""))
    full = {i for i, r in enumerate(rules) if not trigram_query(r.regex)}
    held = [(_matches(r, body, F.lit(True) if i in full else F.coalesce(F.array_contains("_rules", i), F.lit(False)))).alias(f"_m{i}") for i, r in enumerate(rules)]
    found = joined.select(*rest.columns, *held)
    spans = F.concat(*[_spans(r, i, F.col(f"_m{i}")) for i, r in enumerate(rules)])
    return found.select(*rest.columns, F.array_sort(spans).alias("secrets"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced; no spans leave it as it is, a null text stays null."""

    def step(far: Column, s: Column) -> tuple[Column, Column]:
        """How far spans have reached before a span."""
        return F.greatest(far, s["end"]), F.struct(far.alias("far"), s["start"].alias("start"))

    seen = running(spans, "struct<far:int,start:int>", F.lit(0), step)
    # Clean text lies between how far the spans before a run have reached and where the run starts.
    before = F.transform(F.filter(F.transform(seen, lambda s, i: F.struct(s["far"].alias("start"), s["start"].alias("end"), (i == 0).alias("first"))), lambda s: s["first"] | (s["end"] >= s["start"])), lambda s: F.struct(s["start"], s["end"]))
    rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end"))
    clean = cuts(text, F.array_append(before, rest))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(clean, mask))
