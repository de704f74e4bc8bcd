"""Text functions of the retrieval operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A run of Unicode white space (fixed values); Spark's own class ``\s`` has only the ASCII ones.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokens(text: Column) -> Column:
    """Words split at white space, lower-cased, without ASCII punctuation at either end; empty ones go."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: F.btrim(w, F.lit(string.punctuation)))
    return F.filter(words, lambda w: w != "")


def content_tokens(text: Column, stop: list[str]) -> Column:
    """Tokens that aren't stop words, repeats kept."""
    return F.filter(tokens(text), lambda w: ~w.isin(stop) if stop else F.lit(True))


def cache_key(provider: Column, model: Column, text: Column) -> Column:
    """Key of an embedding in a cache."""
    return F.sha2(F.concat_ws(":", provider, model, text), 256)


def parse_vector(csv: Column) -> Column:
    """Numbers of a comma-separated list; what isn't a number is left out."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x).try_cast("float")), lambda x: x.isNotNull())


def robertson_idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)
