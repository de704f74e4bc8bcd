"""Embeddings of texts with a cache table, so that no text is embedded twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import cache_key
from lodestar.staging import stage


def embed(texts: DataFrame, cache: DataFrame | None, function: Callable[[list[str]], np.ndarray], provider: str, model: str, dims: int, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """(texts with ``vec``, cache with the new entries); ``function`` gets lists of at most ``batch`` distinct texts.

    The new entries are written once, to the folder of intermediate tables, and both results read
    them from there, so ``function`` is asked once for each text, whatever is done with the results; only the
    task of a lost executor asks again.  Vectors come back with length 1; one of another dimension is an error.  Null texts
    have no vector; repeated texts share one.
    """
    keyed = texts.withColumn("key", cache_key(F.lit(provider), F.lit(model), F.col("text")))
    missing = keyed.where("text is not null").select("key", "text").dropDuplicates(["key"])
    if cache is not None:
        missing = missing.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                x = np.asarray(function(part["text"].tolist()), np.float32)
                if x.shape != (len(part), dims):
                    raise ValueError(f"the provider gave {x.shape}, not {(len(part), dims)}")
                n = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"key": part["key"], "vec": list(np.divide(x, n, out=x.copy(), where=n > 0))})

    new = stage(missing.mapInPandas(run, "key string, vec array<float>"), "embedded")
    whole = new if cache is None else cache.select("key", "vec").unionByName(new)
    return keyed.join(whole, "key", "left").drop("key"), whole


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("vec") * 4).alias("bytes"))
