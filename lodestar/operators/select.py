"""Choice of a codec: profiles, grid search, cascade, model families."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import vec as V
from lodestar.operators import arrow, codecs, quality, training
from lodestar.operators.bm25 import word_counts
from lodestar.session import dimension

#: Words whose directions a task remembers before it starts afresh.
KNOWN_WORDS = 50_000
#: Texts whose words are looked up together, and directions that are summed at once.
TEXTS, WORDS = 256, 4_096


@dataclass(frozen=True)
class Profile:
    name: str
    bits: int
    range_factor: float
    percentile: float
    least_cosine: float

    def __post_init__(self) -> None:
        if not (1 <= self.bits <= 8 and 0 <= self.range_factor <= 1 and 0 <= self.percentile <= 100 and 0 <= self.least_cosine <= 1):
            raise ValueError(f"profile {self.name} is out of range")


#: Built-in profiles (fixed values).
PROFILES = {p.name: p for p in (Profile("fast", 8, 1.0, 100.0, 0.990), Profile("balanced", 8, 0.95, 99.5, 0.995), Profile("quality", 8, 0.90, 99.0, 0.997), Profile("ultra", 4, 0.85, 98.0, 0.985), Profile("binary", 1, 1.0, 100.0, 0.75))}

#: Range factors of batch encoding; a name that isn't listed means balanced (fixed values).
RANGE_FACTORS = {"fast": 1.0, "balanced": 0.95, "quality": 0.90}

#: Architectures, family and codec, the first match counts (fixed values).
FAMILIES = (
    (("NewModel", "GteModel"), "gte", "int8"),
    (("BGEModel",), "bge", "nf4"),
    (("XLMRobertaModel", "RobertaModel", "E5Model"), "e5", "int8"),
    (("Qwen2Model", "Qwen2_5Model", "Qwen2ForSequenceClassification"), "qwen2", "int8"),
    (("DebertaModel", "DebertaV2Model", "DebertaForSequenceClassification", "DebertaV2ForSequenceClassification"), "deberta", "nf4"),
    (("BertModel",), "bert", "nf4"),
)


def profiles_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(vars(p).values()) for p in PROFILES.values()], "name string, bits int, range_factor double, percentile double, least_cosine double")


def add_profile(profile: Profile) -> None:
    PROFILES[profile.name] = profile


def remove_profile(name: str) -> None:
    PROFILES.pop(name, None)


def _simulated(df: DataFrame, named: dict[str, Profile]) -> DataFrame:
    """``(name, vec, decoded)``: every vector after each profile, in one pass."""
    one = [F.struct(F.lit(n).alias("name"), codecs.profile_simulated(F.col("vec"), p.bits, p.range_factor, p.percentile).alias("decoded")) for n, p in named.items()]
    return df.select("id", "vec", F.explode(F.array(*one)).alias("p")).select("id", "vec", "p.name", "p.decoded")


def compare_profiles(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(name, mean_cosine, mae, ratio, grade, passes)``."""
    named = {n: PROFILES[n] for n in names or ("fast", "balanced", "quality", "ultra")}
    error = V.total(F.zip_with("vec", "decoded", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    per = _simulated(df, named).groupBy("name").agg(F.avg(V.cosine(F.col("vec"), F.col("decoded"))).alias("mean_cosine"), (F.sum(error) / F.sum(F.size("vec"))).alias("mae"), (F.sum(F.size("vec")) * 4 / (F.sum(F.size("vec")) + 4 * F.count(F.lit(1)))).alias("ratio"))
    least = F.create_map(*[x for n, p in named.items() for x in (F.lit(n), F.lit(p.least_cosine))])
    return per.select("name", "mean_cosine", "mae", "ratio", quality.grade(F.col("mean_cosine")).alias("grade"), (F.col("mean_cosine") >= least[F.col("name")]).alias("passes"))


#: Range factors and percentiles of the grid (fixed values).
GRID = [(r, p) for r in (0.80, 0.85, 0.90, 0.95, 1.0) for p in (95.0, 97.5, 99.0, 99.5, 100.0)]


def grid_search(df: DataFrame, target_cosine: float = 0.995, target_ratio: float = 3.0, bits: int = 8) -> DataFrame:
    """``(range_factor, percentile, mean_cosine, ratio, score)`` of all settings, the best first."""
    named = {f"{r}/{p}": replace(PROFILES["balanced"], name=f"{r}/{p}", range_factor=r, percentile=p, bits=bits) for r, p in GRID}
    per = _simulated(df, named).groupBy("name").agg(F.avg(V.cosine(F.col("vec"), F.col("decoded"))).alias("mean_cosine"), (F.sum(F.size("vec")) * 4 / (F.sum(F.size("vec")) + 4 * F.count(F.lit(1)))).alias("ratio"))
    parts = F.split("name", "/")
    score = (0.7 * F.col("mean_cosine") / target_cosine + 0.3 * F.col("ratio") / target_ratio) * F.when(F.col("mean_cosine") < target_cosine, 0.5).otherwise(1.0) * F.when(F.col("ratio") < target_ratio, 0.8).otherwise(1.0)
    return per.select(parts[0].cast("double").alias("range_factor"), parts[1].cast("double").alias("percentile"), "mean_cosine", "ratio", score.alias("score")).orderBy(F.desc("score"), "range_factor", "percentile")


def auto_select(df: DataFrame, target_cosine: float = 0.97, target_ratio: float = 8.0, family: str | None = None) -> DataFrame:
    """``(mode, mean_cosine, ratio, kurtosis, tried)``: the first codec of a cascade that meets both targets.

    Heavy tails (mean excess kurtosis above 1.5) put the mixed codec first.  If none
    meets both, the best cosine among those that meet the ratio counts, else the best.
    A known model family decides without trying others.
    """
    dims = dimension(df)
    known = {f: m for _, f, m in FAMILIES}.get(family or "")
    kurtosis = quality.dimension_moments(df).agg(F.avg("kurtosis")).first()[0] if known is None else 0.0

    def simple(name: str):
        codec = codecs.CODECS[name]
        return df.select("vec", codec.decode(codec.encode(F.col("vec"))).alias("decoded")), codec.ratio(dims)

    def mixed():
        top = [r["dim"] for r in quality.outlier_dimensions(df, min(16, dims)).collect()]
        return training.mapped(df, lambda x: training.nf4_mixed(x, top)), 4 * dims / (-(-(dims - len(top)) // 2) + 4 + 2 * len(top))

    def pq(size: int):
        parts = max(p for p in range(1, min(size, dims) + 1) if dims % p == 0)
        book = training.pq_train(df, parts, 256, 4)
        return training.mapped(df, lambda x: training.pq_restore(training.pq_assign(x, book), book)), 4 * dims / parts

    tries = {"nf4": lambda: simple("nf4"), "nf4_mixed": mixed, "pq_96": lambda: pq(96), "pq_48": lambda: pq(48), "binary": lambda: simple("binary"), "int8": lambda: simple("int8")}
    order = [known] if known else (["nf4_mixed", "nf4"] if kurtosis > 1.5 else ["nf4", "nf4_mixed"]) + ["pq_96", "pq_48", "binary", "int8"]
    tried: list[tuple[str, float, float]] = []
    for name in order:
        rows, ratio = tries[name]()
        cosine = quality.mean_cosine(rows).first()[0]
        tried.append((name, cosine, float(ratio)))
        if known or (cosine >= target_cosine and ratio >= target_ratio):
            best = tried[-1]
            break
    else:
        enough = [t for t in tried if t[2] >= target_ratio] or tried
        best = reduce(lambda a, b: b if b[1] > a[1] else a, enough)
    return df.sparkSession.createDataFrame([(best[0], best[1], best[2], float(kurtosis), [t[0] for t in tried])], "mode string, mean_cosine double, ratio double, kurtosis double, tried array<string>")


def format_by_targets(cosine: Column, ratio: Column) -> Column:
    """Codec for a row's targets, without looking at vectors (fixed bounds)."""
    return F.when(cosine >= 0.9999, "int8").when((cosine >= 0.98) & (ratio <= 8), "nf4").when(ratio <= 16, "pq").otherwise("rq")


def families(configs: DataFrame) -> DataFrame:
    """``configs`` (architectures array) with ``family`` and ``method``; no match is generic and auto."""
    arch = F.coalesce("architectures", F.array().cast("array<string>"))
    family, method = F.lit("generic"), F.lit("auto")
    for names, f, m in reversed(FAMILIES):
        hit = F.arrays_overlap(arch, F.array(*[F.lit(n) for n in names]))
        family, method = F.when(hit, f).otherwise(family), F.when(hit, m).otherwise(method)
    return configs.withColumn("family", family).withColumn("method", method)


def lora(rows: DataFrame, codec: str = "nf4") -> DataFrame:
    """``(module, matrix, rows, dims, mean_cosine, ratio)`` of adapter matrices given as rows ``(module, matrix, row_id, vec)``."""
    c = codecs.CODECS[codec]
    sized = rows.select("module", "matrix", "vec", F.size("vec").alias("d"))
    if codec in arrow.ENCODERS and dict(rows.dtypes)["vec"] == "array<float>":
        each = arrow.roundtrip_cosine(sized, codec)
    else:
        each = sized.withColumn("cosine", V.cosine(F.col("vec"), c.decode(c.encode(F.col("vec")))))
    whole = each.groupBy("module", "matrix").agg(F.count(F.lit(1)).alias("rows"), F.max("d").alias("dims"), F.avg("cosine").alias("mean_cosine"))
    per_number = c.bytes(1024) / 1024
    return whole.withColumn("ratio", F.lit(4 / per_number))


def embed_tokens(df: DataFrame, dims: int = 128, stop: tuple[str, ...] = ()) -> DataFrame:
    """``(id, vec)`` of ``(id, text)``: the sum of one random direction per token, to unit length.

    A token's direction comes from hashes of the token and the dimension, so it is the
    same everywhere and needs no table.  A task reads each text once.  Null texts and texts without tokens
    give zeros.
    """
    skip, blocks = frozenset(stop), -(-dims // 64)
    numbers = [i.to_bytes(8, "little") for i in range(blocks)]
    schema = T.StructType([df.schema["id"], T.StructField("vec", T.ArrayType(T.FloatType()))])

    def directions(words: list[str]) -> np.ndarray:
        """Signs (words, dims) from the bits of hashes, those of Spark's ``xxhash64(word, block)``."""
        first = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        digests = np.array([[xxhash.xxh64_intdigest(i, f) for i in numbers] for f in first], "<u8").reshape(len(words), blocks)
        return 1 - 2 * np.unpackbits(digests.view(np.uint8), axis=1, bitorder="little")[:, :dims].astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        known = np.zeros((0, dims), np.int8)  # directions of words, by place
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            out = np.zeros((batch.num_rows, dims), np.float32)
            counts = [[(w, n) for w, n in word_counts(text).items() if w not in skip] for text in batch.column(1).to_pylist()]
            if len(place) > KNOWN_WORDS:
                place, known = {}, known[:0]
            new = list(dict.fromkeys(w for found in counts for w, _ in found if w not in place))
            place.update(zip(new, range(len(place), len(place) + len(new))))
            if len(place) > len(known):  # room for twice the words, so that few are copied
                known = np.concatenate([known, np.zeros((max(len(place), 2 * len(known)) - len(known), dims), np.int8)])
            known[len(place) - len(new) : len(place)] = directions(new)
            for row, found in zip(out, counts):
                for at in range(0, len(found), WORDS):
                    some = found[at : at + WORDS]
                    row += np.array([n for _, n in some], np.float32) @ known[[place[w] for w, _ in some]].astype(np.float32)
            length = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            unit = np.divide(out, length, out=np.zeros_like(out, np.float64), where=length > 0).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dims, np.int32), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "vec"])

    return df.select("id", "text").mapInArrow(run, schema)


def residual_cosine(df: DataFrame, model: training.ResidualCodebook) -> DataFrame:
    return quality.mean_cosine(training.mapped(df, lambda x: model.decode(model.encode(np.asarray(x)))))
