"""Readers and writers of vectors in files.

Everything is read and written by Spark's own sources, so any store that Spark can
reach will do; formats that Spark doesn't know come in through ``binaryFile``.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of stored codes: id, codes, scales, dims, codec.
CODES = "id string, quantized binary, scales binary, vector_dim int, precision_mode string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec)`` of lines ``{"id": ..., "vector": [...]}`` or, failing that, ``id,x,x,...``.

    Blank lines, lines that are neither, and numbers that aren't any are left out.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    j = F.from_json("line", "id STRING, vector ARRAY<FLOAT>")
    fields = F.split("line", ",")
    numbers = F.transform(F.slice(fields, 2, F.size(fields)), lambda x: F.trim(x).try_cast("float"))
    as_csv = F.when((F.size(fields) > 1) & F.forall(numbers, lambda x: x.isNotNull()), F.struct(F.trim(fields[0]).alias("id"), numbers.alias("vec")))
    parsed = lines.select(F.when(j["id"].isNotNull() & j["vector"].isNotNull(), F.struct(j["id"].alias("id"), j["vector"].alias("vec"))).otherwise(as_csv).alias("r"))
    return parsed.where("r is not null").select("r.*")


def read_corpus(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", vector_field: str = "vector") -> DataFrame:
    """``(id, text, vec)`` of a JSON-lines corpus; the vector may be missing."""
    schema = f"`{id_field}` STRING, `{text_field}` STRING, `{vector_field}` ARRAY<FLOAT>"
    return spark.read.schema(schema).json(path).select(F.col(id_field).alias("id"), F.col(text_field).alias("text"), F.col(vector_field).alias("vec"))


def read_model_configs(spark: SparkSession, path: str) -> DataFrame:
    """``(path, architectures, model_type)`` of config.json files."""
    return spark.read.schema("architectures ARRAY<STRING>, model_type STRING").option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def write_results_json(found: DataFrame, path: str) -> None:
    """One line per query: ``{"query_id", "results": [{"id", "score"}]}``."""
    results = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score")))
    found.groupBy("query_id").agg(results.alias("results")).write.mode("overwrite").json(path)


def to_stored(coded: DataFrame, codec: str, dims: int) -> DataFrame:
    """``(id, codes tinyint array, scale)`` in the stored schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.array(x, np.int8).tobytes() for x in b.column(1).to_pylist()]
            scales = [np.array([x], "<f4").tobytes() for x in b.column(2).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(scales, pa.binary()), pa.array([dims] * n, pa.int32()), pa.array([codec] * n)], ["id", "quantized", "scales", "vector_dim", "precision_mode"])

    return coded.select(F.col("id").cast("string"), "codes", "scale").mapInArrow(run, CODES)


def from_stored(stored: DataFrame) -> DataFrame:
    """Inverse of ``to_stored``: (id, codes, scale, dims, codec)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(x, np.int8).tolist() for x in b.column(1).to_pylist()]
            scales = [float(np.frombuffer(x, "<f4")[0]) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int8())), pa.array(scales, pa.float32()), b.column(3), b.column(4)], ["id", "codes", "scale", "dims", "codec"])

    return stored.select("id", "quantized", "scales", "vector_dim", "precision_mode").mapInArrow(run, "id string, codes array<tinyint>, scale float, dims int, codec string")


def to_ipc(df: DataFrame) -> bytes:
    """A small table as Arrow stream bytes; it must fit the driver."""
    table = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


# Container files: 64-byte header, metadata, body of int8 codes and then float32 scales -----

_HEADER = struct.Struct("<8sHHQIHI8s26x")


def container_bytes(codes: np.ndarray, scales: np.ndarray, magic: bytes, metadata: bytes = b"", compression: str = "zstd", parts: int = 0) -> bytes:
    """A container file; ``magic`` is the eight bytes that its readers expect."""
    body = np.ascontiguousarray(codes, np.int8).tobytes() + np.ascontiguousarray(scales, "<f4").tobytes()
    flag = {"none": 0, "zstd": 1, "zlib": 2}[compression]
    if flag == 1:
        import zstandard

        body = zstandard.ZstdCompressor(level=3).compress(body)
    elif flag == 2:
        body = zlib.compress(body)
    head = _HEADER.pack(magic, 1, flag, len(codes), codes.shape[1], parts, len(metadata), hashlib.blake2b(body, digest_size=8).digest())
    return head + metadata + body


def parse_container(raw: bytes, magic: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(codes, scales, metadata); wrong magic or checksum is an error."""
    found, _, flag, n, dims, _, meta, checksum = _HEADER.unpack(raw[:64])
    if found != magic:
        raise ValueError("not a container of this kind")
    body = raw[64 + meta :]
    if hashlib.blake2b(body, digest_size=8).digest() != checksum:
        raise ValueError("checksum doesn't match")
    if flag == 1:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=n * (dims + 4))
    elif flag == 2:
        body = zlib.decompress(body)
    return np.frombuffer(body, np.int8, n * dims).reshape(n, dims), np.frombuffer(body, "<f4", n, n * dims), raw[64 : 64 + meta]


def read_containers(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """``(path, row, codes, scale)`` of all container files under a path, a task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                codes, scales, _ = parse_container(raw, magic)
                for at in range(0, len(codes), 8192):
                    cut = slice(at, at + 8192)
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(codes[cut])), "codes": list(codes[cut]), "scale": scales[cut]})

    return files.mapInPandas(run, "path string, row long, codes array<tinyint>, scale float")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, codes, scale)`` of NPZ artefacts with arrays ``quantized`` and ``scales``; newer versions than 2 are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    version = int(z["storage_format_version"]) if "storage_format_version" in z.files else 1
                    if version > 2:
                        raise ValueError(f"{name} has format version {version}")
                    codes = z["quantized"].reshape(-1, int(z["vector_dim"]) if "vector_dim" in z.files else z["quantized"].shape[-1]).astype(np.int8)
                    yield pd.DataFrame({"path": name, "row": np.arange(len(codes)), "codes": list(codes), "scale": z["scales"].reshape(len(codes), -1)[:, 0].astype(np.float32)})

    return files.mapInPandas(run, "path string, row long, codes array<tinyint>, scale float")


def upgrade(spark: SparkSession, source: str, target: str, dry_run: bool = False) -> DataFrame:
    """One row: files and rows of NPZ artefacts that would be, or have been, rewritten as stored codes."""
    rows = read_npz(spark, source)
    summary = rows.agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("rows"))
    if not dry_run:
        names = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("#"), F.col("row").cast("string"))
        rows.select(names.alias("id"), "codes", "scale", F.size("codes").alias("dims"), F.lit("int8").alias("codec")).write.mode("overwrite").parquet(target)
    return summary


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, rows)`` of a stored table, from file metadata."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def validate(stored: DataFrame) -> DataFrame:
    """One row: rows, null ids, repeated ids, rows whose code length isn't the dimension, dimensions seen, and whether all is well."""
    long = stored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("null_ids"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.size("codes") != F.col("dims")).alias("wrong_length"), F.count_distinct("dims").alias("dimensions"),
    )
    return long.withColumn("valid", (F.col("null_ids") == 0) & (F.col("repeated_ids") == 0) & (F.col("wrong_length") == 0) & (F.col("dimensions") <= 1))


def toy(spark: SparkSession) -> DataFrame:
    """Three vectors to search when there is no data set (fixed values)."""
    return spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0]), ("three", [0.707, 0.707])], "id string, vec array<float>")


def gaussian(spark: SparkSession, rows: int, dims: int, seed: int = 42, centre: list[float] | None = None, noise: float = 1.0) -> DataFrame:
    """``(id, vec)``: unit vectors of normal numbers, or of a centre with noise; a row's numbers depend on its id alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.random.default_rng((seed, i)).standard_normal(dims) for i in b["id"]]) if len(b) else np.zeros((0, dims))
            x = x if centre is None else np.asarray(centre) + noise * x
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "vec": list(x.astype(np.float32))})

    return spark.range(rows).mapInPandas(run, "id long, vec array<float>")
