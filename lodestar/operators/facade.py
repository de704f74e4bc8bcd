"""One call for every codec, trained ones too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import coded, codecs, quality, search, training
from lodestar.session import dimension


@dataclass
class Compressor:
    """``profile``: a codec's name, ``nf4-mixed``, ``pq-N`` (N parts), ``opq-N``, ``rq-N`` (three passes) or ``autoencoder-N``.

    Trained profiles are fitted on the first table, or by ``fit``.
    """

    profile: str = "int8"
    k: int = 256
    seed: int = 0
    model: object = None
    dims: int = 0

    def _size(self) -> int:
        return int(self.profile.rpartition("-")[2])

    def fit(self, df: DataFrame) -> Compressor:
        self.dims = dimension(df)
        kind = self.profile.split("-")[0]
        if self.profile == "nf4-mixed":
            self.model = [r["dim"] for r in quality.outlier_dimensions(df, min(16, self.dims)).collect()]
        elif kind == "pq":
            self.model = (None, training.pq_train(df, self._size(), self.k, 8, self.seed))
        elif kind == "opq":
            self.model = training.opq_train(df, self._size(), self.k, 4, self.seed)
        elif kind == "rq":
            self.model = training.rq_train(df, 3, self._size(), self.k, 6, self.seed)
        elif kind == "autoencoder":
            self.model = training.autoencoder_train(df, self._size(), seed=self.seed)
        elif self.profile not in codecs.CODECS:
            raise ValueError(f"unknown profile {self.profile!r}")
        else:
            self.model = codecs.CODECS[self.profile]
        return self

    def roundtrip(self, df: DataFrame) -> DataFrame:
        """``df`` with ``decoded``: every vector as it comes back."""
        if self.model is None:
            self.fit(df)
        if isinstance(self.model, codecs.Codec):
            return df.withColumn("decoded", self.model.decode(self.model.encode(F.col("vec"))))
        return coded.decode(coded.encode(df, self.codec()), self.codec()).drop("code")

    def codec(self) -> coded.TrainedCodec:
        """The trained model as a codec with codes of its own."""
        kind = self.profile.split("-")[0]
        if self.profile == "nf4-mixed":
            return coded.mixed(self.dims, self.model)
        if kind in ("pq", "opq"):
            return coded.rotated(*self.model)
        return coded.residual(self.model) if kind == "rq" else coded.autoencoder(self.model)

    def compress(self, df: DataFrame) -> DataFrame:
        """``df`` with ``code`` instead of ``vec``; what PQ gives is an array of parts' codes, other trained profiles a struct (``coded.CODE``)."""
        if self.model is None:
            self.fit(df)
        if isinstance(self.model, codecs.Codec):
            return df.withColumn("code", self.model.encode(F.col("vec"))).drop("vec")
        if self.profile.startswith("pq-"):
            return search.pq_encode(df, self.model[1], "code").drop("vec")
        return coded.encode(df, self.codec()).drop("vec")

    def decompress(self, stored: DataFrame) -> DataFrame:
        if isinstance(self.model, codecs.Codec):
            return stored.withColumn("vec", self.model.decode(F.col("code"))).drop("code")
        if self.profile.startswith("pq-"):
            return stored.withColumn("vec", search.pq_decode(F.col("code"), self.model[1])).drop("code")
        return coded.decode(stored, self.codec(), out="vec").drop("code")

    def search(self, queries: DataFrame, stored: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        """``(query_id, id, score, rank)`` over what ``compress`` gave; trained profiles are searched by their codes."""
        if isinstance(self.model, codecs.Codec) or self.profile.startswith("pq-"):
            return search.knn(queries, self.decompress(stored).select("id", "vec"), k, metric)
        return coded.topk(queries, stored, self.codec(), k, metric)

    def ratio(self) -> float:
        """Compression against 4 bytes a number, without the model."""
        d, kind = self.dims, self.profile.split("-")[0]
        if isinstance(self.model, codecs.Codec):
            return self.model.ratio(d)
        if self.profile == "nf4-mixed":
            top = len(self.model)
            return 4 * d / (-(-(d - top) // 2) + 4 + 2 * top)
        return 4 * d / (self._size() * (3 if kind == "rq" else 1))
