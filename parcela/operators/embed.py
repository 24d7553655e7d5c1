"""Texts to vectors by a pluggable embedder; the default needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from parcela.functions.text import collapsed, preprocess_text

#: A function from texts to a matrix with one row for each.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Words are hashed to signed buckets and the row is scaled to length 1; a blank text is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[(h >> 1) % dimension] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


@dataclass(frozen=True)
class Model:
    """What is told of an embedder: its maker is called where it is used."""

    name: str
    make: Callable[[], Embedder]
    max_length: int | None = None  # characters; None: any

    def info(self) -> dict:
        """Name, dimension (of what it really gives), longest text."""
        return {"model_name": self.name, "dimension": dimension_of(self.make), "max_length": self.max_length}


def dimension_of(make: Callable[[], Embedder]) -> int:
    """The dimension that an embedder really gives, whatever was configured."""
    return int(np.asarray(make()(["x"])).shape[1])


#: The models that can be named; a caller may add its own.
MODELS: dict[str, Model] = {f"hash-{n}": Model(f"hash-{n}", partial(hashing_embedder, n), 2000) for n in (64, 256, 1024)}


def models(spark: SparkSession) -> DataFrame:
    """``model_name``, ``dimension``, ``max_length`` of every model."""
    return spark.createDataFrame([tuple(m.info().values()) for m in MODELS.values()], "model_name string, dimension int, max_length int")


def embedding_udf(make: Callable[[], Embedder] = hashing_embedder, dimension: int | None = 64, batch: int = 1024):
    """The vectorised embedder. ``make`` is called once in each worker, as loading a model is costly. The
    vectors must have ``dimension``; None takes what the embedder gives. Null and blank give zeros."""
    want = dimension_of(make) if dimension is None else dimension

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            rows: list = []
            for a in range(0, len(texts), batch):
                part = [t or "" for t in texts.iloc[a : a + batch]]
                m = np.asarray(model(part), dtype=np.float32)
                if m.shape != (len(part), want):
                    raise ValueError(f"embedder gave {m.shape}, not {(len(part), want)}")
                m[[not t.strip() for t in part]] = 0
                rows.extend(m)
            yield pd.Series(rows, dtype=object)

    return run


def embed(text: Column, make: Callable[[], Embedder] = hashing_embedder, dimension: int | None = 64, batch: int = 1024, size: int | None = 2000) -> Column:
    """The vector of each text, cleaned and cut at ``size`` characters first, as the source system does; None: whole texts."""
    return embedding_udf(make, dimension, batch)(preprocess_text(text, size) if size is not None else collapsed(F.coalesce(text, F.lit(""))))
