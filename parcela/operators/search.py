"""Filtered exact nearest neighbours by cosine, for one query or for a block of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcela.operators.predicate import predicate

#: Bytes of vectors in a block of queries or of rows.
BLOCK_BYTES = 32 << 20
#: Scores that are held at a time.
TILE_CELLS = 1 << 21


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """The cosine with a constant vector; 0 where either has no length. Null vectors give null."""
    q = [float(x) for x in query]
    norm = float(np.sqrt(np.dot(q, q)))
    if norm == 0.0:
        return F.when(vector.isNotNull(), F.lit(0.0))
    literal = F.array(*[F.lit(x / norm) for x in q])
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(own == 0, F.lit(0.0)).otherwise(dot / own)


def knn(collection: DataFrame, query: Sequence[float], k: int = 10, filters: Mapping | None = None, threshold: float | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest cosine among those that pass ``filters`` and reach ``threshold``
    (None or 0: none), with ``score``; equal scores by id. Filters reach the scan, and only the
    best ``k`` of each partition are kept."""
    scored = collection.filter(predicate(filters)).withColumn("score", cosine(F.col(vector), query)).filter(F.col("score").isNotNull())
    if threshold:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_of(queries: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and names of the ``k`` best rows of each query, equal scores by name, in tiles of ``TILE_CELLS``
    scores. Rows come in the names' order. Fewer rows than ``k`` give fewer columns."""
    width = max(1, min(len(rows), max(k, TILE_CELLS // 64)))
    tall = max(1, TILE_CELLS // width)
    scores, places = [], []
    for a in range(0, len(queries), tall):
        part = queries[a : a + tall]
        score, place = np.empty((len(part), 0)), np.empty((len(part), 0), dtype=np.int64)
        for b in range(0, len(rows), width):
            new = np.round(part @ rows[b : b + width].T, 12)
            at = np.broadcast_to(np.arange(b, b + new.shape[1]), new.shape)
            if new.shape[1] > k:
                # all that reach the k-th best score stay candidates, so that ties go by name
                least = np.partition(new, new.shape[1] - k, axis=1)[:, -k]
                if (np.count_nonzero(new >= least[:, None], axis=1) == k).all():
                    pick = np.argpartition(new, new.shape[1] - k, axis=1)[:, -k:]
                else:
                    pick = np.argsort(-new, axis=1, kind="stable")[:, :k]
                new, at = np.take_along_axis(new, pick, axis=1), np.take_along_axis(at, pick, axis=1)
            score, place = np.concatenate([score, new], axis=1), np.concatenate([place, at], axis=1)
            order = np.lexsort((place, -score), axis=1)[:, :k]
            score, place = np.take_along_axis(score, order, axis=1), np.take_along_axis(place, order, axis=1)
        scores.append(score)
        places.append(place)
    return np.concatenate(scores), names[np.concatenate(places)]


def knn_batch(collection: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """``query_id``, id, ``score``, ``rank`` of the ``k`` nearest rows of each query (``query_id``, ``vector``).

    Queries and rows are tables of any size, cut into blocks of about ``BLOCK_BYTES`` by hash; each
    pair of a block of queries and one of rows is a task, which multiplies them in small tiles and
    gives the best ``k`` of each query. Of these the window keeps the best in each task before the
    last shuffle. Queries of a single block go to the tasks whole, so that no row is shuffled.
    Null vectors are left out; a zero vector has cosine 0 with every row.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter("v is not null")
    kinds = dict(queries.dtypes)[query_id], dict(collection.dtypes)[id_column]
    schema = f"{query_id} {kinds[0]}, {id_column} {kinds[1]}, score double"
    rows = collection.select(F.col(id_column).alias("i"), F.col(vector).alias("w")).filter("w is not null")

    def scored(ids: np.ndarray, block: np.ndarray, mine: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(mine["i"].to_numpy(), kind="stable")
        score, name = best_of(block, _matrix(mine["w"])[order], mine["i"].to_numpy()[order], k)
        return pd.DataFrame({query_id: np.repeat(ids, score.shape[1]), id_column: name.ravel(), "score": score.ravel()})

    sized = lambda df, c: df.agg(F.count("*").alias("n"), F.max(F.size(c)).alias("d")).first()
    size = sized(asked, "v")
    if not size.n:
        return collection.sparkSession.createDataFrame([], schema + ", rank int")
    if size.n * size.d * 8 <= BLOCK_BYTES:
        own = asked.toPandas()  # one block
        ids, block = own["q"].to_numpy(), _matrix(own["v"])
        found = rows.mapInPandas(lambda batches: (scored(ids, block, b) for b in batches if len(b)), schema)
    else:
        cut = lambda s: max(1, -(-s.n * s.d * 8 // BLOCK_BYTES))
        many, blocks = cut(sized(rows, "w")), cut(size)
        share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("q", "v", share("q", blocks).alias("a"), every(many).alias("b"))
        right = rows.select("i", "w", every(blocks).alias("a"), share("i", many).alias("b"))

        def pair(key: tuple, some: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(mine):
                return pd.DataFrame({query_id: some["q"][:0], id_column: mine["i"][:0], "score": np.empty(0)})
            return scored(some["q"].to_numpy(), _matrix(some["v"]), mine)

        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(pair, schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), id_column)))
    return ranked.filter(F.col("rank") <= k)
