"""Named collections of points, kept as parquet: creation, append, lookup, count, removal."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from parcela.operators.predicate import predicate

#: The folder of each batch.
_BATCH = "_lote"


class Collection:
    """A collection under ``root``/``name``: ``meta`` tells dimension and distance, ``points`` holds the rows."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path))

    def create(self, dimension: int, distance: str = "cosine") -> Collection:
        """Idempotent; an existing collection of another dimension is an error."""
        if self.exists():
            found = self.meta().dimension
            if found != dimension:
                raise ValueError(f"{self.name} has dimension {found}, not {dimension}")
            return self
        self.spark.createDataFrame([(self.name, dimension, distance)], "name string, dimension int, distance string").coalesce(1).write.parquet(f"{self.path}/meta")
        return self

    def drop(self) -> bool:
        """True even if there is none."""
        fs, path = self._fs()
        return not fs.exists(path) or bool(fs.delete(path, True))

    def recreate(self, dimension: int, distance: str = "cosine") -> Collection:
        self.drop()
        return self.create(dimension, distance)

    def append(self, points: DataFrame, vector: str = "vector", id_column: str | None = None, batch: str | None = None) -> int:
        """Add points and tell how many; ids are fresh unless ``id_column`` names one.

        A named ``batch`` replaces what was added under its name, so that a batch repeated after a
        failure is there once; without a name, a repeated load repeats points. Only the new points
        are counted, while they are written. No points add an empty batch.
        """
        dimension = self.meta().dimension
        checked = points.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors must have dimension {dimension}"))))
        with_id = checked.withColumn("id", F.col(id_column).cast("string") if id_column else F.expr("uuid()"))
        counted = Observation()
        name = re.sub(r"[^\w.-]", "_", batch) if batch is not None else uuid.uuid4().hex
        with_id.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/points/{_BATCH}={name}")
        return counted.get["n"]

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points").drop(_BATCH)

    def meta(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/meta").first()

    def count(self) -> int:
        fs, _ = self._fs()
        return self.points().count() if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/points")) else 0

    def info(self) -> dict:
        row = self.meta()
        return {"name": row.name, "dimension": row.dimension, "distance": row.distance, "points_count": self.count()}


def lookup(points: DataFrame, filters: Mapping, limit: int = 10, id_column: str = "id", vector: str | None = None) -> DataFrame:
    """The first ``limit`` points by id that pass all filters; without ``vector`` it isn't read."""
    found = points.filter(predicate(filters))
    if vector:
        found = found.drop(vector)
    return found.orderBy(id_column).limit(limit)
