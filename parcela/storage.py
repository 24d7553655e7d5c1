"""Tables written to the folder that all executors share.

Lineage is cut by writing a table and reading it back: unlike a block kept by one executor it
survives the loss of any of them, and unlike ``checkpoint()`` it is computed only once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
#: The tables of each ``scratch`` that is open.
_OWNED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if not _LOCAL_DIR:
        folder = tempfile.TemporaryDirectory(prefix="parcela-")
        atexit.register(folder.cleanup)
        _LOCAL_DIR.append(folder.name)
    return "file://" + _LOCAL_DIR[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return it read back.

    The table belongs to the application and is removed when it ends, or at the end of ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _OWNED:
        _OWNED[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that were materialized inside of it."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class TooLarge(ValueError):
    """A table that was to be held in memory exceeds its documented bound."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a reference table that must stay small; more than ``limit`` rows is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what}: more than {limit} rows")
    return rows
