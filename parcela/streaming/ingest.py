"""Continuous load of listing files: new files become points of a collection, each once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcela.operators.collection import Collection
from parcela.operators.embed import embed
from parcela.operators.payload import points
from parcela.sources.listing_csv import parsed


def load_points(lines: DataFrame, dimension: int = 64) -> DataFrame:
    """Lines to points with vectors: parse, clean, drop rows without content, embed."""
    rows = parsed(lines).withColumn("row_id", F.monotonically_increasing_id())
    made = points(rows).withColumn("vector", embed(F.col("semantic_text"), dimension=dimension))
    return made.drop("row_id")


def stream_into(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, header: str = "EXECUTION_TIME,") -> StreamingQuery:
    """Append the points of all files that are in ``folder`` and haven't been loaded yet, then stop.

    The checkpoint remembers what was read, in place of a number of rows to skip. A batch that is
    repeated after a failure replaces what it had added.
    """
    dimension, source = collection.meta().dimension, hashlib.blake2b(checkpoint.encode(), digest_size=8).hexdigest()
    lines = spark.readStream.text(folder).filter(~F.col("value").startswith(header))

    def write(batch: DataFrame, number: int) -> None:
        collection.append(load_points(batch, dimension), batch=f"{source}-{number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
