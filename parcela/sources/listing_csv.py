"""The scraped CSV files: one physical line is one record, wrapped and over-long records repaired."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcela.operators.quarantine import COLUMNS

#: Place of the image list, after which a record may have come apart.
IMAGES = 26


def parse_line(line: str, names: tuple[str, ...] = COLUMNS) -> list[str] | None:
    """The fields of a line; null for an empty one.

    One pair of outer quotes is taken off as it is, without undoing doubled quotes. Short records
    are filled up. Of long ones the parts from the image list on belong to it up to the part that
    begins with a bracket or single quote, with which the description begins; if that is the first
    of them, or if there is none, all belong to the images.
    """
    s = line.rstrip("\n\r")
    if not s:
        return None
    if s[0] == s[-1] == '"':
        s = s[1:-1]
    parts = next(csv.reader([s]), [])
    width = len(names)
    if len(parts) <= width or width <= IMAGES + 1:
        return (parts + [""] * width)[:width]
    rest = parts[IMAGES:]
    cut = next((k for k, p in enumerate(rest) if p.strip()[:1] in ("'", "[")), len(rest))
    head = parts[:IMAGES]
    return [*head, ",".join(rest[:cut] if cut else rest), ",".join(rest[cut:]) if cut else ""]


def parsed(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = (), names: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The records of a column of lines, with the columns ``keep`` of their rows; empty and null lines give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fields = [parse_line(t, names) if t is not None else None for t in b[line]]
            good = [f is not None for f in fields]
            out = pd.DataFrame([f for f in fields if f is not None], columns=list(names))
            yield pd.concat([b.loc[good, list(keep)].reset_index(drop=True), out], axis=1)

    kinds = dict(lines.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f"{c} string" for c in names)])
    return lines.select(line, *keep).mapInPandas(run, schema)


def read(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    """The records of the files at ``path`` without their header lines, with file and number.

    ``nro_linea`` counts the lines that aren't empty, the header being the first. ``skip_rows`` leaves
    out that many first records of each file. Each split numbers its own lines as they stream by, and
    the counts of the splits before it, one row each, are added; no line is shuffled.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.filter(F.regexp_replace("value", "[\r\n]+$", "") != "")
    before = W.partitionBy("archivo").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = raw.groupBy("archivo", "_block").count().select("archivo", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}  # a task holds few splits
        for b in batches:
            split = pd.MultiIndex.from_frame(b[["archivo", "_block"]])
            own = b.groupby(split).cumcount() + 1
            yield b.assign(_own=own + [seen.get(s, 0) for s in split])
            for s, n in split.value_counts().items():
                seen[s] = seen.get(s, 0) + int(n)

    own = raw.mapInPandas(number, "value string, archivo string, _block long, _own long")
    numbered = own.join(splits, ["archivo", "_block"]).withColumn("nro_linea", F.col("_own") + F.col("_before"))
    return parsed(numbered.filter(F.col("nro_linea") > 1 + skip_rows), keep=("archivo", "nro_linea"))


def lenient(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = (), names: tuple[str, ...] = COLUMNS, **options: str) -> DataFrame:
    """The lines as a standard CSV reader reads them (``options`` as of ``spark.read.csv``), for looking
    into files: its columns, and ``_corrupt`` with the line where the record doesn't fit them."""
    schema = ", ".join([*(f"{c} string" for c in names), "_corrupt string"])
    read = F.from_csv(F.col(line), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"} | options)
    return lines.filter(F.col(line).isNotNull()).select(*keep, read.alias("_r")).select(*keep, "_r.*")


def batches(rows: DataFrame, order: str, size: int, skip: int = 0) -> DataFrame:
    """The rows in ``order`` after the first ``skip``, with their ``batch`` number of ``size`` rows.

    Ranks come from range partitions: each is sorted and numbered on its own, and the partitions'
    counts, one number each, are added up; no single task gets all rows.
    """
    from parcela.storage import materialize

    laid = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["count"]) for r in laid.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    start = rows.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    ranked = laid.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(order))).join(F.broadcast(start), "_part")
    at = F.col("_rank") + F.col("_before") - 1 - skip
    return ranked.filter(at >= 0).withColumn("batch", F.floor(at / size).cast("bigint")).drop("_part", "_rank", "_before")
