"""Differences between consecutive full snapshots (problem 2).

The snapshots are laid out once, range-partitioned by key and sorted by key and run. Each range is
then one stream in which two pointers, one on each of two consecutive snapshots, advance together:
where both stand on the same key the columns are compared, where only one does the key was added
or removed. Only the last row of a batch is carried into the next, so memory doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.listing import aviso, instant, local_day
from parcela.operators.units import canonical, money_udf, with_rates
from parcela.storage import bounded_rows

#: Most runs of a table of runs; beside each row only its run's number is kept.
RUNS = 10_000


def latest_per_snapshot(rows: DataFrame, key: str, run: str, order: list[Column], values: list[str]) -> DataFrame:
    """One row for each key and run: the values of its last row in ``order``.

    An aggregate with map-side combining: a key that holds a third of all rows is reduced to one
    row per run in each task before the shuffle.
    """
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return rows.groupBy(key, run).agg(last).select(key, run, *[F.col("last")[v].alias(v) for v in values])


def merge_stream(first: int, final: int, tolerance: float):
    """The function for ``mapInPandas`` over rows (key, run, value) sorted by key and run.

    Runs are numbered ``first`` to ``final`` without gaps. Yields (key, run, change): 'added' in a
    run but not in the one before, 'removed' the reverse, 'changed' where both values are above zero
    and differ by more than ``tolerance`` of the earlier. Nothing is told of the first run.
    """

    def told(keys, runs, what) -> pd.DataFrame:
        return pd.DataFrame({"key": keys, "run": runs.astype("int32"), "cambio": np.full(len(keys), what, dtype=object)})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in batches:
            if not len(batch):
                continue
            new = np.ones(len(batch) + (carry is not None), dtype=bool)
            if carry is not None:
                batch, new[0] = pd.concat([carry, batch], ignore_index=True), False
            key, run = batch["key"].to_numpy(), batch["run"].to_numpy()
            value = batch["value"].to_numpy(dtype=float, na_value=np.nan)
            # row i is the right pointer, row i - 1 the left one: they meet if key and run fit
            meet = np.zeros(len(key), dtype=bool)
            meet[1:] = (key[1:] == key[:-1]) & (run[1:] == run[:-1] + 1)
            added = new & ~meet & (run > first)  # the carried row was a right pointer in its own batch
            yield told(key[added], run[added], "added")
            removed = np.zeros(len(key), dtype=bool)
            removed[:-1] = ~meet[1:] & (run[:-1] < final)  # the last row is a left pointer in the next batch
            yield told(key[removed], run[removed] + 1, "removed")
            with np.errstate(invalid="ignore"):
                before, after = value[:-1], value[1:]
                differs = (before > 0) & (after > 0) & (np.abs(after - before) > tolerance * before)
            changed = meet[1:] & differs
            yield told(key[1:][changed], run[1:][changed], "changed")
            carry = batch.iloc[-1:]
        if carry is not None:
            key, run = carry["key"].to_numpy(), carry["run"].to_numpy()
            yield told(key[run < final], run[run < final] + 1, "removed")

    return merge


def laid_out(snapshots: DataFrame) -> DataFrame:
    """Snapshots range-partitioned by ``key`` and sorted by ``key`` and ``run``."""
    return snapshots.repartitionByRange("key").sortWithinPartitions("key", "run")


def snapshot_changes(snapshots: DataFrame, key: str, run: str, value: str, first: int, final: int, tolerance: float) -> DataFrame:
    """(key, run, cambio) of consecutive snapshots; ``snapshots`` has one row for each key and run."""
    laid = laid_out(snapshots.select(F.col(key).alias("key"), F.col(run).cast("int").alias("run"), F.col(value).cast("double").alias("value")))
    kind = dict(snapshots.dtypes)[key]
    return laid.mapInPandas(merge_stream(first, final, tolerance), f"key {kind}, run int, cambio string")


def with_run(rows: DataFrame, at: str, runs: list[tuple[int, int]]) -> DataFrame:
    """The rows inside of a run, with its number ``run`` (from 1): ``runs`` has the first and last
    instant of each, in order and without overlap. A binary search in sorted bounds, not a join."""
    bounds = [float("-inf")]
    for first, last in runs:
        if last < first or first <= bounds[-1] - 1:
            raise ValueError("runs must not overlap")
        bounds += [first, last + 1]
    if not runs:
        return rows.withColumn("run", F.lit(None).cast("int")).filter(F.lit(False))
    search = Bucketizer(splits=[*map(float, bounds), float("inf")], inputCol="_at", outputCol="_place", handleInvalid="keep")
    placed = search.transform(rows.withColumn("_at", F.col(at).cast("double")))
    # places: before the first run, in it, between it and the second, in that, ...
    return placed.filter(F.col("_place") % 2 == 1).withColumn("run", ((F.col("_place") + 1) / 2).cast("int")).drop("_at", "_place")


def _micros(moment: datetime) -> int:
    return (moment.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def listing_changes(listings: DataFrame, runs: DataFrame, rates: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``aviso``, ``corrida_id``, ``cambio`` of the listings of consecutive runs.

    Rows without aviso or readable time, and rows outside of all runs, don't count. Of several rows
    in a run the one with the latest time gives the price, of equal times the one with the largest
    ``row_id``. A missing, zero or unreadable price, or one of a day without rate, makes no
    'changed'. No rows or no runs give no changes.
    """
    bounds = runs.select("corrida_id", "inicio", "fin").filter("inicio is not null and fin is not null")
    windows = sorted(bounded_rows(bounds, RUNS, "runs"), key=lambda r: (r.inicio, r.corrida_id))
    rows = listings.select("row_id", aviso(F.col("url_propiedad")).alias("aviso"), instant(F.col("execution_time")).alias("at"), "precio_uf")
    rows = with_run(rows.filter("aviso is not null and at is not null"), "at", [(_micros(r.inicio), _micros(r.fin)) for r in windows])
    last = latest_per_snapshot(rows, "aviso", "run", [F.col("at"), F.col("row_id")], ["at", "precio_uf"])
    rated = with_rates(last.withColumn("fecha", local_day(F.col("at"))), rates).select(F.col("aviso").alias("key"), "run", "precio_uf", "uf_clp", "usd_clp")
    # prices are parsed above the layout, whose sampling would parse them once more
    priced = laid_out(rated).select("key", "run", canonical(money_udf("precio")(F.col("precio_uf")), "UF", F.col("uf_clp"), F.col("usd_clp")).alias("value"))
    changes = priced.mapInPandas(merge_stream(1, len(windows), tolerance), "key long, run int, cambio string")
    ids = F.array(*[F.lit(r.corrida_id) for r in windows]) if windows else F.array(F.lit(None).cast("int"))
    return changes.select(F.col("key").alias("aviso"), F.element_at(ids, F.col("run")).cast("int").alias("corrida_id"), "cambio")
