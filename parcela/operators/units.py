"""Amounts of mixed units brought to one canonical unit (problem 1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.listing import instant, local_day
from parcela.functions.units import EXPENSE_RANGES, PRICE_RANGES, parse_money
from parcela.storage import TooLarge, bounded_rows

MONEY = "valor double, unidad string, base double, moneda string"
#: Most rows of a table of daily rates that is broadcast (27 years of days).
RATE_ROWS = 10_000

_NONE = (None, None, None, None)


def money_udf(kind: str):
    """A vectorised parser of a price ('precio') or of monthly expenses ('gastos'): text to ``MONEY``.

    Each Arrow batch parses every distinct text once. Null in, nulls out.
    """
    ranges = {"precio": PRICE_RANGES, "gastos": EXPENSE_RANGES}[kind]

    @F.pandas_udf(MONEY)
    def parse(texts: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(texts)
        rows = [_NONE if (m := parse_money(t, ranges)) is None else (m.value, m.code, m.base, m.currency) for t in distinct] + [_NONE]
        table = pd.DataFrame(rows, columns=["valor", "unidad", "base", "moneda"])
        return table.iloc[codes].reset_index(drop=True)  # code -1 (null) is the last row

    return parse


def with_rates(rows: DataFrame, rates: DataFrame, day: str = "fecha") -> DataFrame:
    """``rows`` with ``uf_clp`` and ``usd_clp`` of their day ``day`` (the last by value, if it has several; else null).

    The rates are broadcast where they are within ``RATE_ROWS``, and joined by day beyond.
    """
    days = rates.groupBy("fecha").agg(F.max("uf_clp").alias("uf_clp"), F.max("usd_clp").alias("usd_clp")).withColumnRenamed("fecha", day)
    try:
        found = bounded_rows(days, RATE_ROWS, "daily rates")
    except TooLarge:
        return rows.join(days, day, "left")
    return rows.join(F.broadcast(rates.sparkSession.createDataFrame(found, days.schema)), day, "left")


def with_money(listings: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``listings`` with a struct ``<field>_monto`` for each field; ``fields``: name to kind of amount.

    Tables may be empty and may hold any further columns; those named ``<field>_monto`` are replaced.
    """
    return listings.withColumns({f"{f}_monto": money_udf(kind)(F.col(f)) for f, kind in fields.items()})


def canonical(amount: Column, target: str, uf_clp: Column, usd_clp: Column) -> Column:
    """An amount (``MONEY``) in whole ``target`` (UF or CLP) at the day's rates; null without amount or rate."""
    in_clp = F.when(amount["moneda"] == "CLP", amount["base"]).when(amount["moneda"] == "UF", amount["base"] * uf_clp).when(amount["moneda"] == "USD", amount["base"] * usd_clp)
    zero = F.when(amount["base"] == 0, F.lit(0.0))  # in any unit
    if target == "CLP":
        return F.coalesce(zero, in_clp)
    return F.coalesce(zero, F.when(amount["moneda"] == "UF", amount["base"]), F.try_divide(in_clp, uf_clp))


def canonical_amounts(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """``row_id``, ``precio`` in UF and ``gastos`` in pesos at the local day of each row.

    Null where there is no amount, or where another currency needs the rate of an unknown day.
    """
    rows = with_money(listings.select("row_id", "execution_time", "precio_uf", "gastos_comunes"), {"precio_uf": "precio", "gastos_comunes": "gastos"})
    rows = rows.withColumn("fecha", local_day(instant(F.col("execution_time"))))
    return with_rates(rows, rates).select(
        "row_id",
        canonical(F.col("precio_uf_monto"), "UF", F.col("uf_clp"), F.col("usd_clp")).alias("precio"),
        canonical(F.col("gastos_comunes_monto"), "CLP", F.col("uf_clp"), F.col("usd_clp")).alias("gastos"),
    )


def foreign_units(listings: DataFrame) -> DataFrame:
    """``row_id``, ``campo``, ``unidad`` of each amount above zero that isn't in its field's common unit."""
    rows = with_money(listings.select("row_id", "precio_uf", "gastos_comunes"), {"precio_uf": "precio", "gastos_comunes": "gastos"})
    pair = lambda campo: F.struct(F.lit(campo).alias("campo"), F.col(f"{campo}_monto.unidad").alias("unidad"), F.col(f"{campo}_monto.base").alias("base"), F.lit({"precio_uf": "UF", "gastos_comunes": "CLP"}[campo]).alias("comun"))
    return (
        rows.select("row_id", F.inline(F.array(pair("precio_uf"), pair("gastos_comunes"))))
        .filter((F.col("base") > 0) & (F.col("unidad") != F.col("comun")))
        .select("row_id", "campo", "unidad")
    )
