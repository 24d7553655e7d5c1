"""The column functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from parcela.functions import numbers as N
from parcela.functions import text as T


@F.pandas_udf(DoubleType())
def _numeric(texts: pd.Series) -> pd.Series:
    return texts.map(N.read_numeric, na_action=None).astype(float)


@F.pandas_udf(DoubleType())
def _price(texts: pd.Series) -> pd.Series:
    return texts.map(N.read_numeric, na_action=None).astype(float).clip(0.0, 100_000.0)


@F.pandas_udf(StringType())
def _problem(texts: pd.Series) -> pd.Series:
    return texts.map(N.read_problem, na_action=None).astype(object)


FUNCTIONS = {"clean_string": T.cleaned, "clean_numeric": _numeric, "clean_price": _price, "number_problem": _problem, "parse_images": N.parse_images, "images_problem": N.images_problem}


def register(spark: SparkSession) -> list[str]:
    """Make every function of ``FUNCTIONS`` and ``embed_text`` callable in ``spark.sql``; returns their names."""
    from parcela.operators.embed import embedding_udf

    own = FUNCTIONS | {"embed_text": embedding_udf()}
    for name, f in own.items():
        spark.udf.register(name, f)
    return sorted(own)
