"""Numbers, positions and image lists read from raw fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.text import let, quoted


def _marks(c: Column) -> Column:
    """Digits, signs and marks only, with the decimal mark settled: without dots commas are decimal
    marks, with dots they group digits."""
    kept = F.regexp_replace(c, "[^0-9.,-]", "")
    # named twice, computed once: generated code shares what is always evaluated
    return F.replace(kept, F.lit(","), F.when(kept.contains("."), F.lit("")).otherwise(F.lit(".")))


def clean_numeric(c: Column) -> Column:
    """The number in a raw text as double; 0 for null, blank and what isn't one number."""
    return F.coalesce(_marks(c).try_cast("double"), F.lit(0.0))


_NO_MARK, _OUTER = re.compile(r"[^0-9.,-]"), re.compile(r"^[ \t-\r\x1c-\x1f]+|[ \t-\r\x1c-\x1f]+$")


def read_numeric(text: str | None) -> float:
    """``clean_numeric`` of one text."""
    if not text:
        return 0.0
    kept = _NO_MARK.sub("", text)
    try:
        return float(kept.replace(",", "") if "." in kept else kept.replace(",", "."))
    except ValueError:
        return 0.0


def read_problem(text: str | None) -> str | None:
    """``number_problem`` of one text."""
    s = _OUTER.sub("", text) if text else ""
    if not s:
        return None
    kept = _NO_MARK.sub("", s)
    if not kept:
        return f"Sin dígitos extraíbles (original: {repr(s)[:80]})"
    try:
        float(kept.replace(",", "") if "." in kept else kept.replace(",", "."))
    except ValueError:
        return f"No convertible a número (original: {repr(s)[:80]})"
    return None


def whole(value: float) -> int:
    """``truncated_int`` of one number."""
    if abs(value) < 2.0**63:
        return int(value)
    return (1 << 63) - 1 if value > 0 else -(1 << 63)


def number_problem(c: Column) -> Column:
    """Why a raw text that isn't blank gives no number; null if it gives one."""
    s = F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    kept = _marks(s)
    source = F.concat(F.lit(" (original: "), F.substring(quoted(s), 1, 80), F.lit(")"))
    told = F.when(kept == "", F.concat(F.lit("Sin dígitos extraíbles"), source)).when(kept.try_cast("double").isNull(), F.concat(F.lit("No convertible a número"), source))
    # most fields are a plain number, which one look tells
    return F.when(c.rlike(r"^-?\d+(\.\d+)?$"), F.lit(None).cast("string")).when(s != "", told)


def clean_price(c: Column) -> Column:
    """A price between 0 and 100,000."""
    return F.least(F.greatest(clean_numeric(c), F.lit(0.0)), F.lit(100_000.0))


def inside_chile(lat: Column, lon: Column) -> Column:
    return lat.between(-55, -17) & lon.between(-109, -66)


def clean_coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Both coordinates, or 0 for both unless they lie in Chile's bounds."""
    read = F.struct(clean_numeric(lat).alias("y"), clean_numeric(lon).alias("x"))
    none = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))
    place = let(read, lambda p: F.when(inside_chile(p["y"], p["x"]), p).otherwise(none))
    return place["y"], place["x"]


def truncated_int(c: Column) -> Column:
    """Towards zero, as bigint; beyond its range the last of it."""
    edge = float(1 << 63)
    return F.when(c >= edge, F.lit((1 << 63) - 1)).when(c < -edge, F.lit(-(1 << 63))).otherwise(c.try_cast("bigint"))


def plain_double(c: Column) -> Column:
    """A double as text without exponent, with at least one decimal."""
    return F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", ".0")


def _load(text: str | None):
    """The parsed image field after the textual repairs, or the error."""
    fixed = text.replace('""', '"').replace('"{', "{").replace('}"', "}")
    try:
        return json.loads(fixed), None
    except (ValueError, RecursionError) as e:
        return None, str(e)


def _images(text: str | None) -> list[str]:
    if not text:
        return []
    data, _ = _load(text)
    found = data.get("images") if isinstance(data, dict) else data
    texts = [x if isinstance(x, str) else json.dumps(x) for x in found if x is not None] if isinstance(found, list) else []
    # half a pair of surrogates, which JSON may escape, is no valid text
    return [x if x.isascii() else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in texts]


def images_issue(text: str | None) -> str | None:
    """``images_problem`` of one text."""
    if not text or not text.strip():
        return None
    data, error = _load(text.strip())
    if error is not None:
        return f"JSON inválido: {error[:60]}"
    return None if isinstance(data, list) or isinstance(data, dict) and "images" in data else "JSON sin campo 'images' ni lista"


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_images(texts: pd.Series) -> pd.Series:
    """The image list of a raw field by strict JSON (which built-in functions don't offer); empty if it has none."""
    return texts.map(_images)


@F.pandas_udf(T.StringType())
def images_problem(texts: pd.Series) -> pd.Series:
    """Why a raw image field that isn't blank gives no list; null if it gives one."""
    return texts.map(images_issue)


def normalized_images(c: Column) -> Column:
    """The texts of an image list that aren't blank."""
    return F.filter(c, lambda x: F.trim(x) != "")
