"""Filter atoms to one predicate column: equalities and ranges, all of which must hold."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = {"lt": lambda c, v: c < v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v}


def predicate(filters: Mapping | None, fold_accents: bool = False, columns: Mapping[str, Column] | None = None) -> Column:
    """The conjunction of ``filters``: name to value (equality) or to {lt, gt, gte, lte: bound}.

    Equality is exact; with ``fold_accents``, texts are compared without case and accents. No
    filters keep every row, unknown range names are ignored, and null never matches. The column
    is a plain comparison, so that it is pushed into the scan. ``columns``: expressions for names
    that the table doesn't have.
    """
    atoms = []
    for name, value in (filters or {}).items():
        c = columns[name] if columns and name in columns else F.col(name)
        if isinstance(value, Mapping):
            atoms += [_RANGES[op](c, bound) for op, bound in value.items() if op in _RANGES]
        elif fold_accents and isinstance(value, str):
            atoms.append(F.collate(c, "UNICODE_CI_AI") == F.collate(F.lit(value), "UNICODE_CI_AI"))
        else:
            atoms.append(c == value)
    return reduce(lambda a, b: a & b, atoms, F.lit(True))
