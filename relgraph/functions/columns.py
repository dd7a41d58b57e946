"""Column expressions for keys and validity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_column(cols: str | Sequence[str]) -> Column:
    """One id column, or a struct with positional field names, so that differently named composite keys compare equal."""
    if isinstance(cols, str):
        return F.col(cols)
    if len(cols) == 1:
        return F.col(cols[0])
    # A key with a null part is no key.
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return F.when(whole, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]))


def key_literal(value: Any) -> Column:
    """An id as a literal: a scalar, or a tuple for a composite key."""
    if isinstance(value, (tuple, list)):
        return F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(value)])
    return F.lit(value)


def valid_at(start: str | None, end: str | None, at: Any) -> Column:
    """Whether a row is valid at a point in time: both bounds inclusive, null unbounded."""
    point = F.lit(at)
    ok = F.lit(True)
    if start:
        ok = ok & (F.col(start).isNull() | (F.col(start) <= point))
    if end:
        ok = ok & (F.col(end).isNull() | (F.col(end) >= point))
    return ok
